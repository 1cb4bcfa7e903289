import hashlib
import random

from llm.llm_helpers import by_id, clash, words
from trackuse.llm import fingerprints as fp


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last if x == y else i + j)
    return row[-1]


def brute(texts):
    """The rows as the definition says, with a plain edit distance."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        a, b = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        out[d] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(a), fp.fingerprint(edited))
    return out


def test_whole_table_against_brute_force(spark, documents, odd_texts):
    rng = random.Random(1)
    texts = odd_texts + [words(rng, rng.randrange(1, 300)) for _ in range(40)]
    found = by_id(fp.half_edited(clash(documents(texts))))
    expected = brute(dict(enumerate(texts)))
    assert {d: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for d, r in found.items()} == expected
    near = [r.near_edited for d, r in found.items() if d >= len(odd_texts) and r.n_chars > 200]
    apart = [r.near_next for d, r in found.items() if d >= len(odd_texts)]
    assert min(near) > 0.2 > max(apart)


def test_likeness_is_one_minus_the_scaled_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ABCD") * 2 for _ in range(rng.randrange(1, 20))) for _ in "ab")
        x, y = fp._pairs(a), fp._pairs(b)
        assert abs(fp._likeness(a, b) - (1 - edit_distance(x, y) / (len(x) + len(y)))) < 1e-12


def test_every_byte_counts_and_equal_texts_agree():
    text = words(random.Random(3), 3_000)
    for at in (0, len(text) // 2, len(text) - 1):
        assert fp.fingerprint(text[:at] + "#" + text[at + 1 :]) != fp.fingerprint(text)
    assert fp.fingerprint(text) == fp.fingerprint(str(text)) and fp.fingerprint(None) == fp.fingerprint("")
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1.0


def test_few_rows_null_ids_and_no_rows(spark, documents):
    assert fp.half_edited(documents([])).count() == 0
    one = by_id(fp.half_edited(documents(["abcd"])))[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = spark.createDataFrame([(None, "nul"), (3, "three"), (3, "three"), (1, "one")], "doc_id long, text string")
    found = fp.half_edited(rows).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "3", "3", "None"]
    last = next(r for r in found if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(b"nut").hexdigest()


def test_columns_of_fingerprints(spark):
    df = spark.createDataFrame([("some text", None), (None, "")], "a string, b string")
    rows = df.select(fp.fingerprint_of("a").alias("a"), fp.fingerprint_of("b").alias("b")).collect()
    assert rows[0].a == fp.fingerprint("some text") and rows[1].a == rows[1].b == rows[0].b
