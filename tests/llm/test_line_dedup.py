import random

import pytest
from llm.llm_helpers import by_id, clash, words

from trackuse.llm import line_dedup as ld


def brute(texts):
    """Every line against every earlier one."""
    seen, out = [], {}
    for i, text in enumerate(texts):
        kept = []
        for line in (text or "").split("\n"):
            own = set(line.lower().split())
            like = own and any(5 * len(own & s) >= 4 * len(own | s) for s in seen)
            if own:
                seen.append(own)
            if not like:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def check(docs, texts):
    found = ld.without_repeated_lines(docs)
    assert found.columns == docs.columns
    assert {i: r.text for i, r in by_id(found).items()} == brute(texts)


def test_whole_table_against_brute_force(documents, odd_texts):
    rng = random.Random(20)
    lines = [words(rng, rng.randrange(1, 14), 40) for _ in range(60)] + [words(rng, 25) for _ in range(20)]
    texts = []
    for _ in range(60):
        chosen = [rng.choice(lines).split() for _ in range(rng.randrange(1, 6))]
        for w in chosen:
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        texts.append("\n".join(" ".join(w) for w in chosen) + rng.choice(["", "\n", "\n\n"]))
    texts = odd_texts + texts
    check(clash(documents(texts)), texts)


@pytest.mark.parametrize("nearest", [1, 4])
def test_large_groups_of_near_copies(documents, monkeypatch, nearest):
    monkeypatch.setattr(ld, "NEAREST", nearest)
    rng = random.Random(21)
    base = words(rng, 30).split()
    texts = []
    for _ in range(80):
        line = list(base)
        for _ in range(rng.randrange(1, 7)):
            line[rng.randrange(len(line))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(line))
    check(documents(texts), texts)


def test_similarity_of_exactly_four_fifths(documents):
    texts = ["a b c d", "a b c d e", "a b c d e f", "q r s", "q r s t", "one", "One  ", "\t\n"]
    check(documents(texts), texts)


def test_no_rows_repeated_rows_and_null_ids(spark, documents):
    assert ld.without_repeated_lines(documents([])).count() == 0
    rows = [(None, "x y z"), (4, "x y z\nmore"), (4, "x y z\nmore"), (5, None)]
    found = ld.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, [tuple(r) for r in found])) == ["(4, 'more')", "(4, 'more')", "(5, None)", "(None, 'x y z')"]


def test_only_built_in_functions(documents):
    docs = documents(["a b c", "a b c"])
    plan = ld.without_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_near_copies_across_rows_without_an_id(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e f\nmore"), (None, "k l m n o"), (None, "k l m n o p"), (None, "only here"), (None, None)]
    found = ld.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text for r in found if r.doc_id is None]
    assert [r.text for r in found if r.doc_id == 4] == ["more"]
    assert sum(t in ("k l m n o", "k l m n o p") for t in texts) == 1 and texts.count("") == 1
    assert len(texts) == 5 and {"a b c d e", "only here", None} <= set(texts)


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "a b c d e"), (5, "unique words of this row"), (5, "a b c d"), (None, "a b c d e f"), (None, "other words in here")]
    found = sorted(map(tuple, ld.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # rows without an id come first, so the others repeat what the null row has
    assert found == sorted([(1, ""), (5, "unique words of this row"), (5, ""), (None, "a b c d e f"), (None, "other words in here")], key=repr)
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "totally different words than those")]
    found = sorted(map(tuple, ld.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == [(1, "a b c d e"), (5, ""), (5, "totally different words than those")]


@pytest.mark.parametrize("n", [60, 250])
def test_unlike_long_lines_may_not_match(documents, n):
    rng = random.Random(n)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for _ in range(20)]
    docs = documents([*texts, texts[0] + " other"])
    classes = ld.stage(ld.line_classes(docs, "doc_id", "text", ld.rarity_sketch(docs, "text"), ld.SIMILARITY), "classes")
    firsts = ld._prefix_rows(classes).where("i = 0")
    x, y = ld._fields("x"), ld._fields("y")
    met = firsts.alias("x").join(firsts.alias("y"), (x["number"] != y["number"]) & ld._may_match(x, y, ld.SIMILARITY))
    assert met.count() == 2  # the line and its near copy, both ways


def test_near_copies_of_lines_of_all_lengths(documents):
    rng = random.Random(23)
    texts = []
    for n in [*range(55, 75), *range(120, 140), 300]:
        line = [f"w{rng.randrange(10**4)}" for _ in range(n)]
        texts.append(" ".join(line))
        for cut in (0.08, 0.1, 0.2, 0.21):
            texts += [" ".join(line[int(n * cut) :]), " ".join([*line, *(f"v{rng.randrange(10**4)}" for _ in range(int(n * cut)))])]
    check(documents(texts), texts)


def test_words_are_hashed_once(documents):
    docs = documents(["a b c", "a b c\n\n \t\x0b\x0c\r\nd"])
    classes = ld.line_classes(docs, "doc_id", "text", ld.rarity_sketch(docs, "text"), ld.SIMILARITY)
    plan = classes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1  # a filter by the hashes computed them a second time
    assert sorted(r.n for r in classes.collect()) == [1, 3]


def test_lines_without_words_and_whole_texts_stay(documents):
    texts = ["a b\n \t\x0b\x0c\r \n\nc", "\n\n", "", "q r\n", "q r\n\u00a0\u2003\n", None, "only\nnew words"]
    found = by_id(ld.without_repeated_lines(documents(texts)))
    assert {i: r.text for i, r in found.items()} == {**dict(enumerate(texts)), 4: "\u00a0\u2003\n"}
