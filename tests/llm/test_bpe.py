import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.llm_helpers import by_id, clash, words
from trackuse.llm import bpe
from trackuse.llm.queries import token_digests, vocabulary


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["<|endoftext|> and<|startoftext|>x", "don't I'll we've", "é ́ x y z\x1cq", "ΑΣ ΑΣ\r\n\r\ntail ", "%%%" * 900, "日本語テキスト" * 300]


def test_equal_to_the_library(spark, documents, odd_texts):
    rng = random.Random(10)
    shared = words(rng, 700)
    texts = odd_texts + ODD + [words(rng, 50) + shared[rng.randrange(30) :] for _ in range(10)]
    docs = clash(documents(texts))
    found = by_id(bpe.encode_documents(docs, vocabulary()))
    library = Tokenizer.from_file(vocabulary())
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i].ids == ids
        assert found[i].decoded == library.decode(ids, skip_special_tokens=False)
    digests = by_id(token_digests(bpe.encode_documents(docs, vocabulary())))
    for i, r in found.items():
        assert digests[i].n_tokens == len(r.ids) and digests[i].decoded_sha256 == sha(r.decoded)
        assert digests[i].ids_sha256 == sha(" ".join(map(str, r.ids)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_are_repaired_wherever_a_chunk_ends(name, monkeypatch):
    rng = random.Random(11)
    path = public_tokenizers.path(name)
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    for trial in range(150):
        text = rng.choice(ODD)[:40] + words(rng, 30) + rng.choice([" ", "\n", ""]) + rng.choice(ODD)[:40] + words(rng, 5)
        ends = sorted({*(rng.randrange(1, len(text)) for _ in range(trial % 9)), len(text)})
        monkeypatch.setattr(bpe, "cuts", lambda t, ends=ends: ends)
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_cut_changes_ids_and_the_repair_puts_them_right(name, monkeypatch):
    codec = bpe.Codec(public_tokenizers.path(name))
    assert codec.drops or codec.leads
    text = words(random.Random(13), 60)
    middle = text.index(" ", 150) + 3  # inside a word
    monkeypatch.setattr(bpe, "cuts", lambda t: [middle, len(t)])
    apart = codec.whole(text[:middle]) + codec.whole(text[middle:])
    assert apart != codec.whole(text) == codec.encode(text)


def test_joins_grow_until_the_outer_words_agree(monkeypatch):
    codec = bpe.Codec(vocabulary())
    text = words(random.Random(14), 80)
    monkeypatch.setattr(bpe, "cuts", lambda t: [250, len(t)])
    right, asked = codec.batch, []

    def wrong_at_first(texts):
        asked.append(texts)
        return [b"\xff" * 4 + ids for ids in right(texts)] if len(asked) == 2 else right(texts)

    monkeypatch.setattr(codec, "batch", wrong_at_first)
    assert codec.encode(text) == codec.whole(text)
    joins = [t for t in asked if t and any(" " in x for x in t)]
    assert len(joins) == 2 and len(joins[1][0]) > len(joins[0][0])


def test_a_table_forgets_what_is_not_asked_for():
    table = bpe.Generations(2)
    for keys in ("ab", "ac", "ad", "ae", "af"):
        new = table.missing(keys)
        table.young.update((k, k) for k in new)
        assert all(k in table.young for k in keys)
    assert "b" not in table.young | table.old and len(table.young) + len(table.old) < 6


def test_cuts_cover_the_text_and_follow_the_content():
    text = words(random.Random(12), 5_000)
    assert bpe.cuts(text)[-1] == len(text)
    moved = {len(text) - e for e in bpe.cuts(text)}
    assert len(moved & {len(text) + 9 - e for e in bpe.cuts("9 letters" + text)}) >= len(moved) - 1
    assert bpe.cuts("é" * 3_000)[-1] == 3_000


def test_no_rows_and_null_ids(spark, documents):
    assert bpe.encode_documents(documents([]), vocabulary()).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in bpe.encode_documents(rows, vocabulary()).collect()) == ["1", "1", "None"]
