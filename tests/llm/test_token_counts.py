import json
import random

import public_tokenizers
import pytest
from llm.llm_helpers import by_id, clash, words
from tokenizers import Tokenizer

from trackuse.llm import token_counts
from trackuse.llm.queries import vocabulary

ODD = ["<|endoftext|> and<|startoftext|>x<|endoftext|>", "don't I'll we've 'S", "é ́ x y z\x1cq", "ΑΣ ΑΣ\r\n\r\ntail ", "%%%" * 900, "日本語テキスト" * 300, "a<b <| endoftext|>", " x y z", "İstanbul ﬁne ½"]
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain_count(symbols, ranks):
    """Merges the first of the lowest-ranked pairs, looking at all pairs each time."""
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return len(symbols)
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_heap_and_list_merge_as_looking_at_all_pairs():
    rng = random.Random(1)
    for _ in range(300):
        parts = ["a", "b", "c"]
        for _ in range(12):
            parts.append(rng.choice(parts) + rng.choice(parts))
        pairs = list({(x[:k], x[k:]) for x in parts for k in range(1, len(x))})
        rng.shuffle(pairs)
        ranks = {p: r for r, p in enumerate(pairs)}
        symbols = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        number = {s: i for i, s in enumerate(sorted({"d", *parts, *(x for p in pairs for x in p)}))}
        numbered = {(number[a], number[b]): r for (a, b), r in ranks.items()}
        made = [number[a + b] for a, b in pairs]
        assert token_counts.merged_count([number[s] for s in symbols], numbered, made) == plain_count(symbols, ranks)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_the_library(name, odd_texts):
    rng = random.Random(2)
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    alphabet = "ab eE\n\t'sé日1<|>.́ ß"
    texts = odd_texts + ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(2_000)] + [words(rng, 200)]
    for text in texts:
        assert own.count(text) == len(library.encode(text or "", add_special_tokens=False).ids), text


def test_one_long_word_is_not_quadratic():
    own = token_counts.Counter(vocabulary())
    assert own.count("ab" * 200_000) > 0


def test_rows(spark, documents, odd_texts):
    library = Tokenizer.from_file(vocabulary())
    found = by_id(token_counts.counted(clash(documents(odd_texts)), vocabulary()))
    for i, text in enumerate(odd_texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert any(r.over_limit for r in found.values())
    assert token_counts.counted(documents([]), vocabulary()).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.counted(rows, vocabulary()).collect()) == [("1", 2), ("1", 2), ("None", 2)]


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(vocabulary(), encoding="utf-8"))
    spec["model"]["dropout"] = 0.1
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.Counter(str(path))
