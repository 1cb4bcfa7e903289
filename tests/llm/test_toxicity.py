import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.llm_helpers import by_id, clash, words

from trackuse.llm import toxicity as tx


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = random.Random(40)
    texts, labels = [], []
    for i in range(400):
        text = words(rng, rng.randrange(5, 80)).split()
        bad = i % 4 == 0
        for _ in range(1 + len(text) // 20) if bad else ():
            text.insert(rng.randrange(len(text)), rng.choice(["vileword", "nastyterm"]))
        texts.append(" ".join(text))
        labels.append((i, int(bad), int(bad)))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(documents, labelled):
    texts, labels = labelled
    found = by_id(tx.scored(clash(documents(texts)), clash(labels)))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i, r in sorted(found.items()) if r.held_out] == held
    right = sum(found[i].predicted == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.97 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found.values())


def test_scores_depend_on_the_text_alone(documents, labelled, odd_texts):
    texts, labels = labelled
    model = tx.train(documents(texts), labels)
    odd = documents(odd_texts, 1_000)
    found = by_id(odd.select("doc_id", tx.score_of(model)("text").alias("score")))
    assert [found[1_000 + i].score for i in range(len(odd_texts))] == [model.score(t) for t in odd_texts]
    assert model.score(None) == model.score("") < 0.3 and np.isfinite(model.weights).all()
    kept = tx.without_toxic(clash(documents(texts)), labels)
    assert set(r.doc_id % 4 for r in kept.select("doc_id").collect()) <= {1, 2, 3, 0} and 280 < kept.count() < 320


def test_held_out_labels_are_not_learned(spark, documents, labelled):
    texts, labels = labelled
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    a, b = tx.train(documents(texts), labels, ~tx.held_out()), tx.train(documents(texts), flipped, ~tx.held_out())
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_without_both_classes_nothing_is_toxic(spark, documents):
    docs = documents(["a", "b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(0, 0), (1, None), (2, 5)], "doc_id long, toxic int")
    for labels in (none, clean):
        assert [r.score for r in tx.scored(docs, labels).collect()] == [0.0] * 3
    assert tx.scored(documents([]), none).count() == 0


def test_the_sample_is_bounded(documents, labelled):
    texts, labels = labelled
    assert tx.training_rows(documents(texts), labels, tx.F.lit(True), 50).count() == 50


def plain_scores(texts, labels, queries):
    """Ratios, fit and scores over again, n-gram by n-gram, in plain Python."""

    def grams(text):
        spaced = f" {' '.join((text or '').lower().split())} "
        found = [spaced[i : i + n] for n in (3, 4, 5) for i in range(len(spaced) - n + 1)]
        hashed = []
        for g in found:
            h = ord(g[0])
            for c in g[1:]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            hashed.append((h * 0xBF58476D1CE4E5B9 % 2**64) >> 46)
        return set(hashed), 10 / math.sqrt(max(len(hashed), 1))

    rows = [(*grams(t), y) for t, y in zip(texts, labels, strict=True) if y in (0, 1)]
    total = Counter(y for *_, y in rows)
    with_, clean = Counter(), Counter()
    for bag, _, y in rows:
        (with_ if y else clean).update(bag)
    ratio = {}
    for g in with_ | clean:
        r = math.log((with_[g] + 1) / total[1]) - math.log((clean[g] + 1) / total[0])
        if with_[g] + clean[g] >= 4 and abs(r) >= 1:
            ratio[g] = r
    weight, seen, bias, seen_bias = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8), 0.0, 1e-8

    def margin(bag, size):
        return bias + sum(weight[g] * ratio[g] for g in bag if g in ratio) * size

    for _ in range(200):
        misses = [(1 / (1 + math.exp(-margin(bag, size))) - y) / len(rows) for bag, size, y in rows]
        steps = {g: 1e-5 * w for g, w in weight.items()}
        for (bag, size, _), miss in zip(rows, misses, strict=True):
            for g in bag & ratio.keys():
                steps[g] += miss * size * ratio[g]
        for g, step in steps.items():
            seen[g] += step**2
            weight[g] -= 0.1 * step / math.sqrt(seen[g])
        seen_bias += sum(misses) ** 2
        bias -= 0.1 * sum(misses) / math.sqrt(seen_bias)
    return [1 / (1 + math.exp(-margin(*grams(q)))) for q in queries]


def test_scores_are_those_of_a_plain_recomputation(spark, documents, labelled, odd_texts):
    texts, marks = labelled[0][:160], [int(i % 4 == 0) for i in range(160)]
    queries = texts + [t for t in odd_texts if len(t or "") < 2_000]
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    learned = [zlib.crc32(str(i).encode()) % 4 != 2 for i in range(160)]
    expected = plain_scores(texts, [m if k else None for m, k in zip(marks, learned, strict=True)], queries)
    found = by_id(tx.scored(documents(queries), labels))
    assert [found[i].score for i in range(len(queries))] == pytest.approx(expected, abs=1e-9)


def test_rows_without_an_id(spark, labelled):
    docs = spark.createDataFrame([(None, "w a"), (None, None), (3, "vileword")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (3, 0), (None, 0)], "doc_id long, toxic int")
    found = tx.scored(docs, labels).collect()
    assert len(found) == 3 and not any(r.held_out for r in found if r.doc_id is None) and all(r.score == 0 for r in found)
