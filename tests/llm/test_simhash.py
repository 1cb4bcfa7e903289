import random

import numpy as np
import xxhash

from llm.llm_helpers import by_id, clash, words
from trackuse.llm import simhash as sh
from trackuse.operators.components import connected_components


def plain_simhash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def components(values, radius):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_fingerprints_and_components_against_brute_force(spark, documents, odd_texts):
    rng = random.Random(4)
    base = words(rng, 400)
    near = [base.replace(f" {base.split()[k]} ", " Changed ", 1) for k in range(5, 60, 5)]
    texts = odd_texts + near + [base.upper()] + [words(rng, 30) for _ in range(20)]
    found = by_id(sh.near_duplicate_components(clash(documents(texts))))
    values = [plain_simhash(t) for t in texts]
    assert {d: r.fingerprint for d, r in found.items()} == {i: f"{v:016x}" for i, v in enumerate(values)}
    assert {d: r.component_id for d, r in found.items()} == dict(enumerate(components(values, 2)))
    assert found[0].component_id == found[1].component_id == found[2].component_id == 0


def test_links_of_dense_groups_connect_what_is_near():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    members = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(60)]
    members = sorted(set(members))
    links = sh.group_links(np.array(members, np.uint64), 2)
    assert all((x ^ y).bit_count() <= 2 for x, y in links) and len(links) < len(members)
    at = {m: i for i, m in enumerate(members)}
    label = list(range(len(members)))
    for _ in members:
        for x, y in links:
            label[at[x]] = label[at[y]] = min(label[at[x]], label[at[y]])
    assert label == components(members, 2)


def test_bit_sliced_distances():
    rng = np.random.default_rng(7)
    members = rng.integers(0, 2**63, 500, dtype=np.uint64)
    members[::7] = members[0] ^ (np.uint64(1) << rng.integers(0, 64, len(members[::7]), dtype=np.uint64))
    planes, full = sh.bit_planes(members)
    for radius in (0, 1, 2, 3, 7):
        query = int(members[0])
        expected = sum(1 << i for i, m in enumerate(members) if (int(m) ^ query).bit_count() <= radius)
        assert sh.within_radius(query, planes, full, radius) == expected


def test_masks_never_miss_a_pair():
    rng = random.Random(8)
    masks = sh._masks(2)
    for _ in range(2_000):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(x & m == y & m for m in masks)


def test_one_document_of_each_component_stays(spark, documents):
    texts = ["a b c d", "a b c d", "other words here now", None, ""]
    docs = clash(documents(texts))
    docs = docs.unionByName(docs.where("doc_id = 0"))
    kept = sh.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert sh.keep_one_per_component(documents([])).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "x y z"), (None, "q r s t"), (5, "q r s t")], "doc_id long, text string")
    found = sh.near_duplicate_components(rows).collect()
    assert sorted(str(r.component_id) for r in found) == ["5", "5", "None"]


def test_components_of_shapes(spark):
    rng = random.Random(9)
    path = [(i, i + 1) for i in range(300)]
    star = [(1_000, 1_001 + i) for i in range(100)]
    bay = [(2_000 + i, 2_001 + i) for i in range(50)] + [(3_000 - i, 2_999 - i) for i in range(50)] + [(2_050, 2_950)]
    links = path + star + bay + [(7, 7), (None, 4), (0, 1)]
    rng.shuffle(links)
    found = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    parts = {}
    for r in found:
        parts.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, parts.values())) == [101, 102, 301]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_one_row_of_a_component_stays_whatever_the_ids(spark):
    a, b, c = ("first text of some words", "quite another text with words", "a third one that stands alone")
    rows = [(None, a, "x"), (None, a, "y"), (7, b, "x"), (7, c, "z"), (7, c, "y"), (9, b, "x"), (None, b, "x"), (3, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(map(tuple, sh.keep_one_per_component(docs).collect()), key=repr)
    assert found == sorted([(None, a, "x"), (7, b, "x"), (7, c, "y"), (3, None, "x")], key=repr)
    assert sh.keep_one_per_component(docs.limit(0)).count() == 0
    assert sh.keep_one_per_component(docs.select("doc_id", "text")).count() == 4


def test_large_groups_are_split_without_losing_links(spark):
    rng = random.Random(10)
    values = set()
    for _ in range(3):  # dense groups: neighbours of a few centres, chains of them, and one far away
        x = rng.getrandbits(64)
        for _ in range(120):
            values.add(x)
            x = x ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) if rng.random() < 0.9 else x ^ (7 << rng.randrange(60))
    values = sorted(values)
    groups = {v: v for v in values}

    def root(v):
        while groups[v] != v:
            v = groups[v]
        return v

    for i, v in enumerate(values):
        for w in values[:i]:
            if (v ^ w).bit_count() <= 2:
                groups[root(v)] = root(w)
    expected = {}
    for v in values:
        expected.setdefault(root(v), set()).add(sh._signed(v))
    rows = spark.createDataFrame([(sh._signed(v),) for v in values], "fp long")
    keyed = rows.select(sh.F.lit(5).cast("long").alias("key"), "fp")
    sizes = [r["count"] for r in sh._split(keyed, 50).groupBy("key").count().collect()]
    blocks = -(-len(values) // 50)
    assert len(sizes) == blocks * (blocks - 1) // 2 and sum(sizes) == len(values) * (blocks - 1)
    for largest in (1, 20, 4_096):
        labels = connected_components(sh.fingerprint_links(rows, 2, largest)).collect()
        parts = {}
        for r in labels:
            parts.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, parts.values())) == sorted(sorted(p) for p in expected.values() if len(p) > 1)
