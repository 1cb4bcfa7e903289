import random

import pytest
from conftest import rows

from trackuse.operators import components as c


def parts(found):
    out = {}
    for node, label in found:
        out.setdefault(label, set()).add(node)
    return sorted(map(sorted, out.values()))


SHAPES = {
    "path": [(i, i + 1) for i in range(1_500)],
    "shuffled path": [(hash((i, 1)) % 10**9, hash((i + 1, 1)) % 10**9) for i in range(500)],
    "star": [(0, i) for i in range(1, 900)],
    "bay of two arms": [(i, i + 1) for i in range(200)] + [(1_000 - i, 999 - i) for i in range(200)] + [(200, 800)],
    "ring": [(i, (i + 1) % 300) for i in range(300)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_take_few_rounds_and_leave_no_links(spark, monkeypatch, shape):
    gone = []
    monkeypatch.setattr(c, "discard", lambda t: gone.append(t.staged_path))
    links = SHAPES[shape]
    found = rows(c.connected_components(spark.createDataFrame(links, "src long, dst long")).select("node", "label"))
    assert parts(found) == [sorted({n for link in links for n in link})]
    assert len(gone) <= 21 and len(set(gone)) == len(gone)


def test_random_graphs_loops_repeats_and_nulls(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    label = list(range(300))
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame([*links, *links[:50], (5, 5), (None, 3), (4, None)], "a long, b long")
    found = rows(c.connected_components(df, "a", "b").select("node", "label"))
    assert parts(found) == parts((n, label[n]) for n in linked)
    assert rows(c.connected_components(df.limit(0), "a", "b")) == []
