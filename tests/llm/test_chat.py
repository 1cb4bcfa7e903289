import random

from llm.llm_helpers import clash, words

from trackuse.llm import chat

TYPE = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, set()).add((chat.LAST if turn is None else turn, role or "", text or ""))
    texts = {c: [f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, t in texts.items():
        same = [d for d, u in texts.items() if u == t]
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in texts.values())
        if min(same) == c and not longer:
            out[c] = (len(t), len(same), "".join(t))
    return out


def check(spark, rows):
    found = chat.maximal_conversations(clash(spark.createDataFrame(rows, TYPE)))
    assert {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in found.collect()} == brute(rows)
    return found


def test_against_brute_force(spark):
    rng = random.Random(50)
    rows = []
    for c in range(60):
        start = rng.randrange(8)
        for k in range(rng.randrange(1, 6)):
            text = f"{start} {k}" if rng.random() < 0.9 else words(rng, 3)
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", text))
    rows += [(100, 300 * k, "user", f"t{k}") for k in range(5)] + [(101, 300 * k, "user", f"t{k}") for k in range(4)]
    rows += [(102, None, "user", "x"), (102, 1, None, None), (102, 1, "", ""), (None, 0, "user", "x")]
    rows += [(103, 0, "user", "tie"), (103, 0, "assistant", "tie"), (104, 0, "user", ""), (105, 0, "user", "y" * 100_000)]
    found = check(spark, rows + rows[:20])
    assert "Python" not in found._jdf.queryExecution().toString()


def test_no_rows(spark):
    check(spark, [])
