import random

import corpus_pipeline
import pytest
from llm.llm_helpers import DOC, words

from __spark_entry__ import queries
from trackuse.llm import bpe, toxicity
from trackuse.llm import decontamination as dc
from trackuse.llm import line_dedup as ld
from trackuse.llm import simhash as sh
from trackuse.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(80)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = words(rng, 25)
    clean = ["\n".join(words(rng, 20) for _ in range(5)) for _ in range(120)]
    toxic = [" ".join(f"{words(rng, 4)} vileword" for _ in range(9)) for _ in range(60)]
    near = " ".join(clean[0].split())
    texts = clean + toxic + [clean[1], near + " more words", f"{words(rng, 9)} {item} {words(rng, 9)}", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 120)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_have_the_given_order_and_columns(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_result_against_stages_in_plain_python(spark, tables):
    """The model of the first stage is trained; all that follows is done again one text after the other."""
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    rest = {i: t for i, t in enumerate(texts) if model.score(t) < toxicity.THRESHOLD}
    assert set(range(120)) <= set(rest) and not set(range(120, 180)) & set(rest)
    seen, kept = [], {}
    for i, text in rest.items():
        lines = []
        for line in (text or "").split("\n"):
            own = set(line.lower().split())
            if not own or not any(5 * len(own & s) >= 4 * len(own | s) for s in seen):
                lines.append(line)
            seen += [own] if own else []
        kept[i] = None if text is None else "\n".join(lines)
    prints = {i: sh.simhash(t) for i, t in kept.items()}
    least = {}
    for i, p in prints.items():
        least[i] = min(j for j, q in prints.items() if (p ^ q).bit_count() <= sh.RADIUS)
    kept = {i: t for i, t in kept.items() if least[i] == i}
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    kept = {i: t for i, t in kept.items() if item not in (t or "")}
    assert 119 < len(kept) < 124
    codec = bpe.Codec(corpus_pipeline.vocabulary())
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {i: len(codec.whole(t or "")) for i, t in kept.items()}


def test_empty_documents_go_through(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert dc.WINDOW == 8 and float(ld.SIMILARITY) == 0.8


@pytest.mark.parametrize("name", ["op1_fingerprints", "op5_decontamination", "op10_simhash", "op2_bpe", "op12_token_counts"])
def test_queries_read_whole_tables(spark, tables, name):
    folder, texts = tables
    found = QUERIES[name](spark, folder)
    assert found.count() == (1 if name.startswith("op5") else len(texts))


@pytest.mark.parametrize("name", ["op4_chat", "op6_licenses", "op9_line_dedup"])
def test_queries_match_their_sql(spark, name, monkeypatch):
    from checks import compare
    from trackuse.llm.queries import ORACLES

    sf = "/root/testdata/sf0.001"
    monkeypatch.setitem(compare.ORACLES, name, ORACLES[name])
    assert compare.compare(compare.database(sf), name, QUERIES[name](spark, sf)).startswith("ok")
