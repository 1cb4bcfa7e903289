"""The operators of this folder as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackuse.llm import (
    bpe,
    chat,
    decontamination,
    fingerprints,
    hard_negatives,
    html_extraction,
    licenses,
    line_dedup,
    quality,
    simhash,
    token_counts,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op1_fingerprints(spark, sf):
    return fingerprints.half_edited(table(spark, sf, "documents"))


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_bpe(spark, sf):
    return token_digests(bpe.encode_documents(table(spark, sf, "documents"), vocabulary()))


@query()
def op3_toxicity(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(chat.SQL)
def op4_chat(spark, sf):
    return chat.maximal_conversations(table(spark, sf, "conversations"))


@query()
def op5_decontamination(spark, sf):
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(licenses.oracle_sql())
def op6_licenses(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query()
def op7_quality(spark, sf):
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op8_html(spark, sf):
    texts = html_extraction.main_texts(table(spark, sf, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query(line_dedup.SQL)
def op9_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs)


@query()
def op10_simhash(spark, sf):
    return simhash.near_duplicate_components(table(spark, sf, "documents"))


@query(hard_negatives.SQL)
def op11_hard_negatives(spark, sf):
    return hard_negatives.mined(table(spark, sf, "embeddings"))


@query()
def op12_token_counts(spark, sf):
    return token_counts.counted(table(spark, sf, "documents"), vocabulary())


@query()
def op13_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))
