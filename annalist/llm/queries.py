"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import align, bpe, embeddings, jaccard, lexical, mixing, oracles, pii, quality, sharding, substrings, tokenfile, warc, windows

#: A public vocabulary: BPE with word ends, 49,408 ids.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: A cluster passes a secret key of its own.
SURROGATE_KEY = b"annalist"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, folder, "documents"), VOCABULARY)


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), 8)


@query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), VOCABULARY), VOCABULARY)


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.dedup(table(spark, folder, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("changed"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


@query
def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.join(table(spark, folder, "embeddings"), 0.98)


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace(table(spark, folder, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query
def op13_windows(spark: SparkSession, folder: str) -> DataFrame:
    cut = windows.dedup(table(spark, folder, "documents"), 20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 20)


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.measure(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
