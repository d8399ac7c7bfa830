"""The corpus pipeline: documents to token ids, in five stages. Each stage's rows are written, and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, jaccard, mixing, pii, quality
from annalist.llm.common import store
from annalist.llm.queries import SURROGATE_KEY, VOCABULARY, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the trees hold for poor, go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a five-word similarity of 0.8 or more, the one of the smallest id stays."""
    return jaccard.keep_one(docs)


def by_place(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[str], str]]:
    """``docs`` with columns named by their place, these names, and the one of a column of documents."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, lambda column: names[docs.columns.index(column)]


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; n_chars follows. All columns stay, whatever their names."""
    plain, names, at = by_place(docs)
    new = pii.replace(plain, SURROGATE_KEY, text_col=at("text"))
    if "n_chars" in docs.columns:
        new = new.withColumn(at("n_chars"), F.length(at("text")).cast(docs.schema[docs.columns.index("n_chars")].dataType))
    return new.select(*names).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document comes as often as it is drawn, shards together, in a random order.
    All columns stay, whatever their names."""
    plain, names, at = by_place(docs)
    planned = mixing.mix(plain, id_col=at("doc_id"), text_col=at("text"), source_col=at("source"), carry=tuple(names))
    return mixing.shuffled(planned).select(*names).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return bpe.opened(bpe.encode(docs, VOCABULARY), VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Trees, MinHash and keyed hashes have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
