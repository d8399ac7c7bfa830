"""Sinks on plain Parquet: one folder per table and batch.

A batch writes only its own rows, under its own number and with overwrite, so a repeated batch (a
retried task, a restarted stream) leaves the same files. Tables that change keep every version of a
row; the current one is the version of the highest batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def read_before(spark: SparkSession, root: str, table: str, batch_id: int | None = None) -> DataFrame | None:
    """All rows of earlier batches with their ``batch_id``; None if there are none yet."""
    try:
        df = spark.read.option("mergeSchema", "false").parquet(f"{root}/{table}")
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df if batch_id is None else df.where(F.col("batch_id") < batch_id)


def current_rows(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of each row; the aggregate keeps one version per key before the shuffle."""
    columns = [c for c in versions.columns if c not in (key, "batch_id")]
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def insert_absent(new: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """New rows whose key is not stored, each key once."""
    fresh = new.dropDuplicates(keys)
    return fresh if stored is None else fresh.join(stored.select(*keys), keys, "left_anti")


def supports_json() -> Column:
    return F.to_json(F.array(*[F.lit(x) for x in ("person", "event_type", "title", "time", "location")]))


def evidence_rows(evidence: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored form of new evidence: what it supports, and the source's trust as the claim."""
    trust = documents.select("document_id", "source_id").join(sources.select("source_id", "trust_level"), "source_id")
    return evidence.join(trust, "document_id", "left").select(
        "event_id", "document_id", "evidence_text", F.lit("text").alias("evidence_locator"),
        supports_json().alias("supports_fields_json"),
        F.to_json(F.struct(F.col("trust_level").alias("source_trust"))).alias("source_claim_json"))
