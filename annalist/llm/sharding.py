"""Jump consistent hashing: stable keys to shards, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annalist.llm.common import pick, prepare, store


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last bucket that a key reaches when buckets are added one by one up to
    ``shards``. With one more bucket a key stays or goes to the new one."""
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        place[open_] = ahead[open_]
        with np.errstate(over="ignore"):
            state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        share = 2147483648.0 / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[open_] = ((place[open_] + 1) * share).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return place.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column form of ``jump``; a null key counts as key 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf(T.IntegerType())
    def placed(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64).view(np.uint64), shards))

    return placed(F.coalesce(key, F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row in one of ``shards`` shards, and number the rows of each shard without gaps.

    The key is the id: an integer as it is, any other type by its 64-bit hash. A null id is key 0, so all rows
    without an id meet in one shard. A null text has no bytes (size 1, CRC 0), an empty one likewise. Rows of equal
    id share a shard; rows that are equal in id, size and CRC get neighbouring slots in no fixed order, which no
    column shows. An empty table gives no rows. Further columns are ignored. A shard is numbered over many ordered
    ranges at once, whose counts alone are added up, so a shard may hold any share of the rows.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more).
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    whole = isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    placed = (
        rows.select(
            "doc_id", key.alias("_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumn("shard", shard_of(F.col("_key"), shards))
        .withColumn("grown_shard", shard_of(F.col("_key"), shards + 1))
        .drop("_key")
    )
    # Ranges of (shard, id): the row number inside a range comes from its place in the sorted partition.
    ordered = store(
        placed.repartitionByRange("shard", "doc_id", "size", "text_crc32")
        .sortWithinPartitions("shard", "doc_id", "size", "text_crc32")
        .withColumn("_at", F.monotonically_increasing_id()), "shard",
    ).withColumn("_range", F.shiftright("_at", 33))
    counts = ordered.groupBy("shard", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(starts, ["shard", "_range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_at") - F.col("_first")).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 8, id_col: str = "doc_id", files: int = 4) -> None:
    """Write the whole rows below ``folder``, a subfolder ``shard=k`` each, with about ``files`` files in it."""
    prepare(docs.sparkSession)
    clash = [c for c in docs.columns if c.lower() in ("shard", "_deal")]
    if clash:
        raise ValueError(f"rename these columns before writing shards: {clash}")
    placed = docs.withColumn("shard", shard_of(F.col(id_col).cast("long"), shards))
    placed.withColumn("_deal", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(files))).repartition(
        shards * files, "shard", "_deal").drop("_deal").write.partitionBy("shard").parquet(folder)
