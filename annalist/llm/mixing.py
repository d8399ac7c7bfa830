"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annalist.llm.common import WORD, pick, prepare, store

#: numpy's hypergeometric draws take fewer than 1e9 items.
MOST_BLOCKS = 400_000_000


def reshared_targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight; one above ``most`` times its size is set to that, and what it leaves is shared
    again by weight among the others, until none is above."""
    targets: list[float] = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    rest = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        rest -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deal the block quotas of all sources to ``shards`` shards of near equal block counts. Each node of the tree
    gives its left half a multivariate-hypergeometric draw of its quotas; the rest goes right. Rows are shards;
    columns sum to the quotas exactly. Each node has its own seed, so subtrees can be drawn anywhere, in any order."""
    dealt = np.zeros((shards, len(quotas)), np.int64)

    def node(at: int, lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            dealt[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, at]).multivariate_hypergeometric(have, take, method="marginals")
        node(2 * at, lo, mid, left)
        node(2 * at + 1, mid, hi, have - left)

    if len(quotas):
        node(1, 0, shards, np.asarray(quotas, np.int64))
    return dealt


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        shards: int = 16, seed: int = 7, block_words: int = 4096, least_blocks: int = 1024, bucket_rows: int = 2_000,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Plan a mix: how often, and into which shards, each row goes.

    Size: words of the text (null or empty: 0). Sources in code-point order, null last, take ``weights`` in turn, and
    share ``share`` times all words; no target exceeds ``most`` times its source's size (see ``reshared_targets``).
    Each source is put into a keyed random order and cut into blocks of equal width in words; a row belongs to the
    block that holds its middle. A source's quota is the number of blocks nearest to its target; beyond one pass, its
    blocks start again. ``split_tree`` deals the quotas to the shards; shard j draws the next quota[j] blocks of the
    order, so draws are disjoint, and ``shuffled`` orders a shard's rows by a keyed hash.

    Rows of size 0 are drawn like others and add nothing. Rows of equal id and text are told apart by nothing, so
    which of them is drawn shows in no column. Extra columns are ignored unless named in ``carry``; an empty table
    gives no rows. The driver holds one row per source (a catalogue of sources; the shards x sources quotas likewise);
    rows of one source are summed in buckets of about ``bucket_rows``, so a source may hold any share of all rows.

    Returns doc_id, source, size, source_size, target, draws (array of (pass, shard)), and ``carry``.
    """
    spark = prepare(docs.sparkSession)
    rows = pick(docs, **{"doc_id": id_col, "text": text_col, "source": source_col},
                **{f"_kept_{i}": c for i, c in enumerate(carry)})
    kept = [f"_kept_{i}" for i in range(len(carry))]
    sized = rows.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text", F.lit(seed)).alias("_tie"), *kept,
    ).withColumn("_u", F.pmod(F.xxhash64("doc_id", "_tie", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    sized = store(sized, "mix")
    found = sorted(
        ((r["source"], int(r["words"]), int(r["n"])) for r in
         sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()),
        key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [x[1] for x in found]
    targets = reshared_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share * sum(sizes), most)
    width = max(block_words, math.ceil(most * sum(sizes) / MOST_BLOCKS))
    blocks = [max(least_blocks, math.ceil(s / width)) if s else 1 for s in sizes]
    quotas = np.array([round(t / s * b) if s else 0 for s, t, b in zip(sizes, targets, blocks)], np.int64)
    ends = split_tree(quotas, shards, seed).cumsum(axis=0) if len(found) else np.zeros((shards, 0), np.int64)

    schema = T.StructType([
        T.StructField("_name", T.StringType()), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("_blocks", T.LongType()),
        T.StructField("_quota", T.LongType()), T.StructField("_buckets", T.LongType()),
        T.StructField("_ends", T.ArrayType(T.LongType())),
    ])
    plan = spark.createDataFrame(
        [(f[0], s, t, b, int(q), max(1, f[2] // bucket_rows), [int(x) for x in ends[:, i]])
         for i, (f, s, t, b, q) in enumerate(zip(found, sizes, targets, blocks, quotas))], schema)
    if len(found) * shards <= 1_000_000:  # at most some MB
        plan = F.broadcast(plan)
    placed = sized.join(plan, F.col("source").cast("string").eqNullSafe(F.col("_name"))).drop("_name").withColumn(
        "_bucket", F.floor(F.col("_u") * F.col("_buckets")))

    # The words before a row in its source's order: whole buckets before, then rows before in its bucket.
    sums = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_u", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    middle = F.col("_base") + F.col("_in") + F.col("size") / 2.0
    block = F.when(F.col("source_size") > 0, F.least(
        F.floor(middle * F.col("_blocks") / F.col("source_size")), F.col("_blocks") - 1)).otherwise(F.lit(0)).cast("long")
    passes = math.ceil(most) + 1
    draws = F.filter(
        F.transform(F.array(*(F.lit(p) for p in range(passes))), lambda p: F.struct(
            p.alias("pass"), F.size(F.filter("_ends", lambda e: e <= F.col("_block") + p * F.col("_blocks"))).alias("shard"))),
        lambda d: F.col("_block") + d["pass"] * F.col("_blocks") < F.col("_quota"))
    return summed.withColumn("_block", block).select(
        "doc_id", "source", "size", "source_size", "target", draws.alias("draws"),
        *(F.col(k).alias(c) for k, c in zip(kept, carry)))


def shuffled(planned: DataFrame, seed: int = 7) -> DataFrame:
    """One row per draw (pass, shard instead of draws), each shard together and in a keyed random order of its own."""
    rows = planned.select("*", F.explode("draws").alias("_draw")).drop("draws").select("*", "_draw.pass", "_draw.shard").drop("_draw")
    key = F.xxhash64("doc_id", "pass", "shard", F.lit(seed))
    # Ranges of (shard, key): a large shard is many ordered files.
    return rows.withColumn("_key", key).repartitionByRange("shard", "_key").sortWithinPartitions("shard", "_key").drop("_key")
