"""A posting table of trigrams beside the events and documents, appended batch by batch, and the search over it.

A row holds a trigram and ids of rows with it, as many as one Arrow batch of texts brought, and lies in the bucket of its trigram,
in order, so that a read for one trigram touches one bucket and the row groups that hold it. A text that holds the searched one holds all its trigrams; those of the fewest rows are
intersected, and what is left is searched exactly. Rows that changed are appended again; a posting of an older version can only
bring a candidate that the exact search drops.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import vocab
from annalist.operators import timeline as tl
from annalist.session import ship
from annalist.sources import tables as tb

EVENT_TEXTS, DOCUMENT_TEXTS = ("title", "summary", "quote_text", "location_name"), ("title", "content_text")
#: Buckets of the posting table, rarest trigrams that are intersected, and candidates that are named to the scan.
BUCKETS, RAREST, NAMED = 64, 4, 1000


def grams(text: str | None) -> set[str]:
    """The different trigrams of a text in lower case."""
    low = (text or "").lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids) of the rows (id, texts) of each batch."""
    for batch in batches:
        ids: dict[str, list[int]] = {}
        for key, texts in zip(batch.column("id").to_pylist(), batch.column("texts")):
            for gram in set().union(*map(grams, texts.as_py())):
                ids.setdefault(gram, []).append(key)
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.list_(pa.int64()))], ["gram", "ids"])


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def index_batch(rows: DataFrame, key: str, texts: Sequence[str], root: str, table: str, batch_id: int, spread: int = 16) -> None:
    """Append the postings of a batch's new or changed rows, and how many rows hold each trigram.

    A batch that is written again leaves the same postings. A trigram that most rows hold is dealt to ``spread`` tasks by its first id.
    Null texts have no trigrams, nor have texts of fewer than three characters.
    """
    ship(rows.sparkSession)
    told = rows.select(F.col(key).cast("long").alias("id"), F.array(*texts).alias("texts"))
    if not told.groupBy("id").count().where("count > 1").isEmpty():  # several rows of an id count once for a trigram
        told = told.groupBy("id").agg(F.flatten(F.collect_list("texts")).alias("texts"))
    lists = told.mapInArrow(_gathered, "gram string, ids array<long>").withColumn("bucket", bucket_of(F.col("gram")))
    placed = lists.repartition("bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(spread))).sortWithinPartitions("bucket", "gram", F.get("ids", F.lit(0)))
    place = f"{root}/{table}_postings/batch_id={batch_id}"
    placed.write.mode("overwrite").partitionBy("bucket").parquet(place)
    stored = rows.sparkSession.read.schema("gram string, ids array<long>, bucket int").parquet(place)
    counts = stored.groupBy("gram", "bucket").agg(F.sum(F.size("ids")).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{table}_grams/batch_id={batch_id}")


def rarest(spark: SparkSession, root: str, table: str, q: str) -> list[tuple[str, int, int]] | None:
    """(trigram, bucket, rows) of the rarest trigrams of a text, the rarest first; none if some trigram is nowhere. A search
    text has 200 characters at most, so this reads as many rows."""
    wanted = spark.createDataFrame([(g,) for g in sorted(grams(q))], "gram string").withColumn("bucket", bucket_of(F.col("gram"))).collect()
    counts = tb.read_before(spark, root, f"{table}_grams")
    if counts is None:
        return None
    inside = F.col("bucket").isin(sorted({r["bucket"] for r in wanted})) & F.col("gram").isin([r["gram"] for r in wanted])
    rows = counts.where(inside).groupBy("gram", "bucket").agg(F.sum("n").alias("n")).collect()
    if len(rows) < len(wanted):
        return None
    return sorted(((r["gram"], r["bucket"], r["n"]) for r in rows), key=lambda r: (r[2], r[0]))[:RAREST]


def candidates(spark: SparkSession, root: str, table: str, q: str) -> DataFrame | None:
    """Ids of rows that hold the rarest trigrams of a text of three characters or more; None: a scan is needed."""
    if len(q) < 3:
        return None
    few = rarest(spark, root, table, q)
    if few is None:
        return spark.createDataFrame([], "id long")
    postings = tb.read_before(spark, root, f"{table}_postings")
    assert postings is not None
    ids = None
    for gram, bucket, _ in few:
        own = postings.where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select(F.explode("ids").alias("id")).distinct()
        ids = own if ids is None else ids.join(own, "id", "left_semi")
    return ids


def narrowed(rows: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """The rows of these ids. Few ids are named to the scan, which then skips what lies outside; more of them are joined."""
    if ids is None:
        return rows
    some = [r[0] for r in ids.limit(NAMED + 1).collect()]
    return rows.where(F.col(key).isin(some)) if len(some) <= NAMED else rows.join(ids.withColumnRenamed("id", key), key, "left_semi")


def search(q: str, root: str, events: DataFrame, persons: DataFrame, documents: DataFrame, sources: DataFrame,
           size: int = 30, limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """The rows of ``timeline.search`` through the index below ``root`` (tables "events" and "documents").

    Persons are few: the events of those whose name holds the text are candidates too. Texts of one or two
    characters are searched by a scan.
    """
    spark = events.sparkSession
    ids = candidates(spark, root, "events", q)
    if ids is not None:
        by_name = persons.where(tl.matches(q, "name")).select("person_id")
        named = events.join(by_name, "person_id", "left_semi").select(F.col("event_id").alias("id"))
        ids = ids.unionByName(named).distinct()
    return tl.search(q, narrowed(events, "event_id", ids), persons, narrowed(documents, "document_id", candidates(spark, root, "documents", q)),
                     sources, size, limits)
