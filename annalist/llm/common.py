"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.session import checkpoint_folder, ship

#: A word of a text, for Python, for Java and for DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


def prepare(spark: SparkSession) -> SparkSession:
    """See that the executors have this package."""
    ship(spark)
    return spark


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The columns of exactly these names (``renamed``: new name = name), whatever else ``df`` holds.

    Names are matched by case and by position, so that further columns, also of equal names or names that
    differ in case only, do no harm.
    """
    columns = df.columns
    plain = df.toDF(*(f"_{i}" for i in range(len(columns))))
    wanted = {n: n for n in names} | renamed
    return plain.select(*(F.col(f"_{columns.index(old)}").alias(new) for new, old in wanted.items()))


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str = "part", codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: a cut of the lineage that outlives executors."""
    place = new_folder(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``store`` made, when nothing will read it again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of ``keys``: the same rows on every run. Of a large table only
    rows below a cut-off of the hash, about four times as many as asked for, are put in order."""
    total = df.count()
    place = F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(1 << 40))
    if total > 8 * most:
        df = df.where(place < int(4 * most / total * (1 << 40)))
    return df.orderBy(place, *keys).limit(most)


Batches = Iterator[pa.RecordBatch]


def freed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, which at its end hands the memory that it no longer needs back to the system: Spark
    keeps Python workers for other tasks, and an executor's memory is that of all its idle workers too."""
    def held(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return held


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow array, and the n + 1 offsets of its rows; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``size`` bytes in ``column``, but for a longer row alone."""
    lengths = np.diff(utf8(batch.column(column))[1])
    lo = weight = 0
    for k, n in enumerate(lengths.tolist()):
        if k > lo and (k - lo >= rows or weight + n > size):
            yield batch.slice(lo, k - lo)
            lo, weight = k, 0
        weight += n
    if batch.num_rows:
        yield batch.slice(lo)
