"""Session settings and the lineage cut used by the iterative jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Values that matter for skewed keys and changing sizes; sizes of shuffles are left to AQE.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "annalist", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions in it can run there from wherever
    the driver was started. Spark's own file server hands the archive out."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="annalist-ship-"), "annalist_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names in ``spark.checkpoint.dir``.

    Only a session in one process may fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="annalist-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def is_folder(spark: SparkSession, place: str) -> bool:
    """Is there a folder at a place of any file system that Spark reads?"""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table below the shared checkpoint folder and read it back, so that an
    iterative job can lose executors without recomputing every earlier round.

    A table read back carries its true size and nothing of its plan. A checkpointed frame keeps the
    constraints of its plan, which multiply from round to round.
    """
    spark = df.sparkSession
    place = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut_lineage`` made, when nothing will read it again."""
    context = df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
