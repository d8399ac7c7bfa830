"""The delivery ledger. Sending itself is outside: jobs read a table of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx

WAITING = ("pending", "retrying")
ACTIVE = ("pending", "sending", "retrying")


def due_batches(batches: DataFrame, as_of: Column) -> DataFrame:
    return batches.where(F.col("status").isin(*WAITING) & (F.col("next_attempt_at") <= as_of)).orderBy("batch_id")


def safe_error(c: Column, limits: vocab.Limits = vocab.ALL) -> Column:
    """One line without addresses."""
    hidden = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)[^@\\s]+@[^@\\s]+", "[email]")
    return tx.head(F.regexp_replace(hidden, "[\\r\\n]", " "), limits.error)


def apply_outcomes(batches: DataFrame, outcomes: DataFrame, as_of: Column, max_attempts: int = 5,
                   base_seconds: int = 60) -> DataFrame:
    """Fold one outcome per batch (``result``: sent, skipped or failed; ``error``) into the ledger.

    A failure waits base * 2^(n-1) seconds after its n-th attempt and is final at ``max_attempts``.
    """
    out = batches.join(outcomes.select("batch_id", "result", "error"), "batch_id", "left")
    tried = F.col("attempt_count") + 1
    failed, sent, skipped = (F.col("result") == r for r in ("failed", "sent", "skipped"))
    wait = (F.lit(base_seconds) * F.pow(F.lit(2.0), F.col("attempt_count"))).cast("bigint")
    return out.select(
        *[c for c in batches.columns if c not in ("status", "attempt_count", "next_attempt_at", "last_error", "sent_at")],
        F.when(sent, "sent").when(skipped, "skipped").when(failed & (tried >= max_attempts), "failed")
        .when(failed, "retrying").otherwise(F.col("status")).alias("status"),
        F.when(sent | failed, tried).otherwise(F.col("attempt_count")).alias("attempt_count"),
        F.when(failed, F.timestamp_seconds(F.unix_seconds(as_of) + wait)).otherwise(F.col("next_attempt_at"))
        .alias("next_attempt_at"),
        F.when(sent | skipped, "").when(failed, safe_error(F.col("error"))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(sent, as_of).otherwise(F.col("sent_at")).alias("sent_at"),
    )


def apply_item_outcomes(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Items of a sent batch become sent, skipped ones keep their reason."""
    done = batches.where(F.col("status") == "sent").select("batch_id", F.lit(True).alias("done"))
    return items.join(done, "batch_id", "left").withColumn(
        "status", F.when(~F.col("deliverable"), "skipped").when(F.col("done"), "sent").otherwise(F.col("status"))).drop("done")


def recover(batches: DataFrame, as_of: Column) -> DataFrame:
    """After a restart, batches caught while sending are tried again at once."""
    caught = F.col("status") == "sending"
    return batches.withColumn("next_attempt_at", F.when(caught, as_of).otherwise(F.col("next_attempt_at"))).withColumn(
        "status", F.when(caught, "retrying").otherwise(F.col("status")))


def retry(batches: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """Manual retry: only failed batches restart, with their attempts reset."""
    marked = batches.join(chosen.select("batch_id").distinct().withColumn("chosen", F.lit(True)), "batch_id", "left")
    again = F.coalesce("chosen", F.lit(False)) & (F.col("status") == "failed")
    return marked.withColumn("attempt_count", F.when(again, 0).otherwise(F.col("attempt_count"))).withColumn(
        "next_attempt_at", F.when(again, as_of).otherwise(F.col("next_attempt_at"))).withColumn(
        "last_error", F.when(again, "").otherwise(F.col("last_error"))).withColumn(
        "status", F.when(again, "retrying").otherwise(F.col("status"))).drop("chosen")


def run_status(batches: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Status of each run from its batches; runs without any batch are empty."""
    status = F.col("status")
    counts = batches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "sent").alias("sent_count"),
        F.count_if(status == "failed").alias("failed_count"), F.count_if(status.isin(*ACTIVE)).alias("active"))
    if runs is not None:
        counts = runs.select("run_id").join(counts, "run_id", "left").fillna(0)
    sent, failed = F.col("sent_count") > 0, F.col("failed_count") > 0
    verdict = (
        F.when(F.col("total") == 0, "empty")
        .when(F.col("active") > 0, F.when(sent, "sending").otherwise("pending"))
        .when(failed & sent, "partial").when(failed, "failed").when(sent, "sent").otherwise("skipped")
    )
    return counts.select("run_id", verdict.alias("status"), "sent_count", "failed_count")


def deliveries(batches: DataFrame, items: DataFrame, runs: DataFrame, tasks: DataFrame, task_id: int | None = None,
               status: str = "") -> DataFrame:
    """Batches of the per-run ledger with task and item count, for a page ordered by id, newest first."""
    if status:
        if status not in (*ACTIVE, "sent", "failed", "skipped"):
            raise ValueError("unknown delivery status")
        batches = batches.where(F.col("status") == status)
    if task_id is not None:
        runs = runs.where(F.col("task_id") == task_id)
    counts = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (
        batches.join(runs.select("run_id", "task_id"), "run_id")
        .join(tasks.select("task_id", F.col("name").alias("task_name")), "task_id")
        .join(counts, "batch_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    )


def delivery_detail(items: DataFrame, events: DataFrame, persons: DataFrame, batch_id: int | None = None) -> DataFrame:
    if batch_id is not None:
        items = items.where(F.col("batch_id") == batch_id)
    return items.join(events.select("event_id", "person_id", "title", "event_type"), "event_id", "left").join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id", "left").drop("person_id")
