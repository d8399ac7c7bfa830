"""Retiming reads its evidence once, and its counts are those of its change tables."""

import datetime as dt

from pyspark.sql import functions as F

from annalist.functions import similarity as sm
from annalist.operators import repair as rp


def tables(spark, place):
    day = dt.datetime(2024, 1, 5)
    spark.createDataFrame([(n, n, n % 3, f"text {n // 2}") for n in range(12)], "evidence_id long, event_id long, document_id long, evidence_text string").write.parquet(f"{place}/evidence")
    events = spark.createDataFrame(
        [(n, 1, "other", "", day, "UTC", "day", n == 5) for n in range(13)],
        "event_id long, person_id long, event_type string, title string, start_at timestamp, original_timezone string, time_precision string, human_locked boolean")
    events = events.withColumn("dedup_key", sm.dedup_key(F.col("person_id"), F.col("event_type"), F.col("start_at"), F.concat(F.lit("old "), F.col("event_id"))))
    documents = spark.createDataFrame([(0, None, day), (1, None, day), (2, None, None)], "document_id long, published_at timestamp, collected_at timestamp")
    return events, spark.read.parquet(f"{place}/evidence"), documents


def test_counts_are_those_of_the_change_tables(spark, tmp_path):
    job = rp.retime_events(*tables(spark, tmp_path))
    # documents 0 and 1 have a time, so events 0, 1, 3, 4, 6, 7, 9, 10 are proposed; of equal texts on a day the lowest stays
    assert sorted(r[0] for r in job.changes["changed"].select("event_id").collect()) == [0, 3, 4, 6, 9, 10]
    assert sorted(r[0] for r in job.changes["events"].collect()) == [1, 7]
    assert job.report.first().asDict() == {"repaired": 6, "deleted_duplicates": 2, "skipped_locked": 1}


def test_nothing_proposed_counts_zero(spark, tmp_path):
    events, evidence, documents = tables(spark, tmp_path)
    assert rp.retime_events(events, evidence, documents.where("document_id = 2")).report.first().asDict() == {
        "repaired": 0, "deleted_duplicates": 0, "skipped_locked": 1}


def test_evidence_is_read_once(spark, tmp_path):
    job = rp.retime_events(*tables(spark, tmp_path))
    for df in (job.report, job.changes["changed"]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [evidence_id" in line for line in plan.splitlines()) == 1
