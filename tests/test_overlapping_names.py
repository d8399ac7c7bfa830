"""A name that overlaps itself owns a predicate from its last place, where the scope says so."""

from pyspark.sql import functions as F

from annalist.operators import attribution as at
from annalist.operators import persons as pe
from annalist.plans.extraction_queries import LEX


def owners(spark, gap, **rule):
    people = spark.createDataFrame([(2, "That", True)], "person_id long, name string, enabled boolean").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    rows = spark.createDataFrame([(1, 0, 1, "thathat" + "x" * gap + " for")], "document_id long, seg_idx int, source_id long, text string")
    return at.unique_owner(rows, at.KEYS, pe.make_scope(people, None, None, **rule), LEX).count()


def test_last_place_of_an_overlapping_name_is_close_enough(spark):
    # the predicate is at most 72 characters behind the second place, but more behind the first one
    assert [owners(spark, k, overlapping=True) for k in (68, 69, 71, 72)] == [1, 1, 1, 0]
    assert [owners(spark, k) for k in (68, 69, 71, 72)] == [1, 0, 0, 0]


def test_queries_count_every_place_as_their_sql(spark, tmp_path):
    from annalist.plans.catalogue import QUERIES
    spark.createDataFrame([(0, "xxxxx thathat" + "x" * 70 + " for it now.", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["unique_owners"](spark, str(tmp_path)).collect()] == [(0, 0, 2)]
