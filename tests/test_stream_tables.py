"""Streams over given tables that are one file, or a folder of files."""

import pytest

from annalist.plans.catalogue import QUERIES
from annalist.plans import resolution_queries  # noqa: F401


@pytest.mark.parametrize("parts", [1, 3])
def test_ingest_of_a_folder_of_files(spark, tmp_path, parts):
    rows = spark.createDataFrame([(k, f"text {k % 7}", "en", f"src{k % 2}") for k in range(40)], "doc_id long, text string, lang string, source string")
    rows.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.document_id for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()) == list(range(14))
