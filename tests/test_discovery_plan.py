"""Links are taken out of the pages once, before the steps that count them."""

from annalist.plans import catalogue

catalogue.load()


def test_no_step_of_the_statistics_reads_the_markup_again(spark, tmp_path):
    page = '<html><body><a href="/news/The-first.html">The first</a><a href="https://example.org/a/b.html">other</a></body></html>'
    spark.createDataFrame([(k, f"https://example.org/{k}", page) for k in range(3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = catalogue.QUERIES["discovery_statistics"](spark, str(tmp_path))
    assert "html:string" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.select("source_id", "links_extracted").collect()) == [(0, 4), (1, 4), (2, 2)]
