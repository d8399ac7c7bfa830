"""Joins of the near-duplicate operator never go through the driver, however small Spark takes their sides for."""

import pytest

from annalist.llm import graph, jaccard


@pytest.mark.parametrize("run", [jaccard.join, jaccard.keep_one])
def test_no_step_sends_a_table_through_the_driver(spark, monkeypatch, run):
    plans = []

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *more)

    def stars(edges):
        chained.append(True)
        return was(edges)

    stored, was, chained = graph.store, graph._is_stars, []
    monkeypatch.setattr(graph, "store", seen)
    monkeypatch.setattr(jaccard, "store", seen)
    monkeypatch.setattr(graph, "_is_stars", stars)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[:k] + ["x"] + words[k:]) for k in (1, 39)] + [" ".join(words)] * 2 + ["other text", None]
    out = run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert chained and len(plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
