"""Links of sources and persons by groups give what their listed pairs give, without listing them to count."""

from pyspark.sql import functions as F

from annalist.operators import persons as pe
from annalist.operators import timeline as tl
from annalist.plans.standins import Tables


def given(spark):
    persons = spark.createDataFrame([(k, f"P{k}", k % 4 != 1) for k in range(12)], "person_id long, name string, enabled boolean").withColumn(
        "deleted_at", F.lit(None).cast("timestamp"))
    groups = pe.GroupLinks(spark.createDataFrame([(s, s % 3) for s in range(5)] + [(9, None)], "source_id long, group_id int"),
                           spark.createDataFrame([(k, k % 2) for k in range(12)] + [(99, 1)], "person_id long, group_id int"))
    return persons, groups


def rows(df):
    return sorted(map(repr, df.collect()))


def test_groups_equal_their_pairs(spark):
    persons, groups = given(spark)
    by_group, by_pair = (pe.make_scope(persons, None, links) for links in (groups, groups.pairs()))
    sources = spark.range(11).withColumnRenamed("id", "source_id")
    assert rows(by_group.sizes(sources)) == rows(by_pair.sizes(sources))
    assert rows(pe.persons_for_source(by_group)) == rows(pe.persons_for_source(by_pair))
    assert rows(by_group.linked.select("source_id", "person_id")) == rows(by_pair.linked)
    assert rows(pe.link_counts(groups)) == rows(pe.link_counts(groups.pairs()))


def test_counting_links_lists_no_pairs(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for counted in (pe.make_scope(t.persons, t.aliases, t.source_persons).sizes(t.sources), tl.source_list(t.sources, t.documents, t.source_persons)):
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        # customers meet a nation's suppliers only after they have been counted
        first = plan.index("c_nationkey")
        assert "Aggregate [group_id" in plan[:first], plan
