"""Search through the trigram index against the scan, over batches, changed rows and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import timeline as tl
from annalist.sources import search_index as si

EVENTS = "event_id long, person_id long, event_type string, title string, summary string, quote_text string, location_name string, review_status string, start_at timestamp"
DOCUMENTS = "document_id long, source_id long, title string, content_text string, published_at timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé会%_😀 İ\n") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: "".join(word() for _ in range(rng.randrange(n)))
    events = [(k, k % 3, "other", prose(6), prose(9) if k % 5 else None, "", prose(3), "rejected" if k % 7 == 0 else "approved", None) for k in range(120)]
    docs = [(k, k % 2, prose(4), prose(60) if k % 9 else None, None) for k in range(120)]
    events, docs = spark.createDataFrame(events, EVENTS), spark.createDataFrame(docs, DOCUMENTS)
    persons = spark.createDataFrame([(0, "Anna Bé"), (1, "会见"), (2, "x")], "person_id long, name string")
    sources = spark.createDataFrame([(0, "s0"), (1, "s1")], "source_id long, name string")
    root = str(tmp_path_factory.mktemp("index"))
    for n in range(3):
        for again in range(2):  # a batch that is written again
            si.index_batch(events.where(F.col("event_id") % 3 == n), "event_id", si.EVENT_TEXTS, root, "events", n)
        si.index_batch(docs.where(F.col("document_id") % 3 == n), "document_id", si.DOCUMENT_TEXTS, root, "documents", n)
    return root, events, persons, docs, sources


QUERIES = ["a", "ab", "abé", "ABÉ", "会%_", "anna", "😀a", "a😀b", "b\na", "İab", "zzz", "ab_", "%a%", "ba会", "aaaaaaaaa", " a "]


@pytest.mark.parametrize("q", QUERIES)
def test_equals_the_scan(spark, tables, q):
    root, *rest = tables
    assert [tuple(r) for r in si.search(q, root, *rest, size=40).collect()] == [tuple(r) for r in tl.search(q, *rest, size=40).collect()]


def test_few_rows_are_read(spark, tables):
    root, _, _, docs, _ = tables
    text = docs.where("document_id = 64").first()["content_text"]
    ids = [r["id"] for r in si.candidates(spark, root, "documents", text[3:15]).collect()]
    assert 64 in ids and len(ids) <= 12


def test_changed_rows_are_found_by_their_new_text(spark, tables, tmp_path):
    _, events, persons, docs, sources = tables
    root = str(tmp_path)
    old = docs.where("document_id < 5")
    new = old.where("document_id = 3").withColumn("title", F.lit("brand new title"))
    si.index_batch(old, "document_id", si.DOCUMENT_TEXTS, root, "documents", 0)
    si.index_batch(new, "document_id", si.DOCUMENT_TEXTS, root, "documents", 1)
    now = old.where("document_id <> 3").unionByName(new)
    found = si.search("new TITLE", root, events.limit(0), persons, now, sources).collect()
    assert [r["id"] for r in found] == [3]


def test_many_candidates_are_joined(spark, tables, monkeypatch):
    root, *rest = tables
    monkeypatch.setattr(si, "NAMED", 1)
    assert si.search("a会", root, *rest).collect() == tl.search("a会", *rest).collect()
    assert si.search("abé", root, *rest).collect() == tl.search("abé", *rest).collect()


def test_no_index_yet(spark, tables, tmp_path):
    _, *rest = tables
    assert si.candidates(spark, str(tmp_path), "documents", "abc").count() == 0


def test_postings_are_lists_and_rows_of_one_id_count_once(spark, tables, tmp_path):
    _, _, _, docs, _ = tables
    root = str(tmp_path)
    twice = docs.where("document_id < 3").select("document_id", F.lit("abcd").alias("title"), F.explode(F.array(F.lit("abc"), F.lit("xyz"))).alias("content_text"))
    si.index_batch(twice.coalesce(1), "document_id", si.DOCUMENT_TEXTS, root, "documents", 0)
    stored = spark.read.parquet(f"{root}/documents_postings").where("gram = 'abc'")
    assert sorted(i for r in stored.collect() for i in r["ids"]) == [0, 1, 2] and stored.count() < 3
    assert [(g, n) for g, _, n in si.rarest(spark, root, "documents", "ABCD")] == [("abc", 3), ("bcd", 3)]
    assert sorted(r["id"] for r in si.candidates(spark, root, "documents", "xyz").collect()) == [0, 1, 2]
