"""Names in texts by the automaton and by the join, against a plain search, and how both grow with the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from annalist.operators import attribution as at
from annalist.operators import persons as pe


def people(spark, names):
    rows = [(k, n, k % 3 != 2) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "person_id long, name string, enabled boolean").withColumn("deleted_at", F.lit(None).cast("timestamp"))


def places(text, name):
    low, name = text.lower(), name.strip().lower()
    return [k for k in range(len(low)) if name and low.startswith(name, k)]


NAMES = ["王毅", "王", "毅王毅", "Anna", "ann", "nan", " Li ", "aa", "x", "élan", "O'Neil", "😀a", "   "]


def corpus(seed):
    rng = random.Random(seed)
    parts = ["王毅", "王", "毅", "Anna", "ANN", "nan", "li", "a", "x", " ", "é", "Élan", "o'neil", "😀", "\n"]
    return [None, "", "aaaa"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(80)]


@pytest.mark.parametrize("find", [pe.find_names, pe.join_names])
def test_every_occurrence_of_every_name(spark, find):
    texts = corpus(1)
    rows = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    names = pe.name_table(people(spark, NAMES))
    got = sorted((r["document_id"], r["person_id"], r["pos"]) for r in find(rows, ["document_id"], names).collect())
    assert got == sorted((k, p, i) for k, t in enumerate(texts) for p, n in enumerate(NAMES) for i in places(t or "", n))


def test_scope_in_the_row_equals_the_join(spark, monkeypatch):
    persons = people(spark, NAMES)
    links = spark.createDataFrame([(1, 0), (1, 3), (2, 2), (3, 5)], "source_id long, person_id long")
    texts = corpus(2)
    rows = spark.createDataFrame([(k, k % 5, k % 7, t or "", False) for k, t in enumerate(texts)], "document_id long, source_id long, target long, text string, led boolean")

    def found(target):
        scope = pe.make_scope(persons, None, links)
        out = at.with_mentions(rows, ["document_id"], scope, target).collect()
        return {r["document_id"]: sorted((m["person_id"], m["rank"], m["name"], m["pos"]) for m in r["found"]) for r in out}

    for target in (None, "target"):
        own = found(target)
        monkeypatch.setattr(pe, "MOST_NAMES", 1)
        assert found(target) == own and any(own.values())
        monkeypatch.setattr(pe, "MOST_NAMES", 200_000)


def test_no_names(spark):
    rows = spark.createDataFrame([(1, "abc")], "document_id long, text string")
    assert pe.find_names(rows, ["document_id"], pe.name_table(people(spark, ["  "]))).count() == 0


def test_work_is_linear_in_the_text(spark):
    names = pe.name_table(people(spark, ["Mr Fox", "王毅"]))
    known = pe.known_names(names)
    filler = "some words of no name 王 " * 20

    def took(size):
        text = (filler * (size // len(filler) + 1))[:size] + "mr fox"
        rows = spark.createDataFrame([(1, text)], "document_id long, text string").cache()
        rows.count()
        best = 9e9
        for _ in range(3):
            begin = time.perf_counter()
            assert pe.find_names(rows, ["document_id"], names, known=known).count() == 1
            best = min(best, time.perf_counter() - begin)
        return best

    small, large = took(100_000), took(2_000_000)
    assert large < 20 * small + 2
