"""Segments and predicate places of odd texts, and what work their plans do for each of them."""

import re

from annalist import vocab
from annalist.operators import segments as sg


def test_segments_of_odd_texts():
    sentences = re.compile("[^。.]*(?:[。.][”\"]?|$)")

    def units(text):
        return sg.units_of(text, sentences)

    assert units("") == [] and units("short") == []
    assert units("\r\nfirst　\x1c one.”  second one\n\nthird one") == [("first one.”", 1, False), ("second one", 1, False), ("third one", 2, False)]
    assert units("visited A 2024-01-05 visited B 2024年1月6日 visited C") == [
        ("visited A", 0, True), ("2024-01-05 visited B", 0, True), ("2024年1月6日 visited C", 0, True)]
    assert units("国内活动更多>> entry one活动更多>>entry two") == [("entry one", 0, True), ("entry two", 0, True)]
    assert units("in 2024 it was so") == [("in 2024 it was so", 0, False)]


def test_predicates_of_overlapping_words_and_quotes(spark):
    lexicon = vocab.Lexicon(itinerary=("aa",), statement=("said",), other=("ȧ",), sentence_end=".")
    rows = spark.createDataFrame([(1, 0, "AAA said “quoted” İ ȧ"), (2, 0, "")], "document_id long, seg_idx int, text string")
    got = sorted(tuple(r) for r in sg.predicates(rows, lexicon).collect())
    assert got == [(1, 0, "itinerary", 0), (1, 0, "itinerary", 1), (1, 0, "other", 21), (1, 0, "statement", 4), (1, 0, "statement", 9)]


def test_no_pattern_is_compiled_for_each_sentence(spark):
    docs = spark.createDataFrame([(1, "He said so.")], "document_id long, content_text string")
    plan = sg.predicates(sg.segments(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("positions(") == 1 and plan.count("units(") == 1, plan
