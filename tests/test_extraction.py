"""Golden sentences for attribution and extraction, and the checked model path."""

import json

from pyspark.sql import functions as F

from annalist.operators import attribution as at
from annalist.operators import extraction as ex
from annalist.operators import persons as pe
from annalist.operators import repair as rp

def now():
    return F.lit("2026-12-01").cast("timestamp")


DOCS = {
    0: ("会见", "习近平会见柬埔寨首相洪玛奈。会见在上海西郊宾馆举行。习近平表示，中柬友谊历久弥新。习近平获赠纪念品。"),
    1: ("a", "会见中转达了习近平的问候。"), 2: ("b", "双方提到习近平主席重视两国关系。"), 3: ("c", "习近平主席特使王宁会见来访外宾并交换意见。"),
    4: ("d", "扎帕罗夫请王宁转达对习近平主席的亲切问候，表示吉方愿深化合作。"), 5: ("e", "会议学习贯彻习近平重要论述精神，部署下一阶段工作。"),
    6: ("f", "习近平强调，中国共产党在管党治党、兴党强党的伟大实践中形成新时代党建思想。"), 7: ("g", "习近平会见来宾。他表示，中方愿深化合作。"),
    8: ("h", "习近平出席会议，王毅也出席会议。他表示，将推进后续工作。"), 9: ("i", "习近平会见来宾。\n他表示，中方愿深化合作。"),
    10: ("j", "李鸿忠在安徽、河南开展执法检查。他强调，要坚持以习近平总书记关于国家粮食安全重要论述精神为指导。"),
    11: ("k", "王毅或将出席下周论坛。"), 12: ("l", "王毅表示：“这是一句测试引用内容。”"),
}


def tables(spark, docs=DOCS):
    people = spark.createDataFrame([(1, "习近平", True), (2, "王毅", True), (3, "李鸿忠", True)], "person_id long, name string, enabled boolean").withColumn(
        "deleted_at", F.lit(None).cast("timestamp"))
    rows = [(k, 1, t, c, "zh-CN") for k, (t, c) in docs.items()]
    frame = spark.createDataFrame(rows, "document_id long, source_id long, title string, content_text string, language string").withColumn(
        "published_at", F.lit("2026-08-02 16:00:00").cast("timestamp"))
    return people, frame, pe.make_scope(people, None, None)


def test_rule_path(spark):
    _, docs, scope = tables(spark)
    events, verdicts = ex.extract_events(docs, scope, now())
    got = {}
    for r in events.collect():
        got.setdefault(r.document_id, []).append((r.person_id, r.event_type, r.location_name, r.confirmation_status, r.quote_text))
    assert sorted(got[0]) == [(1, "itinerary", "上海西郊宾馆", "completed", ""), (1, "statement", "上海西郊宾馆", "completed", "")]
    assert not {1, 2, 3, 4, 5} & set(got)
    assert got[6] == [(1, "statement", "", "completed", "")]
    assert {x[:2] for x in got[7]} == {(1, "itinerary"), (1, "statement")}
    assert {x[:2] for x in got[8]} == {(1, "itinerary"), (2, "itinerary")}
    assert {x[:2] for x in got[9]} == {(1, "itinerary")}
    assert {x[:3] for x in got[10]} == {(3, "itinerary", "安徽、河南"), (3, "statement", "安徽、河南")}
    assert got[11][0][3] == "expected" and got[12][0][4] == "这是一句测试引用内容。"
    stats = {r.document_id: r for r in at.attribution_stats(verdicts).collect()}
    assert stats[4].target_not_subject >= 1 and stats[8].pronoun_ambiguous == 3
    assert all(r.candidates == r.accepted + r.rejected for r in stats.values())


def test_model_path_and_fallback(spark):
    docs = {0: ("年度奖项", "王毅获颁年度奖项。"), 1: ("会见", "习近平主席特使王宁会见来宾。"), 2: ("x", "王毅出席会议。"), 3: ("y", "习近平会见来宾。他表示，愿深化合作。")}
    _, frame, scope = tables(spark, docs)

    def answer(person, kind, text):
        return json.dumps({"events": [{"person_id": person, "event_type": kind, "title": "t", "evidence_text": text}]}, ensure_ascii=False)

    out = spark.createDataFrame([(0, answer(2, "other", "王毅获颁年度奖项。")), (1, answer(1, "itinerary", "习近平主席特使王宁会见来宾。")), (2, "{broken"),
                                 (3, answer(1, "statement", "他表示，愿深化合作。"))], "document_id long, json string")
    events, verdicts, providers = ex.extract_with_fallback(out, frame, scope, now())
    got = {(r.document_id, r.person_id, r.event_type, str(r.start_at)) for r in events.collect()}
    assert got == {(0, 2, "other", "2026-08-02 16:00:00"), (2, 2, "itinerary", "2026-08-02 16:00:00"), (3, 1, "statement", "2026-08-02 16:00:00")}
    assert {r.document_id: r.reason for r in verdicts.where("not valid").collect()} == {1: "target_not_subject"}
    assert {r.document_id: r.provider for r in providers.collect()} == {0: "external", 1: "external", 2: "local-fallback", 3: "external"}


def test_recheck(spark):
    docs = {0: ("a", "习近平会见来宾。"), 1: ("b", "会见中转达了习近平的问候。")}
    people, frame, scope = tables(spark, docs)
    events = spark.createDataFrame([(1, 1, "itinerary", False), (2, 1, "itinerary", False), (3, 1, "itinerary", True)],
                                   "event_id long, person_id long, event_type string, human_locked boolean")
    evidence = spark.createDataFrame([(1, 1, 0, "习近平会见来宾。"), (2, 1, 1, "会见中转达了习近平的问候。"), (3, 2, 1, "会见中转达了习近平的问候。"),
                                      (4, 3, 1, "会见中转达了习近平的问候。")], "evidence_id long, event_id long, document_id long, evidence_text string")
    sources = spark.createDataFrame([(1, "s")], "source_id long, name string")
    job = rp.recheck_attribution(evidence, events, frame, people, sources, scope)
    r = job.report.first()
    assert (r.invalid_evidence, r.orphan_events, r.kept_events, r.locked_skipped, r.accepted_evidence) == (2, 1, 1, 1, 1)
    rest = rp.without(evidence, job.changes["evidence"], "evidence_id")
    again = rp.recheck_attribution(rest, rp.without(events, job.changes["events"], "event_id"), frame, people, sources, scope).report.first()
    assert again.invalid_evidence == 0


def test_very_many_names_and_none(spark):
    names = spark.range(7000).select(F.col("id").alias("person_id"), F.concat(F.hex("id"), F.lit("-name")).alias("name"), F.lit(True).alias("enabled"),
                                     F.lit(None).cast("timestamp").alias("deleted_at"))
    rows = spark.createDataFrame([(1, "x 1b57-name meets ff-NAME, and nobody")], "document_id long, text string")
    found = pe.find_names(rows, ["document_id"], pe.name_table(names)).select("name", "pos").collect()
    want = {("1B57-name", 2), ("B57-name", 3), ("57-name", 4), ("7-name", 5), ("FF-name", 18), ("F-name", 19)}
    assert {tuple(r) for r in found} == {w for w in want if int(w[0].split("-")[0], 16) < 7000 and not (len(w[0]) > 6 and w[0][0] == "0")}
    assert pe.find_names(rows, ["document_id"], pe.name_table(names.limit(0))).count() == 0


def test_second_analysis_brings_nothing(spark):
    _, frame, scope = tables(spark)
    docs = frame.withColumn("collected_at", F.lit("2026-08-03").cast("timestamp"))
    ids = docs.select("document_id").where("document_id in (0, 6, 7, 8)").unionByName(spark.createDataFrame([(0,), (99,)], "document_id long"))
    res, told, missing = rp.reanalyse_documents(ids, docs, None, None, scope, now())
    first = {r.document_id: r.event_count for r in told.collect()}
    assert first[0] == 2 and set(first) == {0, 6, 7, 8} and [r.document_id for r in missing.collect()] == [99]
    again, told, _ = rp.reanalyse_documents(ids, docs, res.inserts, res.evidence, scope, now())
    assert again.inserts.count() == 0 and again.evidence.count() == 0 and not any(r.event_count for r in told.collect())
    places = [{(r.document_id, r.seg_idx, r.event_id) for r in x.targets.collect()} for x in (res, again)]
    assert places[0] == places[1]
