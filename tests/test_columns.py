"""Golden rows for URL, time, cleaning and source columns."""

import datetime as dt

from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import similarity as sm
from annalist.functions import times, urls
from annalist.operators import delivery as dl
from annalist.operators import digest as dg
from annalist.operators import documents as dc
from annalist.operators import extraction as ex
from annalist.sources import feeds as fd
from annalist.sources import links as lk
from annalist.sources import pages as pg


def one(spark, value, column):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in value], ", ".join(
        f"c{i} string" for i in range(len(value[0]) if isinstance(value[0], tuple) else 1)))
    return [r[0] for r in rows.select(column.alias("x")).collect()]


def test_canonical_url(spark):
    got = one(spark, ["HTTPS://Example.COM/news?id=3&utm_source=x#part",
                      "http://big5.www.gov.cn/gate/big5/www.gov.cn/yaowen/content_1.htm", "https://a.com", ""], urls.canonical_url(F.col("c0")))
    assert got == ["https://example.com/news?id=3", "https://www.gov.cn/yaowen/content_1.htm", "https://a.com/", ""]


def test_publication_time(spark):
    rows = [("https://example.com/a", "2026年06月17日12:17 | 来源：新华社"), ("http://people.com.cn/n1/2026/0513/c1.html", "无日期"),
            ("https://www.news.cn/politics/leaders/20260803/c.html", "自2026年10月15日起施行。"), ("https://example.com/post", "自2026年10月15日起施行。"),
            ("https://example.com/post", "李强将于2026年10月15日出席。")]
    got = one(spark, rows, times.seconds_text(times.infer_published_at(F.col("c0"), F.col("c1"))))
    assert got == ["2026-06-17 04:17:00", "2026-05-12 16:00:00", "2026-08-02 16:00:00", None, None]


def test_time_texts(spark):
    got = one(spark, ["Thu, 02 Jul 2026 08:00:00 GMT", "2026-08-03T00:00:00+08:00", "20260803", "2026", "12:30", "2026-02-31"],
              times.seconds_text(times.to_utc_seconds(F.col("c0"))))
    assert got == ["2026-07-02 08:00:00", "2026-08-02 16:00:00", "2026-08-03 00:00:00", None, None, None]


def test_keys_and_similarity(spark):
    a, b = "新华社首尔5月13日电（记者甲 乙）5月13日，韩国总统会见何立峰。", "本报首尔5月13日电 （记者丙、丁）5月13日，韩国总统会见何立峰。"
    keys = one(spark, [a, b], sm.dedup_key(F.lit(1), F.lit("itinerary"), F.lit("2026-05-13").cast("timestamp"), F.col("c0")))
    assert keys[0] == keys[1]
    pair = ("何立峰在人民大会堂会见美国联邦众议员科雷亚及其一行", "国务院副总理何立峰在人民大会堂会见美国众议员科雷亚一行")
    score = one(spark, [pair], sm.ratio_of(sm.normal_core(F.col("c0")), sm.normal_core(F.col("c1"))))[0]
    assert score >= 0.72


def test_limits_cut_only_when_asked(spark):
    long = "会议开始" * 60
    pair = [long + "甲", long + "乙"]
    day = F.lit("2026-05-13").cast("timestamp")
    key = lambda limits: one(spark, pair, sm.dedup_key(F.lit(1), F.lit("other"), day, F.col("c0"), limits))
    assert len(set(key(vocab.ALL))) == 2 and len(set(key(vocab.SMALL))) == 1
    body = "开头" * 3000 + "2026年06月17日12:17"
    dated = lambda limits: one(spark, [body], times.body_published_at(F.col("c0"), limits))[0]
    assert dated(vocab.ALL) is not None and dated(vocab.SMALL) is None


def test_character_references(spark):
    got = one(spark, ["&amp;lt; &#39;&#x4e2d;&eacute;&nosuch; &", "plain", "&#0;&#xD800;"], pg.unescaped(F.col("c0")))
    assert got == ["&lt; '中é&nosuch; &", "plain", "&#0;&#xD800;"]


def test_configured_hosts_lose_their_dots(spark):
    source = [(1, "https://www.example.org/", '{"discovery_enabled":true,"discovery_max_depth":5,"discovery_max_pages":90,"discovery_allowed_hosts":[".Example.org."," "]}')]
    root, = lk.discovery_roots(spark.createDataFrame(source, "source_id long, entry_url string, parser_config string")).collect()
    assert (root.hosts, root.max_pages, root.max_depth) == (["example.org"], 90, 5)
    small, = lk.discovery_roots(spark.createDataFrame(source, "source_id long, entry_url string, parser_config string"), 10, vocab.SMALL).collect()
    assert (small.max_pages, small.max_depth) == (30, 2)


def test_unset_pages_and_depth_are_no_limit(spark):
    """A chain of 5 levels with 20 pages on its first: an article behind each is found, but a small installation stops early."""
    top, nav, art = "https://www.example.org/", "https://www.example.org/list/{}/", "https://www.example.org/a/{}.html"
    links = [(1, top, k, nav.format(k), "list") for k in range(20)] + [(1, nav.format(k), 0, art.format(k), "term") for k in range(24)]
    links += [(1, nav.format(19 + k), 1, nav.format(20 + k), "list") for k in range(4)] + [(1, nav.format(23), 1, nav.format(0), "list")]
    links = spark.createDataFrame(links, "source_id long, page_url string, link_idx int, href string, text string")
    terms = spark.createDataFrame([(1, "term")], "source_id long, term string")
    source = spark.createDataFrame([(1, top, '{"discovery_enabled":true}')], "source_id long, entry_url string, parser_config string")

    def found(limits):
        roots = lk.discovery_roots(source, None, limits)
        return {r["url"] for r in lk.discover_candidates(roots, links, terms, limits=limits).collect()}

    assert found(vocab.ALL) == {art.format(k) for k in range(24)}
    assert found(vocab.SMALL) == {art.format(k) for k in range(11)}


def test_bound_never_hides_a_match():
    import random
    from difflib import SequenceMatcher

    import pandas as pd
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    pairs = [(x, y) for x in texts for y in texts[:20]]
    got = sm.gestalt_ratio.func(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    for (x, y), score in zip(pairs, got):
        true = SequenceMatcher(None, x, y).ratio()
        assert score == true or (score == 0.0 and true < 0.72)


def test_place(spark):
    assert one(spark, ["明在首尔总统府"], ex.normal_place(F.col("c0"))) == ["韩国总统府"]


def test_cleaning(spark):
    title = "万山磅礴看主峰｜习近平谈亚太合作"
    deck = "多年来，习近平主席提出一系列倡议与主张。"
    rows = [
        ("https://news.example.org/a.html", "正式文章标题", "网站首页 产品 新闻 联系我们 " * 20 + "正式文章标题 正文第一段。正文第二段。责任编辑：某某 相关阅读"),
        ("http://politics.people.com.cn/n1/a.html", "何立峰会见代表", "首页 党政 时政 " * 30 + "何立峰会见代表 小字号 新华社北京5月13日电 正文内容。 (责编：甲、乙)"),
        ("https://cn.chinadaily.com.cn/a/1.html", title, f"{title} {deck} 站内搜索 订阅 > 要闻 > {title} 来源 分享到微信 {deck}这是第二段。 【"),
    ]
    got = one(spark, rows, dc.clean_text(F.col("c0"), F.col("c1"), F.col("c2")))
    assert got == ["正式文章标题 正文第一段。正文第二段。", "新华社北京5月13日电 正文内容。", f"{title} {deck} {deck}这是第二段。"]


def test_quality_gate(spark):
    head = "新华网首页 专题首页 最新播报 评论解读 智库报告"
    story = "7月15日，习近平在上海考察。这是习近平来到居民家中了解情况。"
    rows = [("https://www.news.cn/a/1.html", head, head * 3, None), ("https://cn.chinadaily.com.cn/a/WS1.html", "习近平在上海考察", story * 3, "x"),
            ("https://cn.chinadaily.com.cn/china/", "x", story, "x"), ("https://a.org/1.html", "t", "short", "x")]
    df = spark.createDataFrame(rows, "canonical_url string, title string, content_text string, published_at string")
    got = [r[0] for r in df.select(dc.rejection_reason()).collect()]
    assert got[0] and got[1] == "" and got[2] and got[3] == "正文过短"


def test_feed(spark):
    body = """<?xml version="1.0"?><rss version="2.0"><channel><item><title>公开活动</title><link>https://example.com/a?utm_medium=rss</link>
      <description><![CDATA[<p>黄仁勋出席大会。</p><script>bad()</script>]]></description><pubDate>Thu, 02 Jul 2026 08:00:00 GMT</pubDate></item></channel></rss>"""
    feeds = spark.createDataFrame([(1, "https://example.com/rss", body), (2, "u", "<bad")], "source_id long, url string, body string")
    row, = fd.feed_documents(fd.parsed_feeds(feeds)).collect()
    assert row.canonical_url == "https://example.com/a" and row.content_text == "黄仁勋出席大会。" and row.published_at == dt.datetime(2026, 7, 2, 8)
    assert [r.source_id for r in fd.feed_rejects(fd.parsed_feeds(feeds)).collect()] == [2]


def test_digest_windows(spark):
    rules = spark.createDataFrame([(1, "08:30", "previous_calendar_day", 24, True), (2, "08:30", "rolling_hours", 12, True), (3, "21:15", "rolling_hours", 12, True)],
                                  "rule_id long, send_time string, window_mode string, rolling_hours int, enabled boolean")
    dates = rules.select("rule_id", F.lit("2026-07-30").cast("date").alias("scheduled_date"))
    got = {r.rule_id: (r.scheduled_at, r.window_start, r.window_end) for r in dg.digest_windows(rules, dates).collect()}
    d = dt.datetime
    assert got[1] == (d(2026, 7, 30, 0, 30), d(2026, 7, 28, 16), d(2026, 7, 29, 16))
    assert got[2] == (d(2026, 7, 30, 0, 30), d(2026, 7, 29, 12, 30), d(2026, 7, 30, 0, 30))
    after = dg.with_next_run(rules, F.lit("2026-07-30 14:00:00").cast("timestamp")).where("rule_id = 3").first()
    assert after.next_run_at == d(2026, 7, 31, 13, 15)
    due = rules.withColumn("deleted_at", F.lit(None).cast("timestamp")).withColumn("next_run_at", F.lit("2026-07-30 00:30:00").cast("timestamp"))
    row = dg.due_runs(due, F.lit("2026-08-01 01:00:00").cast("timestamp")).where("rule_id = 1").first()
    assert (str(row.scheduled_date), row.missed_count) == ("2026-08-01", 2)


def test_delivery(spark):
    text = one(spark, ["SMTPError: rcpt me@example.com\nrefused"], dl.safe_error(F.col("c0")))[0]
    assert text == "SMTPError: rcpt [email] refused"
    b = spark.createDataFrame([(1, "sending", 0), (2, "sending", 1), (3, "pending", 0)], "batch_id long, status string, attempt_count int").withColumn(
        "next_attempt_at", F.lit("2026-01-01").cast("timestamp")).withColumn("last_error", F.lit("")).withColumn("sent_at", F.lit(None).cast("timestamp"))
    o = spark.createDataFrame([(1, "failed", "x"), (2, "failed", "x"), (3, "sent", "")], "batch_id long, result string, error string")
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r.batch_id: (r.status, r.attempt_count, r.next_attempt_at) for r in dl.apply_outcomes(b, o, now, 2).collect()}
    assert got[1] == ("retrying", 1, dt.datetime(2026, 1, 1, 0, 1)) and got[2][0] == "failed" and got[3][:2] == ("sent", 1)
