"""Catalogue entries for sources and document preparation, on the given pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import times, urls
from annalist.functions import text as tx
from annalist.operators import documents as dc
from annalist.plans.catalogue import query
from annalist.plans.standins import Tables
from annalist.session import cut_lineage
from annalist.sources import feeds as fd
from annalist.sources import links as lk
from annalist.sources import pages as pg

_F = "'%Y-%m-%d %H:%M:%S'"
_CANON = """regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_[^&]*&?', '?'), '[?]$', '')"""
# the given pages: markup without scripts, then text nodes between tags, white space collapsed
_NODES = """nodes AS (SELECT page_id, [y for y in [trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
  '&amp;', '&'), '\\s+', ' ', 'g')) for x in string_split(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', chr(1), 'gs'),
  '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(1), 'gs'), '<[!/a-zA-Z][^>]*>', chr(1), 'g'), chr(1))] if y <> ''] n, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&middot;', '·'),
  '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) title FROM pages)"""


def _pages(t: Tables) -> DataFrame:
    return t.raw("pages").select((F.col("page_id") % 20).alias("source_id"), "page_id", "url", "html")


@query("canonical_urls", f"SELECT page_id, {_CANON} canonical_url FROM pages")
def canonical_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("navigation_links", """SELECT page_id, CASE WHEN p IN ('', '/') THEN true WHEN p LIKE '%/' THEN regexp_matches(p, 'news|politics|government|gov|leadership|current|list|index')
 WHEN p LIKE '%.html' THEN false ELSE regexp_matches(p, 'list|index|channel|search|news|politics|gov') END is_navigation
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) p FROM pages)""")
def navigation_links(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.looks_like_navigation(F.col("url"), F.lit("")).alias("is_navigation"))


@query("page_text", f"WITH {_NODES} SELECT page_id, title, array_to_string(n, chr(10)) body FROM nodes")
def page_text(t: Tables) -> DataFrame:
    return _pages(t).select("page_id", pg.page_parts(F.col("html")).alias("p")).select("page_id", "p.title", "p.body")


@query("page_text_native", f"WITH {_NODES} SELECT page_id, title, array_to_string(n, chr(10)) body FROM nodes")
def page_text_native(t: Tables) -> DataFrame:
    return _pages(t).select("page_id", pg.page_parts(F.col("html")).alias("p")).select("page_id", "p.title", "p.body")


@query("page_documents", f"""WITH {_NODES} SELECT (page_id % 20)::BIGINT source_id, {_CANON} canonical_url, title,
  array_to_string(n, ' ') content_text, false cleaned FROM nodes JOIN pages USING (page_id)""")
def page_documents(t: Tables) -> DataFrame:
    return pg.page_documents(_pages(t)).select("source_id", "canonical_url", "title", "content_text", "cleaned")


@query("article_documents", f"""WITH {_NODES} SELECT {_CANON} canonical_url, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id ELSE title END title,
  CASE WHEN page_id % 3 = 0 THEN 'extracted body ' || page_id ELSE array_to_string(n, ' ') END content_text,
  CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN '2024-02-03 01:00:00' END published_at FROM nodes JOIN pages USING (page_id)""")
def article_documents(t: Tables) -> DataFrame:
    pages = _pages(t)
    k = F.col("page_id")
    extracted = pages.where(k % 3 == 0).select(
        "page_id", "url", F.concat(F.lit("T"), k).alias("title"), F.concat(F.lit(" extracted   body "), k).alias("content"), F.lit("A").alias("author"),
        F.when(k % 2 == 0, F.lit("2024-02-03T09:00:00+08:00")).otherwise("").alias("date"))
    return pg.article_documents(extracted, pages).select(
        "canonical_url", "title", "content_text", times.seconds_text(F.col("published_at")).alias("published_at"))


@query("feed_documents", f"""SELECT page_id source_id, k::INT entry_index, 'https://f.example.org/a/' || page_id || '-' || k canonical_url,
  'Entry ' || k || ' & more' title, 'author ' || k author, strftime(TIMESTAMP '2026-07-02 08:00:00' + to_days(k::INT), {_F}) published_at,
  regexp_extract(url, '//([^/]*)', 1) content_text FROM pages, unnest(range(0, 1 + page_id % 3)) r(k)""")
def feed_documents(t: Tables) -> DataFrame:
    """Feeds written from the pages table: one to three entries each, the page's host as the text."""
    k = F.col("page_id")
    host = F.col("host")
    entry = lambda i: F.concat(
        F.lit("<item><link>/a/"), k, F.lit("-"), i, F.lit("?utm_source=x</link><title>Entry "), i, F.lit(" &amp;amp; more</title><description>&lt;p&gt;"),
        host, F.lit("&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;</description><author>author "), i, F.lit("</author><pubDate>"),
        F.date_format(F.timestamp_seconds(F.lit(1782979200) + i * 86400), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    body = F.concat(F.lit('<rss xmlns:x="u"><channel>'), F.array_join(F.transform(F.sequence(F.lit(0), k % 3), entry), ""), F.lit("</channel></rss>"))
    pages = t.raw("pages").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).drop("url")
    feeds = pages.select(k.alias("source_id"), F.concat(F.lit("https://f.example.org/"), k).alias("url"), body.alias("body"))
    return fd.feed_documents(fd.parsed_feeds(feeds)).withColumn("published_at", times.seconds_text(F.col("published_at")))


_LINKS = """links AS (SELECT page_id, url page_url, idx - 1 link_idx, regexp_extract(h, 'href="([^"]*)"', 1) href, regexp_extract(h, '>([^<]*)<', 1) txt
 FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) h, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) idx FROM pages))"""


def _links(t: Tables) -> DataFrame:
    return t.raw("pages").select(
        F.col("page_id").alias("source_id"), F.col("url").alias("page_url"),
        F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("link_idx", "h")).select(
        "source_id", "page_url", "link_idx", F.regexp_extract("h", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("h", ">([^<]*)<", 1).alias("text"))


def _roots(t: Tables) -> DataFrame:
    src = t.raw("pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("entry_url"),
                                F.lit('{"discovery_enabled":true,"discovery_max_depth":2}').alias("parser_config"))
    return lk.discovery_roots(src, 2)


@query("same_site_links", f"""WITH {_LINKS} SELECT page_id source_id, link_idx::INT link_idx, regexp_extract(page_url, '^https?://[^/]*', 0) || href url FROM links""")
def same_site_links(t: Tables) -> DataFrame:
    return lk.same_site_links(_links(t), _roots(t)).select("source_id", "link_idx", "url")


@query("discover_candidates", f"""WITH {_LINKS}, hits AS (SELECT page_id, regexp_extract(page_url, '^https?://[^/]*', 0) || href u, min(link_idx) i FROM links
 WHERE (contains(lower(txt || ' ' || regexp_extract(page_url, '^https?://[^/]*', 0) || href), 'the') OR contains(lower(txt || ' ' || regexp_extract(page_url, '^https?://[^/]*', 0) || href), 'ing'))
 AND lower(href) <> '/' AND NOT regexp_matches(lower(href), 'list|index|channel|search|news|politics|gov') GROUP BY ALL)
SELECT page_id source_id, u url, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT rank FROM hits) WHERE rank <= 2""")
def discover_candidates(t: Tables) -> DataFrame:
    terms = t.raw("pages").select(F.col("page_id").alias("source_id"), F.explode(F.array(F.lit("The"), F.lit("ing"))).alias("term"))
    links = _links(t).withColumn("page_url", urls.canonical_url(F.col("page_url")))
    return lk.discover_candidates(_roots(t), links, terms, 2)


_HOST = "regexp_extract({0}, '^https?://[^/]*', 0)"
_NAV = "(lower({0}) = '/' OR regexp_matches(lower({0}), 'list|index|channel|search|news|politics|gov'))"
_WALK = f"""{_LINKS}, site AS (SELECT l.page_id, {_HOST.format('page_url')} || href u, link_idx i, href, txt FROM links l WHERE href <> '/'),
hits AS (SELECT page_id, u, min(i) i FROM site WHERE (contains(lower(txt || ' ' || u), 'the') OR contains(lower(txt || ' ' || u), 'ing')) AND NOT {_NAV.format('href')} GROUP BY ALL),
extra AS (SELECT p.page_id, {_HOST.format('p.url')} || l.href u, min(l.link_idx) i FROM links l JOIN pages p ON p.page_id = l.page_id - 1 WHERE NOT {_NAV.format('l.href')} GROUP BY ALL),
found AS (SELECT page_id, u, 0 part, i FROM hits UNION ALL SELECT page_id, u, 1, i FROM extra WHERE (page_id, u) NOT IN (SELECT page_id, u FROM hits))"""


def _single_pages(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Roots that are read alone, their links, search result pages that hold the links of the next page, and terms."""
    src = t.raw("pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("entry_url"),
                                F.lit('{"discovery_enabled":true,"discovery_max_depth":0}').alias("parser_config"))
    # many steps read the links and the roots, and taking them out of the pages costs most, so they are stored once
    links = cut_lineage(_links(t).withColumn("page_url", urls.canonical_url(F.col("page_url"))))
    own = t.raw("pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("page_url"))
    searched = links.drop("page_url").withColumn("source_id", F.col("source_id") - 1).join(own, "source_id")
    terms = own.select("source_id", F.explode(F.array(F.lit("The"), F.lit("ing"))).alias("term"))
    return cut_lineage(lk.discovery_roots(src)), links, searched, terms


@query("search_candidates", f"""WITH {_WALK} SELECT page_id source_id, u url, row_number() OVER (PARTITION BY page_id ORDER BY part, i)::INT AS rank FROM found""")
def search_candidates(t: Tables) -> DataFrame:
    """All candidates of every source: those of its own page, then those of its search page, which need no term."""
    roots, links, searched, terms = _single_pages(t)
    return lk.discover_candidates(roots, links, terms, None, searched)


@query("search_pages", """SELECT page_id source_id, CASE page_id % 4 WHEN 0 THEN 'https://own.example.org/?q=' WHEN 1 THEN 'http://search.people.cn/s/?keyword=' ELSE 'https://so.news.cn/#search/0/' END ||
 CASE WHEN page_id % 2 = 0 THEN url_encode('习近平 ' || page_id) ELSE url_encode(lower('Ann*~' || page_id)) END || CASE WHEN page_id % 4 = 2 THEN '/1/0' ELSE '' END search_url
FROM pages WHERE page_id % 4 <> 3""")
def search_pages(t: Tables) -> DataFrame:
    """Search addresses: a template of the source's own, two listed sites, and a site without search."""
    k = F.col("source_id")
    pages = t.raw("pages").select(F.col("page_id").alias("source_id"))
    entry = F.when(k % 4 == 1, "http://politics.people.com.cn/a").when(k % 4 == 2, "https://www.news.cn/").otherwise("https://example.org/")
    config = F.when(k % 4 == 0, '{"discovery_enabled":true,"discovery_search_url_template":"https://own.example.org/?q={query}"}').otherwise('{"discovery_enabled":true}')
    names = F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit(" Ann*~"), k).alias("term")),
                    F.struct(F.lit(2).alias("rank"), F.when(k % 2 == 0, F.concat(F.lit("习近平 "), k)).otherwise("other").alias("term")))
    terms = pages.select("source_id", F.explode(names).alias("n")).select("source_id", "n.rank", "n.term")
    return lk.search_pages(pages.select("source_id", entry.alias("entry_url"), config.alias("parser_config")), terms)


@query("discovery_statistics", f"""WITH {_WALK}, n AS (SELECT page_id, count(*) n FROM links GROUP BY 1),
c AS (SELECT page_id, count(*) n FROM found GROUP BY 1), s AS (SELECT page_id, count(*) n FROM site GROUP BY 1)
SELECT p.page_id source_id, (coalesce(n.n, 0) + coalesce(m.n, 0))::BIGINT links_extracted, coalesce(s.n, 0)::BIGINT same_site_links, coalesce(c.n, 0)::BIGINT candidates,
 1::BIGINT pages_scanned, (p.page_id < (SELECT max(page_id) FROM pages))::BIGINT search_pages, 1::BIGINT articles_fetched, (p.page_id % 3 <> 0)::BIGINT accepted,
 (p.page_id % 3 = 1)::BIGINT cleaned_accepted, (p.page_id % 3 = 0)::BIGINT rejected, CASE WHEN p.page_id % 3 = 0 THEN 'r' || p.page_id % 2 ELSE '' END reason,
 (p.page_id % 13)::BIGINT errors_seen, least(p.page_id % 13, 10)::INT shown, CASE WHEN p.page_id % 13 > 0 THEN '0 ' || repeat('x', 198) ELSE '' END first_error
FROM pages p LEFT JOIN n ON n.page_id = p.page_id LEFT JOIN n m ON m.page_id = p.page_id + 1 LEFT JOIN c ON c.page_id = p.page_id LEFT JOIN s ON s.page_id = p.page_id""")
def discovery_statistics(t: Tables) -> DataFrame:
    """All counts of a discovery run, with pages scanned, search pages and messages."""
    roots, links, searched, terms = _single_pages(t)
    k = F.col("source_id")
    site = lk.same_site_links(links, roots).join(roots.select("source_id", "root_url"), "source_id").where("url <> root_url")
    documents = roots.select("source_id", F.when(k % 3 == 0, F.concat(F.lit("r"), k % 2)).otherwise("").alias("reject_reason"), (k % 3 == 1).alias("cleaned"))
    errors = roots.select("source_id", F.explode(F.sequence(F.lit(1), k % 13)).alias("place")).where((k % 13 > 0)).withColumn(
        "message", F.concat((F.col("place") - 1).cast("string"), F.lit(" "), F.repeat(F.lit("x"), 300)))
    out = lk.discovery_stats(links.select("source_id").unionByName(searched.select("source_id")), site, lk.discover_candidates(roots, links, terms, None, searched), documents,
                             documents.where("reject_reason = ''"), roots, searched.select("source_id").distinct(), errors)
    return out.withColumn("reason", F.coalesce(F.array_join(F.map_keys("rejection_reasons"), ","), F.lit(""))).withColumn(
        "shown", F.coalesce(F.size("errors"), F.lit(0))).withColumn("first_error", F.coalesce(F.get("errors", F.lit(0)), F.lit(""))).drop("rejection_reasons", "errors")


@query("relevant_documents", """SELECT document_id FROM tl_articles WHERE
 (source_id % 2 = 0 AND contains(lower(title || ' ' || content_text), 'theerly')) OR contains(lower(title || ' ' || content_text), 'ithi')""")
def relevant_documents(t: Tables) -> DataFrame:
    docs = t.articles
    ids = t.articles.select("source_id").distinct()
    terms = ids.where("source_id % 2 = 0").select("source_id", F.lit("Theerly").alias("term")).unionByName(
        ids.select("source_id", F.lit("ithi").alias("term")))
    return lk.relevant_documents(docs, terms).select("document_id")


@query("publication_times", f"""WITH d AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'u' WHEN 1 THEN 'c' WHEN 2 THEN 's' WHEN 3 THEN 'b' ELSE 'f' END kind FROM events)
SELECT event_id, CASE kind WHEN 'f' THEN NULL WHEN 'b' THEN strftime(date_trunc('minute', ts) - INTERVAL 8 HOUR, {_F}) ELSE strftime(ts::DATE::TIMESTAMP - INTERVAL 8 HOUR, {_F}) END published_at FROM d""")
def publication_times(t: Tables) -> DataFrame:
    """URL days in three forms, a body date with time, and an announced future date."""
    e = t.raw("events")
    day = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 5
    url = F.concat(F.lit("https://example.org/n/"), F.when(k == 0, day("yyyyMMdd")).when(k == 1, day("yyyy/MM/dd")).when(k == 2, day("yyyy/MMdd"))
                   .otherwise("20241399"), F.lit("/a"))
    body = F.when(k == 3, F.concat(F.lit("前言 "), day("yyyy年MM月dd日 HH:mm"), F.lit(" 来源"))).when(
        k == 4, F.concat(F.lit("自"), day("yyyy年MM月dd日"), F.lit("起施行。将于"), day("yyyy-MM-dd"), F.lit("出席"))).otherwise("2001年01月01日")
    rows = e.select("event_id", url.alias("url"), body.alias("body"))
    return rows.select("event_id", times.seconds_text(times.infer_published_at(F.col("url"), F.col("body"))).alias("published_at"))


@query("normal_times", f"""SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 3 THEN strftime(ts::DATE::TIMESTAMP, {_F})
 ELSE strftime(date_trunc('second', ts), {_F}) END utc FROM events""")
def normal_times(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    f = lambda p, shift=0: F.date_format(F.col("ts") + F.expr(f"interval {shift} hours"), p)
    raw = (
        F.when(k == 0, F.concat(f("yyyy-MM-dd'T'HH:mm:ss", 8), F.lit("+08:00"))).when(k == 1, F.concat(f("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z")))
        .when(k == 2, F.concat(f("EEE, dd MMM yyyy HH:mm:ss", -5), F.lit(" -0500"))).when(k == 3, f("yyyyMMdd"))
        .when(k == 4, F.concat(f("d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(f("HH:mm")))
    return t.raw("events").select("event_id", raw.alias("raw")).select("event_id", times.seconds_text(times.to_utc_seconds(F.col("raw"))).alias("utc"))


_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_CLEAN = f"""cut AS (SELECT document_id, title, CASE WHEN instr(b, ' worthless ') > 0 THEN substr(b, 1, instr(b, ' worthless ') - 1) ELSE b END content_text
 FROM (SELECT document_id, title, {_SQUEEZE.format('content_text')} b FROM tl_articles))"""


@query("clean_articles", f"WITH {_CLEAN} SELECT document_id, trim(content_text) content_text FROM cut")
def clean_articles(t: Tables) -> DataFrame:
    """The documents cut at an end marker that occurs in them."""
    return dc.clean_articles(t.articles.withColumn("title", F.lit("")), ends=(" worthless ",)).select("document_id", "content_text")


_BODY = f"CASE WHEN {_SQUEEZE.format('content_text')} = '' THEN 'x' ELSE {_SQUEEZE.format('content_text')} END"


def _body() -> Column:
    text = tx.squeeze(F.col("content_text"))
    return F.when(text == "", "x").otherwise(text)


@query("clean_article_arms", f"""SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'Headline' || document_id || ' ' || b WHEN 1 THEN '新华社北京电 ' || b ELSE b END content_text
FROM (SELECT document_id, {_BODY} b FROM tl_articles)""")
def clean_article_arms(t: Tables) -> DataFrame:
    """Frames in front of the text: up to a far title, up to a dispatch lead, and one site's toolbar."""
    k = F.col("document_id")
    head = F.concat(F.lit("Headline"), k)
    frame = F.when(k % 3 == 0, F.concat(F.lit("menu " * 30), head, F.lit(" "))).when(k % 3 == 1, "menu menu 新华社北京电 ").otherwise("打开 登录 ")
    site = F.when(k % 3 == 2, "https://m.people.com.cn/a.html").otherwise("https://example.org/a.html")
    docs = t.articles.select("document_id", site.alias("canonical_url"), head.alias("title"), F.concat(frame, _body()).alias("content_text"))
    return dc.clean_articles(docs).select("document_id", "content_text")


@query("clean_family", f"SELECT document_id, 'Headline' || document_id || ' ' || b || ' rest' content_text FROM (SELECT document_id, {_BODY} b FROM tl_articles)")
def clean_family(t: Tables) -> DataFrame:
    """One site family: page frame before a doubled title, a toolbar inside, further reading behind."""
    head = F.concat(F.lit("Headline"), F.col("document_id"))
    page = F.concat(F.lit("中国日报网首页 首页 时政 "), head, F.lit(" "), head, F.lit(" "), _body(), F.lit(" 站内搜索 go 分享到微信 rest 推荐阅读 more"))
    return t.articles.select("document_id", dc.clean_family_text(head, page).alias("content_text"))


@query("rejection_reasons", f"""SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 'URL 或标题指向栏目/首页' WHEN length({_SQUEEZE.format('title')}) = 0 THEN '标题缺失或异常过长'
 WHEN (contains(tt, 'the') )::INT + contains(tt, 'and')::INT + contains(tt, 'of')::INT + contains(tt, 'on')::INT >= 3 THEN '标题包含多个导航栏目'
 WHEN length(b) < 12 THEN '正文过短'
 WHEN contains(tt, 'the')::INT + contains(tt, 'and')::INT + contains(tt, 'of')::INT + contains(tt, 'on')::INT >= 1
  AND contains(h, 'the')::INT + contains(h, 'and')::INT + contains(h, 'of')::INT + contains(h, 'on')::INT >= 4 AND published_at IS NULL THEN '页面缺少发布时间且正文呈导航聚合结构'
 ELSE '' END reject_reason FROM (SELECT *, {_SQUEEZE.format('title')} tt, {_SQUEEZE.format('content_text')} b, {_SQUEEZE.format('content_text')} h FROM tl_articles)""")
def rejection_reasons(t: Tables) -> DataFrame:
    docs = t.articles.withColumn("canonical_url", F.when(F.col("document_id") % 10 == 0, F.lit("https://example.org/")).otherwise(
        F.concat(F.col("canonical_url"), F.lit(".html"))))
    return dc.with_rejection_reason(docs, markers=("the", "and", "of", "on")).select("document_id", "reject_reason")


@query("document_fingerprints", """SELECT document_id, sha256(regexp_replace(content_text, '^\\s+|\\s+$', '', 'g')) content_hash, length(content_text) = 0 empty_body FROM tl_articles""")
def document_fingerprints(t: Tables) -> DataFrame:
    return dc.with_fingerprint(t.articles).select("document_id", "content_hash", "empty_body")


@query("manual_documents", """SELECT document_id, CASE WHEN document_id % 2 = 0 THEN canonical_url ELSE 'manual://' || sha256(source_id || '|' || regexp_replace(content_text, '^\\s+|\\s+$', '', 'g')) END canonical_url
FROM tl_articles""")
def manual_documents(t: Tables) -> DataFrame:
    rows = t.articles.withColumn("canonical_url", F.when(F.col("document_id") % 2 == 0, F.col("canonical_url")))
    return pg.manual_documents(rows).select("document_id", "canonical_url")


def _keyed(t: Tables) -> DataFrame:
    return dc.with_fingerprint(t.articles)


_HASHED = "h AS (SELECT document_id, source_id, sha256(regexp_replace(content_text, '^\\s+|\\s+$', '', 'g')) k FROM tl_articles)"


@query("document_dedup", f"""WITH {_HASHED} SELECT document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY source_id, k ORDER BY document_id) n FROM h) WHERE n = 1""")
def document_dedup(t: Tables) -> DataFrame:
    return dc.dedup_documents(_keyed(t))[0].select("document_id")


@query("document_duplicates", f"""WITH {_HASHED}, old AS (SELECT * FROM h WHERE document_id % 3 = 0), o AS (SELECT source_id, k, min(document_id) kept FROM old GROUP BY 1, 2),
n AS (SELECT h.*, o.kept, min(h.document_id) OVER (PARTITION BY h.source_id, h.k) f FROM h LEFT JOIN o ON o.source_id = h.source_id AND o.k = h.k WHERE document_id % 3 <> 0)
SELECT document_id, coalesce(kept, f) kept_id FROM n WHERE kept IS NOT NULL OR document_id <> f""")
def document_duplicates(t: Tables) -> DataFrame:
    docs = _keyed(t)
    return dc.dedup_documents(docs.where("document_id % 3 <> 0"), docs.where("document_id % 3 = 0"))[1]


@query("document_dedup_chained")
def document_dedup_chained(t: Tables) -> DataFrame:
    """Colliding URLs and texts, so that fates depend on each other: no SQL twin, tested by brute force."""
    docs = _keyed(t).withColumn("source_id", F.lit(1).cast("bigint")).withColumn(
        "canonical_url", F.concat(F.lit("https://example.org/"), F.col("document_id") % 701))
    return dc.dedup_documents(docs)[0].select("document_id")
