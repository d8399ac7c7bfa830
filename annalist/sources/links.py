"""Link tables: same-site links, the discovery frontier over stored links, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annalist import vocab
from annalist.functions import text as tx
from annalist.functions import urls
from annalist.operators.persons import hit_rows
from annalist.operators.timeline import parser_config
from annalist.session import cut_lineage


def _known(n: int | None) -> list[Column]:
    return [] if n is None else [F.lit(n)]


def _least(*columns: Column) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def discovery_roots(sources: DataFrame, max_items: int | None = None, limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """Root URL, allowed hosts, pages and depth of every discovery source (source_id, entry_url, parser_config).

    Pages and depth are those of the source's own configuration, null (no limit) where it has none; ``limits`` may set
    missing ones and lower them further.
    """
    cfg = F.col("cfg")
    per_item = None if max_items is None or limits.pages_per_item is None else max(3, max_items * limits.pages_per_item)
    rows = sources.select("source_id", urls.canonical_url(F.col("entry_url")).alias("root_url"), parser_config(F.col("parser_config")).alias("cfg"))
    pages = F.coalesce(cfg["discovery_max_pages"], F.lit(limits.unset_pages).cast("int"))
    depth = F.coalesce(cfg["discovery_max_depth"], F.lit(limits.unset_depth).cast("int"))
    given = F.filter(F.transform(cfg["discovery_allowed_hosts"], lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), "^[\\s.]+|[\\s.]+$", "")), lambda h: h != "")
    return rows.where(cfg["discovery_enabled"]).select(
        "source_id", "root_url", F.when(F.size(given) > 0, given).otherwise(urls.allowed_hosts(urls.host(F.col("root_url")))).alias("hosts"),
        _least(pages, *_known(limits.pages), *_known(per_item)).alias("max_pages"),
        _least(F.when(depth.isNotNull(), F.greatest(depth, F.lit(0))), *_known(limits.depth)).alias("max_depth"))


def same_site_links(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (source_id, page_url, link_idx, href, text) resolved, canonical and on the source's own hosts."""
    full = links.join(roots.select("source_id", "hosts"), "source_id").withColumn(
        "url", urls.canonical_url(urls.resolve(F.col("href"), F.col("page_url"))))
    full = full.withColumn("host", urls.host(F.col("url")))
    inside = F.exists("hosts", lambda h: (F.col("host") == h) | F.endswith(F.col("host"), F.concat(F.lit("."), h)))
    kept = full.where(urls.scheme(F.col("url")).isin("http", "https") & inside & ~urls.skipped_file(F.col("url")))
    return kept.select("source_id", "page_url", "link_idx", "url", "text").withColumn(
        "is_navigation", urls.looks_like_navigation(F.col("url"), F.col("text")))


def discover_candidates(roots: DataFrame, links: DataFrame, terms: DataFrame, max_items: int | None = None,
                        search_links: DataFrame | None = None, limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """Candidate articles (source_id, url, rank) by breadth-first walk over stored links.

    A link whose text or URL holds a term (source_id, term) is a candidate unless it is navigation; other navigation
    links are followed, one join per level, until a level is empty or every source's depth is reached. Pages are taken in
    the order in which they were found, up to the source's page count. With ``max_items``, the first so many
    candidates of a source are kept, and with ``limits.candidates_per_item`` no page is read once so many times as many
    are known. ``search_links`` (of the sources' search pages) add what the walk did not find, after it.
    """
    site = same_site_links(links, roots).join(roots.select("source_id", "root_url"), "source_id").where(
        F.col("url") != F.col("root_url")).drop("root_url")
    key = ["source_id", "page_url", "link_idx"]
    told = site.withColumn("haystack", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), "url"))
    hits = hit_rows(told, key, terms, "haystack").select(*key).distinct().withColumn("hit", F.lit(True))
    site = cut_lineage(site.join(hits, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    pages = walked_pages(roots, site)
    seen = site.where(F.col("hit") & ~F.col("is_navigation")).join(pages.select("source_id", "page_url", "place"), ["source_id", "page_url"])
    found = seen.groupBy("source_id", "url").agg(F.min(F.struct("place", "link_idx")).alias("at")).withColumn("part", F.lit(0))
    if max_items is not None and limits.candidates_per_item is not None:
        per_page = found.groupBy("source_id", F.col("at.place").alias("place")).agg(F.count(F.lit(1)).alias("n"))
        before = W.partitionBy("source_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        read = pages.select("source_id", "place").join(per_page, ["source_id", "place"], "left").withColumn(
            "known", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("known") < max_items * limits.candidates_per_item)
        found = found.withColumn("place", F.col("at.place")).join(read.select("source_id", "place"), ["source_id", "place"], "left_semi").drop("place")
    found = found.select("source_id", "url", "part", "at")
    if search_links is not None:
        extra = same_site_links(search_links, roots).where(~F.col("is_navigation")).groupBy("source_id", "url").agg(
            F.min("link_idx").alias("i")).join(found.select("source_id", "url"), ["source_id", "url"], "left_anti")
        found = found.unionByName(extra.select("source_id", "url", F.lit(1).alias("part"),
                                               F.struct(F.lit(0).alias("place"), F.col("i").alias("link_idx")).alias("at")))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("part", "at")))
    return (ranked if max_items is None else ranked.where(F.col("rank") <= max_items)).select("source_id", "url", "rank")


def walked_pages(roots: DataFrame, site: DataFrame) -> DataFrame:
    """The pages that a walk reads (source_id, page_url, depth, place): level by level, in the order of discovery.

    ``site`` are same-site links with ``hit`` and ``is_navigation``. Null pages or depth of a source are no limit.
    """
    def within(place: str) -> Column:
        return F.col("max_pages").isNull() | (F.col(place) <= F.col("max_pages"))

    order = W.partitionBy("source_id").orderBy("parent", "link_idx")
    follow = site.where(~F.col("hit") & F.col("is_navigation"))
    level = roots.select("source_id", F.col("root_url").alias("page_url"), F.lit(0).alias("depth"),
                         F.lit(0).alias("parent"), F.lit(0).alias("link_idx"), "max_depth", "max_pages")
    pages, depth = None, 0
    while True:
        # no page behind the page count is ever read, so a level needs at most that many
        level = cut_lineage(level.withColumn("nr", F.row_number().over(order)).where(within("nr")))
        pages = level if pages is None else pages.unionByName(level)
        depth += 1
        deeper = level.where(F.col("max_depth").isNull() | (F.col("depth") < F.col("max_depth")))
        if deeper.isEmpty():
            break
        found = deeper.select("source_id", "page_url", "max_depth", "max_pages", F.col("nr").alias("parent")).join(follow, ["source_id", "page_url"])
        first = found.groupBy("source_id", "url", "max_depth", "max_pages").agg(F.min(F.struct("parent", "link_idx")).alias("at"))
        level = first.select("source_id", F.col("url").alias("page_url"), F.lit(depth).alias("depth"), F.col("at.parent").alias("parent"),
                             F.col("at.link_idx").alias("link_idx"), "max_depth", "max_pages").join(
            pages.select("source_id", "page_url"), ["source_id", "page_url"], "left_anti")
    walk = W.partitionBy("source_id").orderBy("depth", "nr")
    return pages.withColumn("place", F.row_number().over(walk)).where(within("place"))


def search_term(terms: DataFrame) -> DataFrame:
    """Per source the term for its site search: the first with CJK characters, else the first (by rank)."""
    cjk = F.regexp_like("term", F.lit("[\\u3400-\\u9fff]"))
    return terms.groupBy("source_id").agg(F.min(F.struct((~cjk).alias("latin"), "rank", "term")).alias("t")).select(
        "source_id", F.col("t.term").alias("term"))


def search_pages(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """(source_id, search_url) of discovery sources: their own template, else that of their site, with the source's search
    term. ``terms`` are (source_id, rank, term); terms count in lower case, without blanks around them."""
    wanted = search_term(terms.withColumn("term", F.lower(tx.strip(F.col("term")))).where(F.length("term") > 0))
    own = F.coalesce(F.get_json_object("parser_config", "$.discovery_search_url_template"), F.lit(""))
    host = urls.host(urls.canonical_url(F.col("entry_url")))
    rows = sources.where(parser_config(F.col("parser_config"))["discovery_enabled"]).select(
        "source_id", F.when(own != "", own).otherwise(urls.search_template(host)).alias("template")).where(F.col("template") != "")
    return rows.join(wanted, "source_id").select("source_id", F.replace("template", F.lit("{query}"), urls.percent_encoded(F.col("term"))).alias("search_url"))


def relevant_documents(docs: DataFrame, terms: DataFrame, limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """Documents whose title or text holds a term of their source."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), tx.head(F.col("content_text"), limits.relevant))
    hits = hit_rows(docs.withColumn("haystack", text), ["document_id"], terms, "haystack")
    return docs.join(hits.select("document_id").distinct(), "document_id", "left_semi")


#: How many messages a source's statistics hold, and how long they are.
MESSAGES, MESSAGE = 10, 200


def discovery_stats(links: DataFrame, site: DataFrame, candidates: DataFrame, documents: DataFrame, accepted: DataFrame,
                    pages: DataFrame | None = None, searches: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Per source: pages scanned, search pages, links, same-site links, candidates, fetched, accepted, cleaned and rejected counts.

    ``links`` are those of scanned and of search pages; ``documents`` carry reject_reason ('' = article) and cleaned;
    ``pages`` and ``searches`` are the pages that were read, ``errors`` (source_id, place, message) what failed, in order of
    place. A source of any of these tables has a row, with zeros for what it does not have.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select("source_id", F.lit(name).alias("k"), "n")

    reasons = documents.where(F.col("reject_reason") != "").groupBy("source_id", "reject_reason").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reject_reason", "n")))).alias("rejection_reasons"))
    rows = counted(links, "links_extracted")
    named = [(site, "same_site_links"), (candidates, "candidates"), (documents, "articles_fetched"), (accepted, "accepted"),
             (accepted.where("cleaned"), "cleaned_accepted"), (documents.where(F.col("reject_reason") != ""), "rejected")]
    named += [(df, name) for df, name in ((pages, "pages_scanned"), (searches, "search_pages"), (errors, "errors_seen")) if df is not None]
    for df, name in named:
        rows = rows.unionByName(counted(df, name))
    names = ["links_extracted", *[name for _, name in named]]
    wide = rows.groupBy("source_id").agg(*[F.coalesce(F.max(F.when(F.col("k") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    wide = wide.join(reasons, "source_id", "left")
    if errors is None:
        return wide
    first = errors.withColumn("nr", F.row_number().over(W.partitionBy("source_id").orderBy("place"))).where(F.col("nr") <= MESSAGES)
    told = first.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("nr", F.substring("message", 1, MESSAGE).alias("m")))).alias("e"))
    return wide.join(told.select("source_id", F.transform("e", lambda x: x["m"]).alias("errors")), "source_id", "left")
