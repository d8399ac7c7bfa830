"""Feed bodies -> one document row per entry."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx
from annalist.functions import urls
from annalist.functions.times import to_utc_seconds
from annalist.session import cut_lineage
from annalist.sources.pages import body_text, unescaped

NODES = "array<struct<entry:int,name:string,text:string,href:string>>"
# fixed values: the element names of a feed's entries, and those accepted for each field, in lower case
ENTRIES = ("item", "entry")
FIELDS = {
    "title": ("title",), "link": ("link",), "content": ("content", "encoded", "description", "summary"),
    "published": ("pubdate", "published", "updated"), "author": ("author", "creator"),
}


def feed_nodes(bodies: pd.Series) -> pd.Series:
    """The fields of all entries as flat rows in document order; NULL for a body that is not well-formed. Which row
    counts for which field is decided by Spark."""
    def flat(body: str | None) -> list[dict] | None:
        rows: list[dict] = []
        open_: list[tuple[str, int | None]] = []  # elements around the current one, with their entry's number
        entries = 0
        reader = ET.XMLPullParser(("start", "end"))
        try:
            reader.feed(body or "")
            reader.close()
            for event, element in reader.read_events():
                name = str(element.tag).rpartition("}")[2].lower()
                if event == "start":
                    entries += name in ENTRIES
                    open_.append((name, entries - 1 if name in ENTRIES else None))
                    continue
                open_.pop()
                if open_ and open_[-1][1] is not None:
                    rows.append({"entry": open_[-1][1], "name": name, "text": element.text or "", "href": element.get("href") or ""})
        except ET.ParseError:
            return None
        return [{"entry": k, "name": "", "text": "", "href": ""} for k in range(entries)] + rows

    return bodies.map(flat)


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """``feeds`` (source_id, url, body) with ``nodes`` in place of the body, stored, as documents and rejects read it."""
    return cut_lineage(feeds.select("source_id", "url", F.pandas_udf(feed_nodes, NODES)(F.col("body")).alias("nodes")))


def _entries(nodes: Column) -> Column:
    """One struct per entry: of each field the first accepted element that has text, and the first link's address."""
    def entry(k: Column) -> Column:
        own = F.filter(nodes, lambda n: n["entry"] == k)

        def first(names: tuple[str, ...]) -> Column:
            told = F.filter(own, lambda n: n["name"].isin(*names) & (n["text"] != ""))
            return tx.strip(F.get(told, 0)["text"])

        href = F.get(F.filter(own, lambda n: (n["name"] == "link") & (n["href"] != "")), 0)["href"]
        return F.struct(*(first(names).alias(field) for field, names in FIELDS.items()), F.coalesce(href, F.lit("")).alias("href"))

    numbers = F.transform(F.filter(nodes, lambda n: n["name"] == ""), lambda n: n["entry"])
    return F.transform(numbers, entry)


def feed_documents(feeds: DataFrame, max_items: int | None = None, compat: bool = False) -> DataFrame:
    """Documents of parsed feeds (see ``parsed_feeds``), at most ``max_items`` per feed.

    An entry without a link gets the feed URL and a hash of its text as the key, so several of them
    stay apart; ``compat`` gives them the bare feed URL instead.
    """
    entries = _entries(F.coalesce("nodes", F.array().cast(NODES)))
    if max_items is not None:
        entries = F.slice(entries, 1, max_items)
    rows = feeds.select("source_id", F.col("url").alias("feed_url"), F.posexplode(entries).alias("entry_index", "e"))
    text = body_text(F.col("e.content"))
    title = F.when(F.col("e.title") == "", vocab.UNTITLED_ENTRY).otherwise(F.col("e.title"))
    link = F.when(F.col("e.link") != "", F.col("e.link")).otherwise(F.col("e.href"))
    rows = rows.select("source_id", "feed_url", "entry_index", title.alias("raw_title"), text.alias("text"), link.alias("link"),
                       F.col("e.author").alias("author"), F.col("e.published").alias("published"))
    body = F.when(F.col("text") == "", F.col("raw_title")).otherwise(F.col("text"))
    own = F.concat(urls.canonical_url(F.col("feed_url")), F.lit("#entry-"),
                   F.substring(F.sha2(F.concat("raw_title", body), 256), 1, 12))
    resolved = urls.canonical_url(urls.resolve(F.col("link"), F.col("feed_url")))
    key = resolved if compat else F.when(F.col("link") == "", own).otherwise(resolved)
    return rows.select("source_id", "entry_index", key.alias("canonical_url"),
                       unescaped(F.col("raw_title")).alias("title"), "author",
                       to_utc_seconds(F.col("published")).alias("published_at"), body.alias("content_text"))


def feed_rejects(feeds: DataFrame) -> DataFrame:
    """Parsed feeds whose body could not be read."""
    return feeds.where(F.col("nodes").isNull()).select("source_id", "url", F.lit("malformed feed").alias("reason"))
