"""Timeline queries: listings, details, counts and pick lists over the resolved tables.

Listing filters use the UTC date of ``start_at``; digests use the local day (see ``digest``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import text as tx
from annalist.operators.persons import GroupLinks, link_counts
from annalist.session import cut_lineage

MAX_PAGE = 200
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def visible(events: DataFrame) -> DataFrame:
    return events.where(F.col("review_status") != "rejected")


def matches(q: str, *columns: Column | str) -> Column:
    """Case-insensitive substring test over several columns; wildcards in ``q`` mean themselves."""
    needle = F.lit(q.lower())
    hit = F.lit(False)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    return hit


def shadowed_other(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ids of ``other`` events that share a document with a visible statement of the same person.

    Both sides meet on (document, person). The statement side is reduced to distinct pairs first, so
    a document that backs very many events never pairs them with each other.
    """
    stated = (
        evidence.join(visible(events).where(F.col("event_type") == "statement").select("event_id", "person_id"),
                      "event_id").select("document_id", "person_id").distinct()
    )
    others = evidence.join(events.where(F.col("event_type") == "other").select("event_id", "person_id"), "event_id")
    return others.join(stated, ["document_id", "person_id"], "left_semi").select("event_id").distinct()


def hide_shadowed_other(events: DataFrame, evidence: DataFrame) -> DataFrame:
    return events.join(shadowed_other(events, evidence), "event_id", "left_anti")


def source_names(evidence: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct, sorted source names per event, joined by commas.

    Pairs are made distinct on ids before names are collected: an event has at most as many list
    entries as there are sources, however many evidence rows it has.
    """
    pairs = evidence.join(documents.select("document_id", "source_id"), "document_id") \
        .select("event_id", "source_id").distinct()
    named = pairs.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id") \
        .select("event_id", "source_name").distinct()
    return named.groupBy("event_id").agg(
        F.array_join(F.sort_array(F.collect_list("source_name")), ",").alias("source_names"))


def with_evidence_summary(events: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``evidence_count`` and ``source_names``; events without evidence stay."""
    counts = evidence.groupBy("event_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    return (
        events.join(counts, "event_id", "left")
        .join(source_names(evidence, documents, sources), "event_id", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
        .withColumn("source_names", F.coalesce("source_names", F.lit("")))
    )


def _checked_day(label: str, value: str) -> None:
    if value and not _DAY.fullmatch(value):
        raise ValueError(f"{label} must be YYYY-MM-DD")


def timeline(events: DataFrame, persons: DataFrame, evidence: DataFrame, *, person_id: int | None = None,
             event_type: str = "", confirmation_status: str = "", q: str = "", start_date: str = "",
             end_date: str = "", locations: Sequence[str] = ()) -> DataFrame:
    """Visible events with their person, filtered. Undated events fall out of any date filter."""
    _checked_day("start_date", start_date)
    _checked_day("end_date", end_date)
    if start_date and end_date and start_date > end_date:
        raise ValueError("start_date is after end_date")
    out = visible(events)
    for column, value in (("person_id", person_id), ("event_type", event_type),
                          ("confirmation_status", confirmation_status)):
        if value not in (None, ""):
            out = out.where(F.col(column) == value)
    if start_date:
        out = out.where(F.col("start_at") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        out = out.where(F.col("start_at") < F.lit(end_date).cast("timestamp") + F.expr("interval 1 day"))
    wanted = list(dict.fromkeys(x.strip() for x in locations if x.strip()))
    if wanted:
        out = out.where(F.col("location_name").isin(wanted))
    out = out.join(persons.select("person_id", F.col("name").alias("person_name")), "person_id")
    if q:
        out = out.where(matches(q, "title", "summary", "location_name", "quote_text", "person_name"))
    return out.join(shadowed_other(events, evidence), "event_id", "left_anti")


def event_order(direction: str = "desc") -> list[Column]:
    if direction not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    shown = F.coalesce("start_at", "created_at")
    if direction == "asc":
        return [shown.asc_nulls_first(), F.col("event_id").asc()]
    return [shown.desc_nulls_last(), F.col("event_id").desc()]


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a listing; ``df.count()`` is its separate total."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page starts at 1 and holds 1 to 200 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_shown, last_id: int, size: int = 20) -> DataFrame:
    """The next page, newest first, below a known last row: deep pages need no offset."""
    shown = F.coalesce("start_at", "created_at")
    below = (shown < F.lit(last_shown)) | ((shown == F.lit(last_shown)) & (F.col("event_id") < last_id))
    return df.where(below).orderBy(*event_order("desc")).limit(size)


def page_with_evidence(listing: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame,
                       order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page with evidence counts and source names. The page is taken first and stored, so the listing is planned once
    and only the page's events' evidence is summed up; a page holds at most 200 rows and may be broadcast."""
    shown = cut_lineage(page(listing, order, number, size))
    backing = evidence.join(F.broadcast(shown.select("event_id")), "event_id")
    return with_evidence_summary(shown, backing, documents, sources)


def locations(events: DataFrame) -> DataFrame:
    return visible(events).where(F.col("location_name") != "").select("location_name").distinct().orderBy("location_name")


def event_detail(events: DataFrame, persons: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame,
                 event_id: int | None = None, history: DataFrame | None = None,
                 users: DataFrame | None = None) -> dict[str, DataFrame]:
    """The event rows with their person, their evidence rows by id, and their history newest first.

    The parts stay flat tables, so a much-reported event is never gathered into one value.
    """
    chosen = visible(events)
    if event_id is not None:
        chosen = chosen.where(F.col("event_id") == event_id)
        evidence = evidence.where(F.col("event_id") == event_id)
    head = chosen.join(persons.select("person_id", F.col("name").alias("person_name"), "native_name"), "person_id")
    keep = chosen.select("event_id")
    docs = documents.select("document_id", "source_id", F.col("title").alias("document_title"), "canonical_url",
                            "published_at", "collected_at")
    src = sources.select("source_id", F.col("name").alias("source_name"), "trust_level")
    backing = evidence.join(keep, "event_id", "left_semi").join(docs, "document_id").join(src, "source_id")
    parts = {"event": head, "evidence": backing}
    if history is not None:
        past = history.join(keep, "event_id", "left_semi")
        if users is not None:
            past = past.join(users.select(F.col("user_id").alias("operator_id"), F.col("username").alias("operator_name")),
                             "operator_id", "left")
        parts["history"] = past.orderBy("event_id", F.col("created_at").desc())
    return parts


def document_list(documents: DataFrame, sources: DataFrame) -> DataFrame:
    return documents.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id").select(
        "document_id", "title", "canonical_url", "published_at", "collected_at", "status", "source_name")


def document_events(evidence: DataFrame, events: DataFrame, persons: DataFrame) -> DataFrame:
    """Events backed by each document, one row per evidence row."""
    return (
        evidence.select("document_id", "event_id")
        .join(events.select("event_id", "person_id", "title", "event_type"), "event_id")
        .join(persons.select("person_id", F.col("name").alias("person_name")), "person_id")
        .select("document_id", "event_id", "title", "event_type", "person_name")
    )


def search(q: str, events: DataFrame, persons: DataFrame, documents: DataFrame, sources: DataFrame,
           size: int = 30, limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """Matching events by id, then matching documents by id up to the budget, in one shape."""
    if not 1 <= len(q) <= 200 or not 1 <= size <= 100:
        raise ValueError("search text is 1 to 200 characters, budget 1 to 100")
    ev = (
        visible(events).join(persons.select("person_id", F.col("name").alias("person_name")), "person_id")
        .where(matches(q, "title", "summary", "quote_text", "location_name", "person_name"))
        .select(F.lit(0).alias("part"), F.col("event_id").alias("id"), F.lit("event").alias("result_type"), "title",
                "summary", "start_at", "person_name")
    )
    docs = (
        documents.where(matches(q, "title", "content_text"))
        .join(sources.select("source_id", F.col("name").alias("person_name")), "source_id")
        .select(F.lit(1).alias("part"), F.col("document_id").alias("id"), F.lit("document").alias("result_type"),
                "title", tx.head(F.col("content_text"), limits.snippet).alias("summary"),
                F.col("published_at").alias("start_at"), "person_name")
    )
    both = ev.orderBy("id").limit(size).unionByName(docs.orderBy("id").limit(size))
    return both.orderBy("part", "id").limit(size).drop("part")


def dashboard_counts(as_of: Column, persons: DataFrame, sources: DataFrame, documents: DataFrame, events: DataFrame,
                     runs: DataFrame) -> DataFrame:
    """Five named counts; "today" is the UTC date of ``as_of``."""
    today = F.to_date(as_of)

    def counted(name: str, df: DataFrame, test: Column) -> DataFrame:
        return df.agg(F.count_if(test).alias("n")).select(F.lit(name).alias("metric"), "n")

    live = F.col("deleted_at").isNull()
    parts = [
        counted("persons", persons, F.col("enabled") & live),
        counted("sources", sources, F.col("enabled")),
        counted("documents_today", documents, F.to_date("collected_at") == today),
        counted("events_today", events, (F.col("review_status") != "rejected") & (F.to_date("created_at") == today)),
        counted("failed_tasks", runs, F.col("status").isin("failed", "partial_success")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recent_events(events: DataFrame, persons: DataFrame, n: int = 8) -> DataFrame:
    top = visible(events).orderBy(*event_order("desc")).limit(n)
    return top.join(persons.select("person_id", F.col("name").alias("person_name")), "person_id").select(
        "event_id", "event_type", "title", "start_at", "confirmation_status", "review_status", "person_name")


def failed_runs(runs: DataFrame, tasks: DataFrame, n: int = 5) -> DataFrame:
    bad = runs.where(F.col("status").isin("failed", "partial_success"))
    return bad.join(tasks.select("task_id", F.col("name").alias("task_name")), "task_id").orderBy(
        F.col("run_id").desc()).limit(n).select("run_id", "status", "started_at", "error_summary", "task_name")


def person_list(persons: DataFrame, aliases: DataFrame, events: DataFrame, q: str = "") -> DataFrame:
    """Live persons with visible event count and enabled aliases; enabled first, then by name."""
    live = persons.where(F.col("deleted_at").isNull())
    if q:
        by_alias = aliases.where(matches(q, "alias")).select("person_id").distinct().withColumn("by_alias", F.lit(True))
        live = live.join(by_alias, "person_id", "left").where(
            matches(q, "name", "native_name", "organization") | F.coalesce("by_alias", F.lit(False))).drop("by_alias")
    counts = visible(events).groupBy("person_id").agg(F.count(F.lit(1)).alias("event_count"))
    named = aliases.where("enabled").groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.struct("alias_id", "alias"))).alias("a"))
    return (
        live.join(counts, "person_id", "left").join(named, "person_id", "left")
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        .withColumn("aliases", F.coalesce(F.array_join(F.transform("a", lambda x: x["alias"]), ","), F.lit("")))
        .drop("a").orderBy(F.col("enabled").desc(), "name")
    )


def parser_config(c: Column) -> Column:
    """Discovery settings from their JSON text; invalid text gives the defaults. Missing pages and depth are null: no limit."""
    parsed = F.from_json(
        c, "discovery_enabled boolean, discovery_max_pages int, discovery_max_depth int, discovery_allowed_hosts array<string>")
    return F.struct(
        F.coalesce(parsed["discovery_enabled"], F.lit(False)).alias("discovery_enabled"),
        parsed["discovery_max_pages"].alias("discovery_max_pages"),
        parsed["discovery_max_depth"].alias("discovery_max_depth"),
        F.coalesce(parsed["discovery_allowed_hosts"], F.array().cast("array<string>")).alias("discovery_allowed_hosts"),
    )


def source_list(sources: DataFrame, documents: DataFrame, source_persons: DataFrame | GroupLinks) -> DataFrame:
    """Live sources, newest id first, with document count, linked persons and discovery settings. Missing pages and depth
    are shown as a small installation's."""
    counts = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("document_count"))
    linked = link_counts(source_persons).withColumnRenamed("n", "person_count")
    return (
        sources.where(F.col("deleted_at").isNull()).withColumn("cfg", parser_config(F.col("parser_config")))
        .join(counts, "source_id", "left").join(linked, "source_id", "left")
        .select("source_id", "name", "type", "enabled",
                F.coalesce("document_count", F.lit(0)).alias("document_count"),
                F.coalesce("person_count", F.lit(0)).alias("person_count"), "cfg.discovery_enabled",
                F.coalesce("cfg.discovery_max_pages", F.lit(vocab.SMALL.unset_pages)).alias("discovery_max_pages"),
                F.coalesce("cfg.discovery_max_depth", F.lit(vocab.SMALL.unset_depth)).alias("discovery_max_depth"),
                F.when(F.col("cfg.discovery_enabled"), "website").otherwise(F.col("type")).alias("display_type"))
        .orderBy(F.col("source_id").desc())
    )


def task_list(tasks: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    last = runs.groupBy("task_id").agg(F.max_by("status", "run_id").alias("last_status"))
    return (
        tasks.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
        .join(last, "task_id", "left").orderBy(F.col("task_id").desc())
    )


def run_list(runs: DataFrame, tasks: DataFrame, batches: DataFrame, items: DataFrame,
             task_id: int | None = None) -> DataFrame:
    """Runs with their delivery counts and the error of their last failed batch."""
    if task_id is not None:
        runs = runs.where(F.col("task_id") == task_id)
    failed = F.col("status") == "failed"
    per_run = batches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("notification_batches"),
        F.max_by(F.when(failed, F.col("last_error")), F.when(failed, F.col("batch_id"))).alias("notification_error"))
    per_item = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("notification_items"))
    return (
        runs.join(tasks.select("task_id", F.col("name").alias("task_name")), "task_id")
        .join(per_run, "run_id", "left").join(per_item, "run_id", "left")
        .withColumn("notification_batches", F.coalesce("notification_batches", F.lit(0)))
        .withColumn("notification_items", F.coalesce("notification_items", F.lit(0)))
        .withColumn("notification_error", F.coalesce("notification_error", F.lit("")))
    )


def run_log(logs: DataFrame, run_id: int | None = None) -> DataFrame:
    if run_id is not None:
        logs = logs.where(F.col("run_id") == run_id)
    return logs.orderBy("run_id", "log_id")


def map_people(persons: DataFrame, events: DataFrame) -> DataFrame:
    travelling = visible(events).where(F.col("event_type") == "itinerary").select("person_id")
    return persons.where(F.col("deleted_at").isNull()).join(travelling, "person_id", "left_semi").select(
        "person_id", "name").orderBy("name")


def map_points(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Visible events with finite coordinates."""
    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    return visible(events).where(finite("latitude") & finite("longitude")).join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id").select(
        "event_id", "person_name", "location_name", "title", "latitude", "longitude")


def map_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"),
                      F.min("longitude").alias("west"), F.max("longitude").alias("east"),
                      F.count(F.lit(1)).alias("points"))


def person_options(persons: DataFrame, typed: str = "") -> DataFrame:
    live = persons.where(F.col("enabled") & F.col("deleted_at").isNull())
    if typed:
        live = live.where(matches(typed, "name"))
    return live.select("person_id", "name", "organization").orderBy("name", "person_id")


def source_options(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("deleted_at").isNull()).select("source_id", "name", "type").orderBy("name", "source_id")


def task_options(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    return tasks.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id").select(
        "task_id", "name", "enabled", "source_name").orderBy("task_id")


def audit_list(audit: DataFrame, users: DataFrame) -> DataFrame:
    return audit.join(users.select(F.col("user_id").alias("actor_id"), "username"), "actor_id", "left")


def audit_row(df: DataFrame, action: str, object_type: str, summary: Column, at: Column,
              result: str = "success", limits: vocab.Limits = vocab.ALL) -> DataFrame:
    """Audit rows made from a job's report rows."""
    return df.select(F.lit(None).cast("bigint").alias("actor_id"), F.lit(action).alias("action"),
                     F.lit(object_type).alias("object_type"), F.lit("").alias("object_id"), F.lit(result).alias("result"),
                     F.lit("").alias("ip_address"), tx.head(summary, limits.audit).alias("change_summary"),
                     at.alias("created_at"))


def with_labels(df: DataFrame) -> DataFrame:
    """Display texts of type, state, time and confidence."""
    def label(c: str, table: dict[str, str]) -> Column:
        lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.coalesce(F.element_at(lookup, F.col(c)), F.col(c))

    from annalist.functions.times import local_text
    out = (
        df.withColumn("type_label", label("event_type", vocab.TYPE_LABELS))
        .withColumn("state_label", label("confirmation_status", vocab.STATE_LABELS))
        .withColumn("local_time", local_text(F.col("start_at")))
    )
    if "confidence" in df.columns:
        out = out.withColumn("percent", F.when(F.col("confidence").isNull(), "—").otherwise(
            F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))))
    return out
