"""Scheduled digests: rules, windows, candidates, runs, batches, items and their texts.

A digest day is the local day of the given zone (the listings of ``timeline`` use the UTC day).
Every moment comes in as a parameter, so a run can be repeated with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annalist import vocab
from annalist.functions.times import iso_text, local_text
from annalist.operators.timeline import visible, with_evidence_summary

SEND_TIME = "^(?:[01]\\d|2[0-3]):[0-5]\\d$"
ADDRESS = "^[^@\\s<>(),:;\"\\[\\]\\\\]+@[^@\\s<>(),:;\"\\[\\]\\\\]+\\.[^@\\s<>(),:;\"\\[\\]\\\\]+$"
MODES = ("previous_calendar_day", "rolling_hours")
CLOSED = ("sent", "partial", "failed", "skipped", "empty")


# ---- rules -------------------------------------------------------------------------------

def rule_types(c: Column) -> Column:
    """Known event types of a JSON list; invalid text gives none."""
    parsed = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(parsed, lambda x: x.isin(*vocab.EVENT_TYPES))


def hydrate_rules(rules: DataFrame, rule_persons: DataFrame, rule_recipients: DataFrame, rule_sources: DataFrame,
                  include_deleted: bool = False) -> DataFrame:
    """Live rules with their bridges as sorted arrays, for listings. Jobs join the bridges instead."""
    def bridged(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("rule_id").agg(F.array_sort(F.collect_set(column)).alias(name))

    live = rules if include_deleted else rules.where(F.col("deleted_at").isNull())
    out = live.withColumn("event_types", rule_types(F.col("event_types_json")))
    for df, column, name, kind in ((rule_persons, "person_id", "person_ids", "bigint"),
                                   (rule_recipients, "recipient", "recipients", "string"),
                                   (rule_sources, "source_id", "source_ids", "bigint")):
        out = out.join(bridged(df, column, name), "rule_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return out


def validate_rules(rules: DataFrame, persons: DataFrame, sources: DataFrame,
                   max_hours: int = 168) -> tuple[DataFrame, DataFrame]:
    """(normalised good rules, rejects with the first reason). Ids are checked against live rows by joins."""
    types = F.array_sort(F.array_distinct("event_types"))
    people = F.array_sort(F.array_distinct("person_ids"))
    mails = F.transform(F.coalesce("recipients", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    name = F.trim(F.coalesce("name", F.lit("")))
    clean = rules.select(
        "rule_id", name.alias("name"), people.alias("person_ids"), types.alias("event_types"),
        F.array_sort(F.array_distinct("source_ids")).alias("source_ids"), mails.alias("mails"),
        F.coalesce(F.when(F.trim("send_time") != "", F.trim("send_time")), F.lit("08:30")).alias("send_time"),
        F.coalesce(F.when(F.trim("window_mode") != "", F.trim("window_mode")), F.lit(MODES[0])).alias("window_mode"),
        F.coalesce("rolling_hours", F.lit(24)).alias("rolling_hours"),
    )

    def missing(ids: str, alive: DataFrame, key: str, flag: str) -> DataFrame:
        wanted = clean.select("rule_id", F.explode(ids).alias(key))
        return wanted.join(alive.select(key), key, "left_anti").select("rule_id").distinct().withColumn(flag, F.lit(True))

    live = F.col("deleted_at").isNull()
    checked = (
        clean.join(missing("person_ids", persons.where(F.col("enabled") & live), "person_id", "lost_person"), "rule_id", "left")
        .join(missing("source_ids", sources.where(live), "source_id", "lost_source"), "rule_id", "left")
    )
    size = F.coalesce(F.size("person_ids"), F.lit(0))
    reason = (
        F.when((F.length("name") == 0) | (F.length("name") > 200), "name")
        .when(size <= 0, "no_person")
        .when((F.size("event_types") <= 0) | F.exists("event_types", lambda x: ~x.isin(*vocab.EVENT_TYPES)), "event_type")
        .when((F.size("mails") <= 0) | F.exists("mails", lambda x: ~F.regexp_like(x, F.lit(ADDRESS))), "recipient")
        .when(~F.regexp_like("send_time", F.lit(SEND_TIME)), "send_time")
        .when(~F.col("window_mode").isin(*MODES), "window_mode")
        .when(~F.col("rolling_hours").between(1, max_hours), "rolling_hours")
        .when(F.coalesce("lost_person", F.lit(False)), "person_unavailable")
        .when(F.coalesce("lost_source", F.lit(False)), "source_unavailable")
    )
    judged = checked.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).withColumn(
        "recipients", F.array_sort(F.array_distinct(F.transform("mails", F.lower)))).drop(
        "reason", "mails", "lost_person", "lost_source")
    return good, judged.where(F.col("reason").isNotNull()).select("rule_id", "reason")


# ---- windows -----------------------------------------------------------------------------

def _local_moment(day: Column, send_time: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(" "), send_time, F.lit(":00")).cast("timestamp")


def digest_windows(rules: DataFrame, dates: DataFrame, zone: str = vocab.LOCAL_ZONE) -> DataFrame:
    """Half-open UTC window and planned time for every (rule, business date)."""
    both = dates.join(rules.select("rule_id", "send_time", "window_mode", "rolling_hours"), "rule_id")
    planned = _local_moment(F.col("scheduled_date"), F.col("send_time"))
    midnight = F.col("scheduled_date").cast("timestamp")
    daily = F.col("window_mode") == "previous_calendar_day"
    start = F.when(daily, (F.date_sub("scheduled_date", 1)).cast("timestamp")).otherwise(
        planned - F.make_dt_interval(hours=F.col("rolling_hours")))
    end = F.when(daily, midnight).otherwise(planned)
    return both.select(
        "rule_id", "scheduled_date", F.to_utc_timestamp(planned, zone).alias("scheduled_at"),
        F.to_utc_timestamp(start, zone).alias("window_start"), F.to_utc_timestamp(end, zone).alias("window_end"))


def with_next_run(rules: DataFrame, as_of: Column, zone: str = vocab.LOCAL_ZONE) -> DataFrame:
    """The next planned time strictly after ``as_of``."""
    local = F.from_utc_timestamp(as_of, zone)
    today = _local_moment(F.to_date(local), F.col("send_time"))
    tomorrow = _local_moment(F.date_add(F.to_date(local), 1), F.col("send_time"))
    return rules.withColumn("next_run_at", F.to_utc_timestamp(F.when(today <= local, tomorrow).otherwise(today), zone))


def due_runs(rules: DataFrame, as_of: Column, zone: str = vocab.LOCAL_ZONE) -> DataFrame:
    """One row per due rule: the latest due business date and how many earlier dates were missed."""
    local = F.from_utc_timestamp(as_of, zone)
    today = F.to_date(local)
    due = F.when(local >= _local_moment(today, F.col("send_time")), today).otherwise(F.date_sub(today, 1))
    first = F.to_date(F.from_utc_timestamp("next_run_at", zone))
    return rules.where(F.col("enabled") & F.col("deleted_at").isNull() & (F.col("next_run_at") <= as_of)).select(
        "rule_id", due.alias("scheduled_date"), F.greatest(F.lit(0), F.date_diff(due, first)).alias("missed_count"))


# ---- candidates --------------------------------------------------------------------------

def digest_candidates(windows: DataFrame, rules: DataFrame, rule_persons: DataFrame, rule_sources: DataFrame,
                      events: DataFrame, persons: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, date, event) for every visible event of a rule's person and type inside the window.

    Time is ``start_at``, else ``created_at``. Events meet rules on the person, then windows on
    (rule, UTC day), with the exact bounds as a residual test, so no step is a range join.
    """
    typed = rules.select("rule_id", F.explode(rule_types(F.col("event_types_json"))).alias("event_type")).distinct()
    live = persons.where(F.col("enabled") & F.col("deleted_at").isNull()).select("person_id")
    scoped = rule_persons.join(live, "person_id", "left_semi").join(typed, "rule_id")
    timed = visible(events).select("event_id", "person_id", "event_type", "start_at",
                                   F.coalesce("start_at", "created_at").alias("selected_at"))
    pairs = timed.join(scoped, ["person_id", "event_type"]).withColumn("day", F.to_date("selected_at"))
    days = windows.select(
        "rule_id", "scheduled_date", "window_start", "window_end",
        F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))).alias("day"))
    inside = pairs.join(days, ["rule_id", "day"]).where(
        (F.col("selected_at") >= F.col("window_start")) & (F.col("selected_at") < F.col("window_end")))
    # rules without sources take every event, the others those with evidence from a listed source
    limited = rule_sources.select("rule_id").distinct().withColumn("limited", F.lit(True))
    inside = inside.join(limited, "rule_id", "left")
    backed = (
        inside.where("limited").select("rule_id", "event_id").distinct()
        .join(evidence.select("event_id", "document_id"), "event_id")
        .join(documents.select("document_id", "source_id"), "document_id")
        .join(rule_sources, ["rule_id", "source_id"], "left_semi").select("rule_id", "event_id").distinct()
        .withColumn("backed", F.lit(True))
    )
    return inside.join(backed, ["rule_id", "event_id"], "left").where(
        F.col("limited").isNull() | F.col("backed").isNotNull()).select(
        "rule_id", "scheduled_date", "event_id", "person_id", "event_type", "start_at")


def with_position(candidates: DataFrame) -> DataFrame:
    """1-based place inside a run: undated last, then start, person, type, id.

    A run may be large, so it is numbered in slices of one (start, person): the slice sizes are
    summed first, and rows are only ranked within their own slice.
    """
    run = ["rule_id", "scheduled_date"]
    late = F.lit("9999-12-31").cast("timestamp")
    keyed = candidates.withColumn("slot", F.coalesce("start_at", late))
    slices = keyed.groupBy(*run, "slot", "person_id").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(*run).orderBy("slot", "person_id").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inner = W.partitionBy(*run, "slot", "person_id").orderBy("event_type", "event_id")
    return keyed.join(slices, [*run, "slot", "person_id"]).withColumn(
        "position", F.col("offset") + F.row_number().over(inner)).drop("slot", "offset")


def _size(n: int, least: int) -> int:
    if int(n) < least:
        raise ValueError(f"a size of at least {least} is needed")
    return int(n)


def preview(candidates: DataFrame, events: DataFrame, persons: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(candidate count per run, the first rows of each run); nothing is written."""
    counts = candidates.groupBy("rule_id", "scheduled_date").agg(F.count(F.lit(1)).alias("candidate_count"))
    sample = with_position(candidates).where(F.col("position") <= _size(n, 0))
    shown = sample.join(events.select("event_id", "title"), "event_id").join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id").select(
        "rule_id", "scheduled_date", "position", "event_id", "person_name", "event_type", "title", "start_at")
    return counts, shown


# ---- runs, batches, items ------------------------------------------------------------------

def _run_id() -> Column:
    """A run is its rule and day; no hash can merge two."""
    return F.concat_ws("/", F.col("rule_id").cast("string"), F.col("scheduled_date").cast("string"))


def _batch_id() -> Column:
    """256 bits of run, recipient and part: the recipient's address does not show, and no two batches meet."""
    return F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), "recipient", F.col("part_number").cast("string")), 256)


def create_runs(windows: DataFrame, candidates: DataFrame, rules: DataFrame, ledger: DataFrame | None = None,
                trigger: str = "scheduled", zone: str = vocab.LOCAL_ZONE) -> DataFrame:
    """New run rows, one per (rule, date) that the ledger does not hold yet.

    A manual run may not precede the local day on which its rule was enabled.
    """
    if trigger not in ("scheduled", "manual"):
        raise ValueError("trigger is scheduled or manual")
    counts = candidates.groupBy("rule_id", "scheduled_date").agg(F.count(F.lit(1)).alias("candidate_count"))
    runs = windows.join(counts, ["rule_id", "scheduled_date"], "left").join(
        rules.select("rule_id", "send_when_empty", "enabled_at"), "rule_id")
    if trigger == "manual":
        enabled_day = F.to_date(F.from_utc_timestamp("enabled_at", zone))
        runs = runs.where(F.col("enabled_at").isNull() | (F.col("scheduled_date") >= enabled_day))
    if ledger is not None:
        runs = runs.join(ledger.select("rule_id", "scheduled_date"), ["rule_id", "scheduled_date"], "left_anti")
    count = F.coalesce("candidate_count", F.lit(0))
    return runs.select(
        _run_id().alias("run_id"), "rule_id", "scheduled_date", "scheduled_at",
        "window_start", "window_end", F.lit(trigger).alias("trigger_type"),
        F.when((count > 0) | F.col("send_when_empty"), "pending").otherwise("empty").alias("status"),
        count.alias("candidate_count"), F.col("send_when_empty"))


def batches(runs: DataFrame, recipients: DataFrame, max_events: int = 25) -> DataFrame:
    """Per recipient, as many parts as the run needs; one empty part if the rule wants empty mails."""
    n = _size(max_events, 1)
    parts = F.ceil(F.col("candidate_count") / n)
    parts = F.when((parts == 0) & F.col("send_when_empty"), 1).otherwise(parts).cast("int")
    out = runs.withColumn("parts", parts).where("parts > 0").join(recipients, "rule_id").select(
        "run_id", "rule_id", "scheduled_date", "recipient",
        F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part_number"))
    batch_id = _batch_id()
    return out.withColumn("batch_id", batch_id).withColumn("status", F.lit("pending")).withColumn(
        "message_id", F.concat(F.lit("<digest-"), batch_id.cast("string"), F.lit("@local>")))


def items(runs: DataFrame, candidates: DataFrame, recipients: DataFrame, max_events: int = 25) -> DataFrame:
    """One item per (run, event, recipient), with the batch that carries it."""
    n = _size(max_events, 1)
    placed = with_position(candidates).withColumn("part_number", F.ceil(F.col("position") / n).cast("int"))
    return (
        placed.join(runs.select("run_id", "rule_id", "scheduled_date"), ["rule_id", "scheduled_date"])
        .join(recipients, "rule_id")
        .select(_batch_id().alias("batch_id"), "run_id", "event_id", "recipient",
                "part_number", "position", F.lit("pending").alias("status"))
    )


# ---- texts ---------------------------------------------------------------------------------

def split_deliverable(item_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Mark the items whose event is gone or rejected."""
    alive = visible(events).select("event_id", F.lit(True).alias("alive"))
    return item_rows.join(alive, "event_id", "left").withColumn("deliverable", F.col("alive").isNotNull()).withColumn(
        "skip_reason", F.when(F.col("alive").isNotNull(), "").otherwise(vocab.ITEM_SKIPPED)).drop("alive")


def escape_html(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _entries(rows: DataFrame, base_url: str) -> DataFrame:
    """One plain and one HTML fragment per deliverable item, without its number."""
    labels = F.create_map(*[F.lit(x) for pair in vocab.TYPE_LABELS.items() for x in pair])
    label = F.coalesce(F.element_at(labels, F.col("event_type")), F.col("event_type"))
    when = local_text(F.col("start_at"))
    place = F.when(F.coalesce("location_name", F.lit("")) == "", vocab.PLACE_UNKNOWN).otherwise(F.col("location_name"))
    state = F.concat_ws(" / ", "confirmation_status", "review_status")
    origin = F.when(F.coalesce("source_names", F.lit("")) == "", vocab.SOURCE_UNKNOWN).otherwise(F.col("source_names"))
    summary = F.coalesce("summary", F.lit(""))
    root = base_url.rstrip("/")
    link = F.concat(F.lit(root + "/?event_id="), F.col("event_id").cast("string"))
    head = F.concat(F.lit(". ["), label, F.lit("] "), F.col("person_name"), F.lit(" · "), F.col("title"))
    lines = [head, F.concat(F.lit("时间："), when, F.lit("（北京时间）")), F.concat(F.lit("地点："), place),
             F.concat(F.lit("状态："), state), F.concat(F.lit("来源："), origin), summary]
    if root:
        lines.append(F.concat(F.lit("详情："), link))
    page = F.concat(
        F.lit(". ["), escape_html(label), F.lit("] "), escape_html(F.col("person_name")), F.lit(" · "),
        escape_html(F.col("title")), F.lit("</h3><p>"), escape_html(summary), F.lit("</p><p>时间："), when,
        F.lit("（北京时间）<br>地点："), escape_html(place), F.lit("<br>状态："), escape_html(state), F.lit("<br>来源："),
        escape_html(origin),
        F.concat(F.lit('<br><a href="'), escape_html(link), F.lit('">查看详情</a>')) if root else F.lit(""),
        F.lit("</p></article>"))
    return rows.withColumn("plain_entry", F.concat_ws("\n", *lines)).withColumn("html_entry", page)


def _numbered(events_by: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch texts from entries in order. A batch holds at most 100 items by construction."""
    packed = F.sort_array(F.collect_list(F.struct(*order, "plain_entry", "html_entry")))
    number = lambda i: (i + 1).cast("string")
    return events_by.groupBy(key).agg(packed.alias("e"), F.count(F.lit(1)).alias("event_count")).select(
        key, "event_count",
        F.array_join(F.transform("e", lambda x, i: F.concat(number(i), x["plain_entry"])), "\n\n").alias("plain_body"),
        F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("<article><h3>"), number(i), x["html_entry"])), "")
        .alias("html_body"))


def render_batches(batch_rows: DataFrame, item_rows: DataFrame, runs: DataFrame, rules: DataFrame, events: DataFrame,
                   persons: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame,
                   base_url: str = "", prefix: str = "") -> DataFrame:
    """Subject, plain text and HTML text of every digest batch; ``outcome`` is deliver or skip."""
    marked = split_deliverable(item_rows.select("batch_id", "event_id"), events)
    shown = events.select("event_id", "person_id", "event_type", "title", "summary", "start_at", "location_name",
                          "confirmation_status", "review_status")
    wanted = marked.where("deliverable").select("event_id").distinct()
    told = with_evidence_summary(shown.join(wanted, "event_id", "left_semi"), evidence.join(wanted, "event_id", "left_semi"),
                                 documents, sources)
    rows = marked.where("deliverable").join(told, "event_id").join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id")
    rows = _entries(rows, base_url).withColumn("undated", F.col("start_at").isNull())
    bodies = _numbered(rows, "batch_id", ["undated", "start_at", "person_id", "event_type", "event_id"])
    held = marked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("item_count"))
    full = (
        batch_rows.select("batch_id", "run_id", "recipient", "part_number")
        .join(runs.select("run_id", "rule_id", "scheduled_date", "window_start", "window_end"), "run_id")
        .join(rules.select("rule_id", F.col("name").alias("rule_name"), "send_when_empty"), "rule_id")
        .join(bodies, "batch_id", "left").join(held, "batch_id", "left")
    )
    count = F.coalesce("event_count", F.lit(0))
    window = F.concat(F.lit("汇总窗口："), local_text(F.col("window_start")), F.lit(" 至 "), local_text(F.col("window_end")),
                      F.lit("（北京时间，左闭右开）"))
    part = F.when(F.col("part_number") > 1, F.concat(F.lit("（第 "), F.col("part_number"), F.lit(" 部分）"))).otherwise("")
    subject = F.concat(F.lit(prefix.strip() + " " if prefix.strip() else ""), F.col("rule_name"), F.lit("日报 "),
                       F.col("scheduled_date").cast("string"), F.lit("："), count, F.lit(" 条事件"), part)
    skip = (count == 0) & (F.coalesce("item_count", F.lit(0)) > 0) & ~F.col("send_when_empty")
    return full.select(
        "batch_id", "run_id", "recipient", F.when(skip, "skip").otherwise("deliver").alias("outcome"),
        count.alias("event_count"), subject.alias("subject"),
        F.concat(window, F.lit("\n\n"), F.coalesce("plain_body", F.lit(vocab.NOTHING_NEW))).alias("plain"),
        F.concat(F.lit("<html><body><p>"), window, F.lit("</p>"),
                 F.coalesce("html_body", F.lit(f"<p>{vocab.NOTHING_NEW}</p>")), F.lit("</body></html>")).alias("html"))


def render_run_batches(batch_rows: DataFrame, item_rows: DataFrame, tasks: DataFrame, runs: DataFrame, events: DataFrame,
                       persons: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame,
                       base_url: str = "", prefix: str = "") -> DataFrame:
    """The same for the stored per-run ledger: no window line, items in id order, empty batches are skipped."""
    marked = split_deliverable(item_rows.select("batch_id", "item_id", "event_id"), events)
    shown = events.select("event_id", "person_id", "event_type", "title", "summary", "start_at", "location_name",
                          "confirmation_status", "review_status")
    wanted = marked.where("deliverable").select("event_id").distinct()
    told = with_evidence_summary(shown.join(wanted, "event_id", "left_semi"), evidence.join(wanted, "event_id", "left_semi"),
                                 documents, sources)
    rows = marked.where("deliverable").join(told, "event_id").join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id")
    bodies = _numbered(_entries(rows, base_url), "batch_id", ["item_id"])
    full = (
        batch_rows.select("batch_id", "run_id", "recipient", "part_number").join(runs.select("run_id", "task_id"), "run_id")
        .join(tasks.select("task_id", F.col("name").alias("task_name")), "task_id").join(bodies, "batch_id", "left")
    )
    count = F.coalesce("event_count", F.lit(0))
    part = F.when(F.col("part_number") > 1, F.concat(F.lit("（第 "), F.col("part_number"), F.lit(" 部分）"))).otherwise("")
    return full.select(
        "batch_id", "run_id", "recipient", F.when(count == 0, "skip").otherwise("deliver").alias("outcome"),
        count.alias("event_count"),
        F.concat(F.lit(prefix.strip() + " " if prefix.strip() else ""), F.col("task_name"), F.lit("：新增 "), count,
                 F.lit(" 条事件"), part).alias("subject"),
        F.coalesce("plain_body", F.lit("")).alias("plain"),
        F.concat(F.lit("<html><body>"), F.coalesce("html_body", F.lit("")), F.lit("</body></html>")).alias("html"))


# ---- listings --------------------------------------------------------------------------------

def masked(c: Column) -> Column:
    """First character and domain of an address."""
    return F.concat(F.substring(c, 1, 1), F.lit("***@"), F.regexp_extract(c, "@(.*)$", 1))


def digest_runs(runs: DataFrame, rules: DataFrame, rule_id: int | None = None, status: str = "") -> DataFrame:
    """Run rows with the rule's name, for a page ordered by date and id, newest first."""
    if status and status not in ("pending", "sending", *CLOSED):
        raise ValueError("unknown run status")
    if rule_id is not None:
        runs = runs.where(F.col("rule_id") == rule_id)
    if status:
        runs = runs.where(F.col("status") == status)
    return runs.join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id")


def digest_run_detail(batch_rows: DataFrame, item_rows: DataFrame, events: DataFrame, persons: DataFrame,
                      run_id: int | None = None, reveal: bool = False) -> dict[str, DataFrame]:
    """Batches with item counts (recipients masked unless revealed) and items with their event."""
    if run_id is not None:
        batch_rows = batch_rows.where(F.col("run_id") == run_id)
        item_rows = item_rows.where(F.col("run_id") == run_id)
    counts = item_rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("item_count"))
    shown = batch_rows.join(counts, "batch_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    if not reveal:
        shown = shown.withColumn("recipient", masked(F.col("recipient")))
    told = item_rows.join(events.select("event_id", "person_id", "title", "event_type", "start_at"), "event_id", "left").join(
        persons.select("person_id", F.col("name").alias("person_name")), "person_id", "left")
    return {"batches": shown, "items": told}


def missed_by_digest(candidates_now: DataFrame, item_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Late data: events inside the window of a run already made that its items do not hold."""
    made = runs.select("run_id", "rule_id", "scheduled_date")
    sent = item_rows.select("run_id", "event_id").distinct()
    return candidates_now.join(made, ["rule_id", "scheduled_date"]).join(
        sent, ["run_id", "event_id"], "left_anti").select("run_id", "rule_id", "scheduled_date", "event_id")


def window_text(windows: DataFrame) -> DataFrame:
    """Windows with their times as ISO text."""
    return windows.select("rule_id", F.col("scheduled_date").cast("string").alias("scheduled_date"),
                          *[iso_text(F.col(c)).alias(c) for c in ("scheduled_at", "window_start", "window_end")])
