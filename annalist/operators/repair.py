"""Repair jobs. Each returns its dry-run report and the change tables; applying them is a separate step.

A second run on repaired tables changes nothing. Locked events are neither changed nor deleted,
except by the navigation cleanup and the backfill of undated ``other`` events, which do not look at the lock.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import vocab
from annalist.functions import similarity as sm
from annalist.functions import text as tx
from annalist.functions import urls
from annalist.functions.times import url_published_at
from annalist.operators import attribution as at
from annalist.operators import documents as dc
from annalist.operators.extraction import extract_events
from annalist.operators.persons import Scope
from annalist.operators.resolution import Resolution, resolve
from annalist.operators.segments import LEXICON
from annalist.operators.timeline import audit_row, parser_config
from annalist.session import cut_lineage

SAMPLE = 20


@dataclass
class Repair:
    """``report`` is one row of counts; ``sample`` at most 20 affected rows; ``changes`` the tables to apply."""

    report: DataFrame
    sample: DataFrame
    changes: dict[str, DataFrame] = field(default_factory=dict)

    def audit(self, action: str, at: Column) -> DataFrame:
        """The job's audit row; its summary is the report as JSON."""
        whole = F.to_json(F.struct(*self.report.columns))
        return audit_row(self.report.withColumn("summary", whole), action, "repair", F.col("summary"), at)


def without(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed.select(key), key, "left_anti")


def replaced(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of the same key exchanged."""
    return without(df, rows, key).unionByName(rows.select(*df.columns))


def _one_row(**counts: DataFrame) -> DataFrame:
    """One row with the size of each table."""
    rows = None
    for name, df in counts.items():
        part = df.agg(F.count(F.lit(1)).alias("v")).select(F.lit(name).alias("k"), "v")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in counts])


# ---- orphans and collisions ------------------------------------------------------------------------

def orphans(evidence: DataFrame, doomed: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(event_id, orphan) of events that lose evidence; an orphan loses all of it."""
    flagged = evidence.join(doomed.select(key).distinct().withColumn("doomed", F.lit(True)), key, "left")
    counts = flagged.groupBy("event_id").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("doomed")).alias("lost"))
    return counts.where("lost > 0").select("event_id", (F.col("held") == F.col("lost")).alias("orphan"))


def resolve_collisions(proposed: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, losers) of proposed rows (event_id, new_key, new_start).

    A key held by an event outside the proposal drops its whole group; else the lowest id survives.
    """
    outside = events.join(proposed.select("event_id"), "event_id", "left_anti").select(F.col("dedup_key").alias("new_key"))
    lowest = proposed.groupBy("new_key").agg(F.min(F.struct("event_id", "new_start")).alias("s"))
    survivors = lowest.join(outside, "new_key", "left_anti").select("s.event_id", "new_key", "s.new_start")
    return survivors, without(proposed, survivors, "event_id").select("event_id", "new_key")


# ---- attribution recheck ---------------------------------------------------------------------------

def recheck_attribution(evidence: DataFrame, events: DataFrame, documents: DataFrame, persons: DataFrame, sources: DataFrame,
                        scope: Scope, person_id: int | None = None, source_id: int | None = None,
                        lexicon: vocab.Lexicon = LEXICON, limits: vocab.Limits = vocab.ALL) -> Repair:
    """Stored evidence that no longer proves its event. The event's person is always in scope."""
    docs = documents.select("document_id", "source_id", F.col("title").alias("document_title"))
    named_persons = persons.select("person_id", F.col("name").alias("person_name"))
    named_sources = sources.select("source_id", F.col("name").alias("source_name"))
    told = evidence.select("evidence_id", "event_id", "document_id", "evidence_text").join(
        events.select("event_id", "person_id", "event_type", "human_locked"), "event_id")

    def scanned(some: DataFrame, of: DataFrame) -> DataFrame:
        rows = some.join(of, "document_id").join(named_persons, "person_id").join(named_sources, "source_id")
        if person_id is not None:
            rows = rows.where(F.col("person_id") == person_id)
        return rows if source_id is None else rows.where(F.col("source_id") == source_id)

    rows = scanned(told, docs)
    free = rows.where(~F.col("human_locked"))
    # the whole text goes only with the evidence that must be found in it, not with every row
    placed = at.needs_place(F.col("evidence_text"), F.col("event_type"), lexicon)
    unlocked = told.where(~F.col("human_locked"))
    given = scanned(unlocked.where(~placed), docs).withColumn("content_text", F.lit(None).cast("string"))
    given = given.unionByName(scanned(unlocked.where(placed), documents.select("document_id", "source_id", F.col("title").alias("document_title"), "content_text")))
    judged = cut_lineage(at.judge_evidence(given, ["evidence_id"], scope, lexicon, force_target=True))
    invalid = free.join(judged.where(~F.col("valid")).select("evidence_id", "reason"), "evidence_id").select(
        "evidence_id", "event_id", "document_id", "person_name", "source_name", "document_title", "reason",
        tx.head(F.col("evidence_text"), limits.report).alias("evidence_text"))
    fate = orphans(evidence, invalid)
    report = _one_row(scanned_evidence=rows, scanned_events=rows.select("event_id").distinct(), accepted_evidence=judged.where("valid"),
                      invalid_evidence=invalid, kept_events=fate.where(~F.col("orphan")), orphan_events=fate.where("orphan"),
                      locked_skipped=rows.where("human_locked"))
    doomed_events = fate.where("orphan").join(events.where(~F.col("human_locked")), "event_id", "left_semi").select("event_id")
    reasons = invalid.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return Repair(report, invalid.orderBy("evidence_id").limit(SAMPLE),
                  {"evidence": invalid.select("evidence_id"), "events": doomed_events, "reasons": reasons})


# ---- page cleanups -----------------------------------------------------------------------------------

def cleanup_navigation(documents: DataFrame, sources: DataFrame, evidence: DataFrame) -> Repair:
    """Stored web documents of discovery sources that fail the quality gate, with their evidence and orphans."""
    finding = sources.where(parser_config(F.col("parser_config"))["discovery_enabled"]).select("source_id", F.col("name").alias("source_name"))
    web = documents.where(F.startswith(F.lower(F.col("canonical_url")), F.lit("http"))).join(finding, "source_id")
    bad = cut_lineage(dc.reject(dc.with_rejection_reason(web)).select(
        "document_id", "title", "canonical_url", "source_name", "reject_reason"))
    lost = evidence.join(bad, "document_id", "left_semi")
    gone = orphans(evidence, bad, "document_id").where("orphan").select("event_id")
    return Repair(_one_row(documents=bad, evidence=lost, events=gone), bad.orderBy("document_id").limit(SAMPLE),
                  {"documents": bad.select("document_id"), "evidence": lost.select("evidence_id"), "events": gone})


def cleanup_family(documents: DataFrame, evidence: DataFrame, events: DataFrame, source_id: int | None = None,
                   family: vocab.SiteFamily = dc.FAMILY) -> Repair:
    """Re-clean one site family: reject what is no article, rewrite what holds page frame.

    ``changes['rewritten']`` are documents to analyse again once the old evidence is gone.
    """
    if source_id is not None:
        documents = documents.where(F.col("source_id") == source_id)
    scanned = documents.where(urls.on_domain(urls.host(F.col("canonical_url")), [family.domain]))
    held = evidence.join(events.where("human_locked").select("event_id"), "event_id", "left_semi").select("document_id")
    locked = scanned.join(held, "document_id", "left_semi")
    free = scanned.join(held, "document_id", "left_anti").withColumn("original", tx.squeeze(F.col("content_text")))
    free = cut_lineage(dc.with_rejection_reason(dc.clean_articles(free, family=family), family=family))
    rejected = free.where(F.col("reject_reason") != "")
    dirty = free.where((F.col("reject_reason") == "") & (F.col("content_text") != F.col("original")))
    rewritten = dirty.withColumn("content_hash", F.sha2(F.col("content_text"), 256)).withColumn(
        "version", F.col("version") + 1).withColumn("status", F.lit("collected")).select(*documents.columns)
    hit = rejected.select("document_id").unionByName(dirty.select("document_id"))
    lost = evidence.join(hit, "document_id", "left_semi")
    gone = orphans(evidence, hit, "document_id").where("orphan").join(
        events.where(~F.col("human_locked")).select("event_id"), "event_id", "left_semi").select("event_id")
    report = _one_row(scanned_documents=scanned, rejected_documents=rejected, cleanable_documents=dirty, affected_evidence=lost,
                      orphan_events=gone, locked_skipped=locked)
    shown = rejected.select("document_id", "title", "reject_reason").unionByName(
        dirty.select("document_id", "title", F.lit("page frame").alias("reject_reason")))
    return Repair(report, shown.orderBy("document_id").limit(SAMPLE),
                  {"documents": rejected.select("document_id"), "rewritten": rewritten, "evidence": lost.select("evidence_id"), "events": gone})


def reanalyse(job: Repair, events: DataFrame, evidence: DataFrame, scope: Scope, as_of: Column, lexicon: vocab.Lexicon = LEXICON,
              limits: vocab.Limits = vocab.ALL) -> tuple[DataFrame, DataFrame, Resolution]:
    """Analyse the documents again that ``cleanup_family`` rewrote: (events and evidence without what it removes, and
    what the new texts bring)."""
    events_left = without(events, job.changes["events"], "event_id")
    evidence_left = without(evidence, job.changes["evidence"], "evidence_id")
    rewritten = job.changes["rewritten"]
    found, _ = extract_events(rewritten, scope, as_of, lexicon, limits)
    incoming = found.join(rewritten.select("document_id", "collected_at"), "document_id")
    return events_left, evidence_left, resolve(incoming, events_left, evidence_left, as_of, limits)


def reanalyse_documents(ids: DataFrame, documents: DataFrame, events: DataFrame | None, evidence: DataFrame | None, scope: Scope, as_of: Column,
                        lexicon: vocab.Lexicon = LEXICON, limits: vocab.Limits = vocab.ALL) -> tuple[Resolution, DataFrame, DataFrame]:
    """Extract chosen documents (``ids``: document_id) again and resolve what they say against the stored events.

    Returns the resolution, one row per chosen document (document_id, event_count: its new evidence rows), and the ids that no
    document has. Events of the same key and stored evidence are met again, so a second run brings no event and no
    evidence. A repeated id counts once.
    """
    wanted = ids.select("document_id").distinct()
    chosen = documents.join(wanted, "document_id", "left_semi")
    found, _ = extract_events(chosen, scope, as_of, lexicon, limits)
    res = resolve(found.join(chosen.select("document_id", "collected_at"), "document_id"), events, evidence, as_of, limits)
    counts = res.evidence.groupBy("document_id").agg(F.count(F.lit(1)).alias("event_count"))
    told = chosen.select("document_id").join(counts, "document_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    return res, told, wanted.join(documents, "document_id", "left_anti")


# ---- times -----------------------------------------------------------------------------------------

def _document_times(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "published_at", F.coalesce("published_at", "collected_at").alias("seen_at"))


def _earliest() -> Column:
    """Of the documents of a group, the one of the earliest publish (else collection) time, then id; none if all lack both."""
    return F.min(F.when(F.col("seen_at").isNotNull(), F.struct("seen_at", "document_id", "published_at")))


def _first_document(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Per event, the earliest evidence document."""
    return evidence.select("event_id", "document_id").join(_document_times(documents), "document_id").groupBy("event_id").agg(
        _earliest().alias("d")).where("d IS NOT NULL").select(
        "event_id", F.col("d.seen_at").alias("seen_at"), F.col("d.published_at").alias("published_at"))


def _first_told(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(event_id, seen_at, published_at, first_text): the earliest document and the first text of an event, from one pass over the
    evidence."""
    told = evidence.select("event_id", "document_id", "evidence_id", "evidence_text").join(_document_times(documents), "document_id", "left")
    return told.groupBy("event_id").agg(_earliest().alias("d"), F.min_by("evidence_text", "evidence_id").alias("first_text")).select(
        "event_id", F.col("d.seen_at").alias("seen_at"), F.col("d.published_at").alias("published_at"), "first_text")


def backfill_other_time(events: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Undated ``other`` events with the time of their first document (changed rows only)."""
    undated = events.where((F.col("event_type") == "other") & F.col("start_at").isNull())
    return undated.join(_first_document(evidence, documents).select("event_id", "seen_at"), "event_id").withColumn(
        "start_at", F.col("seen_at")).withColumn("time_precision", F.lit("day")).select(*events.columns)


def repair_year(events: DataFrame, evidence: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """Unlocked events dated this year although a document of theirs is from an earlier one (changed rows only)."""
    earliest = evidence.select("event_id", "document_id").join(
        documents.where(F.col("published_at").isNotNull()).select("document_id", "published_at"), "document_id").groupBy(
        "event_id").agg(F.min("published_at").alias("earliest"))
    wrong = events.where(~F.col("human_locked") & (F.year("start_at") == F.year(as_of))).join(earliest, "event_id").where(
        F.year("earliest") < F.year("start_at"))
    return wrong.withColumn("start_at", F.col("earliest")).withColumn("time_precision", F.lit("exact")).withColumn(
        "original_timezone", F.lit(vocab.LOCAL_ZONE)).select(*events.columns)


def approve_pending(events: DataFrame) -> DataFrame:
    return events.withColumn("review_status", F.when(
        F.col("review_status").isin("pending", "needs_review"), "approved").otherwise(F.col("review_status")))


def _retimed(events: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed rows, losers, a row of counts) for new times and first texts (event_id, new_start, first_text) of unlocked events.

    Every event is a row of one table: with the key it would get where it is proposed, else with the one it holds. What a key's
    rows decide (see ``resolve_collisions``) and all counts come from one pass over that table.
    """
    rows = events.select("event_id", "person_id", "event_type", "title", "start_at", "dedup_key", "human_locked").join(told, "event_id", "left")
    text = F.when(F.coalesce("first_text", F.lit("")) != "", F.col("first_text")).otherwise(F.coalesce("title", F.lit("")))
    own = sm.dedup_key(F.col("person_id"), F.col("event_type"), F.col("new_start"), text)
    rows = rows.withColumn("own", F.when(~F.col("human_locked") & F.col("new_start").isNotNull(), own))
    moves = (F.col("dedup_key") != F.col("own")) | ~F.col("start_at").eqNullSafe(F.col("new_start"))
    rows = rows.withColumn("proposed", F.coalesce(F.col("own").isNotNull() & moves, F.lit(False)))
    placed = rows.select("event_id", "new_start", "proposed", F.when(F.col("proposed"), F.col("own")).otherwise(F.col("dedup_key")).alias("new_key"))
    mover = F.when(F.col("proposed"), F.col("event_id"))
    keys = placed.groupBy("new_key").agg(F.min(mover).alias("event_id"), F.min_by("new_start", mover).alias("new_start"), F.count_if("proposed").alias("n"),
                                         F.count_if(~F.col("proposed")).alias("outside")).where("n > 0")
    survivors = keys.where("outside = 0").select("event_id", "new_key", "new_start")
    losers = without(placed.where("proposed"), survivors, "event_id").select("event_id", "new_key")
    free = F.col("outside") == 0
    counts = keys.agg(F.count_if(free).alias("repaired"), F.coalesce(F.sum(F.col("n") - free.cast("int")), F.lit(0)).alias("deleted_duplicates"))
    counts = counts.crossJoin(events.agg(F.count_if("human_locked").alias("skipped_locked")))
    changed = events.join(survivors, "event_id").withColumn("start_at", F.col("new_start")).withColumn(
        "dedup_key", F.col("new_key")).withColumn("time_precision", F.lit("day")).withColumn(
        "original_timezone", F.lit(vocab.LOCAL_ZONE)).select(*events.columns)
    return changed, losers, counts


def retime_events(events: DataFrame, evidence: DataFrame, documents: DataFrame) -> Repair:
    """Set the time of unlocked events to that of their first document, and their key with it."""
    told = _first_told(evidence, documents).select("event_id", F.date_trunc("second", "seen_at").alias("new_start"), "first_text")
    changed, losers, counts = _retimed(events, told)
    return Repair(counts.select("repaired", "deleted_duplicates", "skipped_locked"),
                  losers.orderBy("event_id").limit(SAMPLE), {"changed": changed, "events": losers.select("event_id")})


def polluted_documents(documents: DataFrame, zone: str = vocab.LOCAL_ZONE) -> DataFrame:
    """(document_id, new_published) where the URL names another publish day that is not after collection."""
    found, value = url_published_at(F.coalesce("canonical_url", F.lit("")))
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    rows = documents.select("document_id", "published_at", "collected_at", F.when(found, value).alias("new_published"))
    rows = rows.where(F.col("new_published").isNotNull())
    differs = ~local(F.col("new_published")).eqNullSafe(local(F.col("published_at")))
    possible = F.col("collected_at").isNull() | (local(F.col("new_published")) <= local(F.col("collected_at")))
    return rows.where(differs & possible).select("document_id", "new_published")


def repair_published_at(documents: DataFrame, events: DataFrame, evidence: DataFrame) -> Repair:
    """Reset wrong publish times from the URL and re-time the events that rest on those documents."""
    resets = cut_lineage(polluted_documents(documents))  # few rows, read by every step below
    fixed = documents.join(resets, "document_id").withColumn("published_at", F.col("new_published")).select(*documents.columns)
    after = replaced(documents, fixed, "document_id")
    touched = evidence.join(resets, "document_id", "left_semi").select("event_id").distinct()
    told = cut_lineage(_first_told(evidence.join(touched, "event_id", "left_semi"), after).select(
        "event_id", F.date_trunc("second", "published_at").alias("new_start"), "first_text"))
    changed, losers, counts = _retimed(events, told)
    return Repair(_one_row(repaired_documents=fixed).crossJoin(counts.withColumnRenamed("repaired", "repaired_events")),
                  fixed.select("document_id", "canonical_url", "published_at").orderBy("document_id").limit(SAMPLE),
                  {"documents": fixed, "changed": changed, "events": losers.select("event_id")})
