"""Catalogue entries for the timeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.times import seconds_text
from annalist.operators import timeline as tl
from annalist.plans.catalogue import query
from annalist.plans.standins import Tables
from annalist.sources import search_index as si
from annalist.streaming import jobs

_SHADOW = """shadow AS (SELECT DISTINCT o.event_id FROM tl_evidence o JOIN tl_events e ON e.event_id = o.event_id
  JOIN tl_evidence s ON s.document_id = o.document_id JOIN tl_events p ON p.event_id = s.event_id
  WHERE e.event_type = 'other' AND p.person_id = e.person_id AND p.event_type = 'statement' AND p.review_status <> 'rejected')"""
_NAMES = """names AS (SELECT event_id, string_agg(name, ',' ORDER BY name) source_names FROM (
  SELECT DISTINCT v.event_id, s.name FROM tl_evidence v JOIN tl_documents d ON d.document_id = v.document_id
  JOIN tl_sources s ON s.source_id = d.source_id) GROUP BY event_id),
counts AS (SELECT event_id, count(*) evidence_count FROM tl_evidence GROUP BY event_id)"""
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _ts(c: str) -> str:
    return _TS.format(c)


@query("timeline_page", f"""WITH {_SHADOW}, {_NAMES}
SELECT e.event_id, p.name person_name, e.event_type, e.title, {_ts('e.start_at')} start_at,
  coalesce(c.evidence_count, 0) evidence_count, coalesce(n.source_names, '') source_names
FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id
LEFT JOIN counts c ON c.event_id = e.event_id LEFT JOIN names n ON n.event_id = e.event_id
WHERE e.review_status <> 'rejected' AND e.event_id NOT IN (SELECT event_id FROM shadow)
ORDER BY coalesce(e.start_at, e.created_at) DESC, e.event_id DESC LIMIT 20""")
def timeline_page(t: Tables) -> DataFrame:
    listing = tl.timeline(t.events, t.persons, t.evidence)
    out = tl.page_with_evidence(listing, t.evidence, t.documents, t.sources, tl.event_order("desc"))
    return out.select("event_id", "person_name", "event_type", "title", seconds_text(F.col("start_at")).alias("start_at"),
                      "evidence_count", "source_names")


@query("timeline_filtered", f"""WITH {_SHADOW}
SELECT e.event_id, p.name person_name, e.event_type, e.location_name, {_ts('e.start_at')} start_at
FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id
WHERE e.review_status <> 'rejected' AND e.event_id NOT IN (SELECT event_id FROM shadow)
  AND e.confirmation_status = 'completed' AND e.start_at::DATE >= DATE '1994-01-01' AND e.start_at::DATE <= DATE '1997-06-30'
  AND e.location_name IN ('FRANCE', 'CHINA', 'BRAZIL', 'NATION_3', 'NATION_7', 'NATION_11')
  AND (contains(lower(e.title), 'or') OR contains(lower(e.summary), 'or') OR contains(lower(p.name), 'or'))""")
def timeline_filtered(t: Tables) -> DataFrame:
    out = tl.timeline(t.events, t.persons, t.evidence, confirmation_status="completed", q="OR", start_date="1994-01-01",
                      end_date="1997-06-30",
                      locations=["FRANCE", "CHINA", "BRAZIL", "NATION_3", "NATION_7", "NATION_11"])
    return out.select("event_id", "person_name", "event_type", "location_name", seconds_text(F.col("start_at")).alias("start_at"))


@query("timeline_visible", f"""WITH {_SHADOW}
SELECT event_id, event_type FROM tl_events WHERE review_status <> 'rejected' AND event_id NOT IN (SELECT event_id FROM shadow)""")
def timeline_visible(t: Tables) -> DataFrame:
    return tl.hide_shadowed_other(tl.visible(t.events), t.evidence).select("event_id", "event_type")


@query("shadowed_other", f"WITH {_SHADOW} SELECT event_id FROM shadow")
def shadowed_other(t: Tables) -> DataFrame:
    return tl.shadowed_other(t.events, t.evidence)


@query("evidence_summary", f"""WITH {_NAMES} SELECT e.event_id, coalesce(c.evidence_count, 0) evidence_count,
  coalesce(n.source_names, '') source_names FROM tl_events e LEFT JOIN counts c ON c.event_id = e.event_id
  LEFT JOIN names n ON n.event_id = e.event_id""")
def evidence_summary(t: Tables) -> DataFrame:
    return tl.with_evidence_summary(t.events.select("event_id"), t.evidence, t.documents, t.sources)


@query("timeline_total", f"""WITH {_SHADOW} SELECT count(*) total FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id
WHERE review_status <> 'rejected' AND event_id NOT IN (SELECT event_id FROM shadow)""")
def timeline_total(t: Tables) -> DataFrame:
    return tl.timeline(t.events, t.persons, t.evidence).agg(F.count(F.lit(1)).alias("total"))


@query("timeline_keyset_page", f"""SELECT event_id, {_ts('coalesce(start_at, created_at)')} shown FROM tl_events
WHERE review_status <> 'rejected' AND (coalesce(start_at, created_at) < TIMESTAMP '1996-01-01'
  OR (coalesce(start_at, created_at) = TIMESTAMP '1996-01-01' AND event_id < 5000))
ORDER BY coalesce(start_at, created_at) DESC, event_id DESC LIMIT 50""")
def timeline_keyset_page(t: Tables) -> DataFrame:
    import datetime
    out = tl.page_after(tl.visible(t.events), datetime.datetime(1996, 1, 1), 5000, 50)
    return out.select("event_id", seconds_text(F.coalesce("start_at", "created_at")).alias("shown"))


@query("event_places", "SELECT DISTINCT location_name FROM tl_events WHERE location_name <> '' AND review_status <> 'rejected'")
def event_places(t: Tables) -> DataFrame:
    return tl.locations(t.events)


@query("event_detail", f"""SELECT v.event_id, v.document_id, p.name person_name, e.title, d.title document_title,
  {_ts('d.published_at')} published_at, s.name source_name, s.trust_level::BIGINT trust_level
FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id JOIN tl_evidence v ON v.event_id = e.event_id
JOIN tl_documents d ON d.document_id = v.document_id JOIN tl_sources s ON s.source_id = d.source_id
WHERE e.review_status <> 'rejected'""")
def event_detail(t: Tables) -> DataFrame:
    parts = tl.event_detail(t.events, t.persons, t.evidence, t.documents, t.sources)
    return parts["event"].select("event_id", "person_name", "title").join(parts["evidence"], "event_id").select(
        "event_id", "document_id", "person_name", "title", "document_title",
        seconds_text(F.col("published_at")).alias("published_at"), "source_name",
        F.col("trust_level").cast("bigint").alias("trust_level"))


@query("document_list", f"""SELECT document_id, d.title, canonical_url, {_ts('published_at')} published_at,
  {_ts('collected_at')} collected_at, status, s.name source_name FROM tl_documents d JOIN tl_sources s ON s.source_id = d.source_id
ORDER BY document_id DESC LIMIT 200 OFFSET 200""")
def document_list(t: Tables) -> DataFrame:
    out = tl.page(tl.document_list(t.documents, t.sources), [F.col("document_id").desc()], 2, 200)
    return out.withColumn("published_at", seconds_text(F.col("published_at"))).withColumn(
        "collected_at", seconds_text(F.col("collected_at")))


@query("document_detail", """SELECT v.document_id, v.event_id, e.title, e.event_type, p.name person_name FROM tl_evidence v
JOIN tl_events e ON e.event_id = v.event_id JOIN tl_persons p ON p.person_id = e.person_id""")
def document_detail(t: Tables) -> DataFrame:
    return tl.document_events(t.evidence, t.events, t.persons)


@query("cross_search", f"""SELECT id, result_type, title, summary, start_at, person_name FROM (
  (SELECT 0 part, event_id id, 'event' result_type, title, summary, {_ts('start_at')} start_at, p.name person_name FROM tl_events e
   JOIN tl_persons p ON p.person_id = e.person_id WHERE review_status <> 'rejected' AND (contains(lower(title), '-high order 11')
   OR contains(lower(summary), '-high order 11')) ORDER BY event_id LIMIT 100)
  UNION ALL (SELECT 1, document_id, 'document', title, content_text, {_ts('published_at')}, s.name FROM tl_documents d
   JOIN tl_sources s ON s.source_id = d.source_id WHERE contains(lower(title), '-high order 11')
   OR contains(lower(content_text), '-high order 11') ORDER BY document_id LIMIT 100)) ORDER BY part, id LIMIT 100""")
def cross_search(t: Tables) -> DataFrame:
    return tl.search("-HIGH order 11", t.events, t.persons, t.documents, t.sources, 100).withColumn(
        "start_at", seconds_text(F.col("start_at")))


_FOUND = f"""SELECT id, result_type, title, person_name FROM (
  (SELECT 0 part, event_id id, 'event' result_type, title, p.name person_name FROM tl_events e
   JOIN tl_persons p ON p.person_id = e.person_id WHERE review_status <> 'rejected' AND (contains(lower(title), 'ring')
   OR contains(lower(summary), 'ring') OR contains(lower(location_name), 'ring') OR contains(lower(p.name), 'ring')) ORDER BY event_id LIMIT 30)
  UNION ALL (SELECT 1, document_id, 'document', title, s.name FROM tl_documents d
   JOIN tl_sources s ON s.source_id = d.source_id WHERE contains(lower(title), 'ring')
   OR contains(lower(content_text), 'ring') ORDER BY document_id LIMIT 30)) ORDER BY part, id LIMIT 30"""


@query("cross_search_documents", _FOUND)
def cross_search_documents(t: Tables) -> DataFrame:
    return tl.search("Ring", t.events, t.persons, t.documents, t.sources).select("id", "result_type", "title", "person_name")


@query("indexed_search", _FOUND)
def indexed_search(t: Tables) -> DataFrame:
    """The same search through the trigram index, which two batches wrote."""
    root = jobs.work_folder(t.spark, "search")
    for n in (0, 1):
        si.index_batch(t.events.where(F.col("event_id") % 2 == n), "event_id", si.EVENT_TEXTS, root, "events", n)
        si.index_batch(t.documents.where(F.col("document_id") % 2 == n), "document_id", si.DOCUMENT_TEXTS, root, "documents", n)
    return si.search("Ring", root, t.events, t.persons, t.documents, t.sources).select("id", "result_type", "title", "person_name")


@query("dashboard_counts", """SELECT 'persons' metric, count(*) n FROM tl_persons WHERE enabled AND deleted_at IS NULL
UNION ALL SELECT 'sources', count(*) FROM tl_sources WHERE enabled
UNION ALL SELECT 'documents_today', count(*) FROM tl_documents WHERE collected_at::DATE = DATE '2000-01-01'
UNION ALL SELECT 'events_today', count(*) FROM tl_events WHERE review_status <> 'rejected' AND created_at::DATE = DATE '2000-01-01'
UNION ALL SELECT 'failed_tasks', count(*) FROM tl_runs WHERE status IN ('failed', 'partial_success')""")
def dashboard_counts(t: Tables) -> DataFrame:
    as_of = F.lit("2000-01-01 12:00:00").cast("timestamp")
    return tl.dashboard_counts(as_of, t.persons, t.sources, t.documents, t.events, t.runs)


@query("recent_events", f"""SELECT e.event_id, event_type, title, {_ts('start_at')} start_at, confirmation_status, review_status,
  p.name person_name FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id WHERE review_status <> 'rejected'
ORDER BY coalesce(start_at, created_at) DESC, event_id DESC LIMIT 8""")
def recent_events(t: Tables) -> DataFrame:
    return tl.recent_events(t.events, t.persons).withColumn("start_at", seconds_text(F.col("start_at")))


@query("failed_runs", f"""SELECT run_id, status, {_ts('started_at')} started_at, error_summary, t.name task_name FROM tl_runs r
JOIN tl_tasks t ON t.task_id = r.task_id WHERE status IN ('failed', 'partial_success') ORDER BY run_id DESC LIMIT 5""")
def failed_runs(t: Tables) -> DataFrame:
    return tl.failed_runs(t.runs, t.tasks).withColumn("started_at", seconds_text(F.col("started_at")))


@query("person_list", """SELECT p.person_id, p.name, p.enabled, coalesce(c.n, 0) event_count, coalesce(a.aliases, '') aliases
FROM tl_persons p LEFT JOIN (SELECT person_id, count(*) n FROM tl_events WHERE review_status <> 'rejected' GROUP BY 1) c
ON c.person_id = p.person_id LEFT JOIN (SELECT person_id, string_agg(alias, ',' ORDER BY alias_id) aliases FROM tl_aliases
WHERE enabled GROUP BY 1) a ON a.person_id = p.person_id
WHERE p.deleted_at IS NULL AND (contains(lower(p.organization), 'auto') OR contains(lower(p.name), 'auto') OR contains(lower(native_name), 'auto')
 OR EXISTS (SELECT 1 FROM tl_aliases x WHERE x.person_id = p.person_id AND contains(lower(x.alias), 'auto')))""")
def person_list(t: Tables) -> DataFrame:
    return tl.person_list(t.persons, t.aliases, t.events, "Auto").select(
        "person_id", "name", "enabled", "event_count", "aliases")


@query("source_list", """SELECT s.source_id, s.name, s."type", s.enabled, coalesce(d.n, 0) document_count, coalesce(l.n, 0) person_count,
  disc discovery_enabled, CASE WHEN disc THEN disc_pages ELSE 12 END::INT discovery_max_pages, 1 discovery_max_depth,
  CASE WHEN disc THEN 'website' ELSE s."type" END display_type FROM tl_sources s
LEFT JOIN (SELECT source_id, count(*) n FROM tl_documents GROUP BY 1) d ON d.source_id = s.source_id
LEFT JOIN (SELECT source_id, count(*) n FROM tl_source_persons GROUP BY 1) l ON l.source_id = s.source_id
WHERE s.deleted_at IS NULL""")
def source_list(t: Tables) -> DataFrame:
    return tl.source_list(t.sources, t.documents, t.source_persons)


@query("task_list", """SELECT t.task_id, t.name, s.name source_name, r.status last_status FROM tl_tasks t
JOIN tl_sources s ON s.source_id = t.source_id LEFT JOIN (SELECT task_id, arg_max(status, run_id) status FROM tl_runs GROUP BY 1) r
ON r.task_id = t.task_id""")
def task_list(t: Tables) -> DataFrame:
    return tl.task_list(t.tasks, t.sources, t.runs).select("task_id", "name", "source_name", "last_status")


@query("run_list", """SELECT r.run_id, t.name task_name, r.status, coalesce(b.n, 0) notification_batches,
  coalesce(i.n, 0) notification_items, coalesce(f.err, '') notification_error FROM tl_runs r JOIN tl_tasks t ON t.task_id = r.task_id
LEFT JOIN (SELECT run_id, count(*) n FROM tl_batches GROUP BY 1) b ON b.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) n FROM tl_items GROUP BY 1) i ON i.run_id = r.run_id
LEFT JOIN (SELECT run_id, arg_max(last_error, batch_id) err FROM tl_batches WHERE status = 'failed' GROUP BY 1) f ON f.run_id = r.run_id""")
def run_list(t: Tables) -> DataFrame:
    return tl.run_list(t.runs, t.tasks, t.batches, t.items).select(
        "run_id", "task_name", "status", "notification_batches", "notification_items", "notification_error")


@query("run_log", "SELECT conv_id run_id, turn log_id, role \"level\", text message FROM conversations")
def run_log(t: Tables) -> DataFrame:
    return tl.run_log(t.logs)


@query("map_people", """SELECT DISTINCT p.person_id, p.name FROM tl_persons p JOIN tl_events e ON e.person_id = p.person_id
WHERE p.deleted_at IS NULL AND e.event_type = 'itinerary' AND e.review_status <> 'rejected'""")
def map_people(t: Tables) -> DataFrame:
    return tl.map_people(t.persons, t.events)


@query("map_points", """SELECT event_id, p.name person_name, location_name, title, latitude, longitude FROM tl_events e
JOIN tl_persons p ON p.person_id = e.person_id WHERE review_status <> 'rejected' AND latitude IS NOT NULL AND longitude IS NOT NULL""")
def map_points(t: Tables) -> DataFrame:
    return tl.map_points(t.events, t.persons)


@query("map_bounds", """SELECT min(latitude) south, max(latitude) north, min(longitude) west, max(longitude) east, count(*) points
FROM tl_events e JOIN tl_persons p ON p.person_id = e.person_id WHERE review_status <> 'rejected' AND latitude IS NOT NULL""")
def map_bounds(t: Tables) -> DataFrame:
    return tl.map_bounds(tl.map_points(t.events, t.persons))


@query("person_options", "SELECT person_id, name, organization FROM tl_persons WHERE enabled AND deleted_at IS NULL")
def person_options(t: Tables) -> DataFrame:
    return tl.person_options(t.persons)


@query("source_options", "SELECT source_id, name, \"type\" FROM tl_sources WHERE deleted_at IS NULL")
def source_options(t: Tables) -> DataFrame:
    return tl.source_options(t.sources)


@query("task_options", """SELECT t.task_id, t.name, t.enabled, s.name source_name FROM tl_tasks t JOIN tl_sources s
ON s.source_id = t.source_id""")
def task_options(t: Tables) -> DataFrame:
    return tl.task_options(t.tasks, t.sources)


@query("audit_list", f"""SELECT event_id audit_id, event_type "action", props change_summary, {_ts('ts')} created_at, u.c_name username
FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) u ON u.c_custkey = user_id
ORDER BY event_id DESC LIMIT 30 OFFSET 60""")
def audit_list(t: Tables) -> DataFrame:
    out = tl.page(tl.audit_list(t.audit, t.users), [F.col("audit_id").desc()], 3, 30)
    return out.select("audit_id", "action", "change_summary", seconds_text(F.col("created_at")).alias("created_at"), "username")


@query("local_time_labels", """SELECT event_id, CASE event_type WHEN 'itinerary' THEN '行程' WHEN 'statement' THEN '言论' ELSE '其他' END type_label,
  CASE confirmation_status WHEN 'completed' THEN '已发生' WHEN 'expected' THEN '预计' ELSE '存疑' END state_label,
  coalesce(strftime(start_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M'), '时间未知') local_time FROM tl_events""")
def local_time_labels(t: Tables) -> DataFrame:
    return tl.with_labels(t.events).select("event_id", "type_label", "state_label", "local_time")
