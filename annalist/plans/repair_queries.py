"""Catalogue entries for the repair jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.times import seconds_text
from annalist.operators import repair as rp
from annalist.plans.catalogue import query
from annalist.plans.standins import Tables

_F = "'%Y-%m-%d %H:%M:%S'"


@query("orphan_events", """SELECT event_id, count(*) = count(*) FILTER (WHERE document_id % 3 = 0) orphan FROM tl_evidence
GROUP BY event_id HAVING count(*) FILTER (WHERE document_id % 3 = 0) > 0""")
def orphan_events(t: Tables) -> DataFrame:
    doomed = t.documents.where("document_id % 3 = 0").select("document_id")
    return rp.orphans(t.evidence, doomed, "document_id")


_PROPOSED = """prop AS (SELECT event_id, person_id || '/' || event_type new_key FROM tl_events WHERE event_id % 3 <> 0 AND NOT human_locked),
prot AS (SELECT CASE WHEN event_id % 6 = 0 THEN person_id || '/' || event_type ELSE 'k' || event_id END k FROM tl_events
 WHERE event_id NOT IN (SELECT event_id FROM prop))"""


@query("key_collisions", f"""WITH {_PROPOSED} SELECT new_key, min(event_id) event_id FROM prop WHERE new_key NOT IN (SELECT k FROM prot) GROUP BY new_key""")
def key_collisions(t: Tables) -> DataFrame:
    new_key = F.concat_ws("/", F.col("person_id").cast("string"), "event_type")
    events = t.events.withColumn("dedup_key", F.when(F.col("event_id") % 6 == 0, new_key).otherwise(F.concat(F.lit("k"), F.col("event_id"))))
    proposed = t.events.where("event_id % 3 <> 0 AND NOT human_locked").select(
        "event_id", new_key.alias("new_key"), F.col("start_at").alias("new_start"))
    return rp.resolve_collisions(proposed, events)[0].select("new_key", "event_id")


_FIRST = """first_doc AS (SELECT v.event_id, arg_min(coalesce(d.published_at, d.collected_at), (coalesce(d.published_at, d.collected_at), d.document_id)) seen_at
 FROM tl_evidence v JOIN tl_documents d ON d.document_id = v.document_id GROUP BY 1)"""


@query("backfill_other_time", f"""WITH {_FIRST} SELECT e.event_id, strftime(f.seen_at, {_F}) start_at, 'day' time_precision FROM tl_events e
JOIN first_doc f ON f.event_id = e.event_id WHERE event_type = 'other' AND start_at IS NULL""")
def backfill_other_time(t: Tables) -> DataFrame:
    return rp.backfill_other_time(t.events, t.evidence, t.documents).select(
        "event_id", seconds_text(F.col("start_at")).alias("start_at"), "time_precision")


@query("repair_year", f"""SELECT e.event_id, strftime(m.p, {_F}) start_at FROM (SELECT *, start_at + INTERVAL 1095 DAY AS moved FROM tl_events) e JOIN (
 SELECT v.event_id, min(d.published_at) p FROM tl_evidence v JOIN tl_documents d ON d.document_id = v.document_id GROUP BY 1) m ON m.event_id = e.event_id
WHERE NOT human_locked AND year(moved) = 2000 AND year(m.p) < 2000""")
def repair_year(t: Tables) -> DataFrame:
    events = t.events.withColumn("start_at", F.col("start_at") + F.expr("interval 1095 days"))
    return rp.repair_year(events, t.evidence, t.documents, F.lit("2000-06-01").cast("timestamp")).select(
        "event_id", seconds_text(F.col("start_at")).alias("start_at"))


@query("approve_pending", "SELECT event_id, CASE review_status WHEN 'needs_review' THEN 'approved' ELSE review_status END review_status FROM tl_events")
def approve_pending(t: Tables) -> DataFrame:
    return rp.approve_pending(t.events).select("event_id", "review_status")


_RETIMED = _FIRST + """, first_text AS (SELECT event_id, arg_min(evidence_text, evidence_id) txt FROM tl_told GROUP BY 1),
prop AS (SELECT * FROM (SELECT e.event_id, e.dedup_key, e.start_at, f.seen_at new_start, sha256(person_id || '|' || event_type || '|' ||
  strftime(f.seen_at, '%Y-%m-%d') || '|' || lower(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g'))) new_key
 FROM tl_keyed e JOIN first_doc f ON f.event_id = e.event_id JOIN first_text x ON x.event_id = e.event_id WHERE NOT human_locked)
 WHERE dedup_key <> new_key OR start_at IS DISTINCT FROM new_start),
outside AS (SELECT dedup_key FROM tl_keyed WHERE event_id NOT IN (SELECT event_id FROM prop)),
won AS (SELECT new_key, min(event_id) event_id, arg_min(new_start, event_id) new_start FROM prop WHERE new_key NOT IN (SELECT dedup_key FROM outside) GROUP BY 1)"""


@query("retime_events", f"WITH {_RETIMED} SELECT event_id, new_key dedup_key, strftime(new_start, {_F}) start_at FROM won")
def retime_events(t: Tables) -> DataFrame:
    out = rp.retime_events(t.keyed_events, t.told_evidence, t.documents).changes["changed"]
    return out.select("event_id", "dedup_key", seconds_text(F.col("start_at")).alias("start_at"))


@query("retime_report", f"""WITH {_RETIMED} SELECT (SELECT count(*) FROM won) repaired, (SELECT count(*) FROM prop) - (SELECT count(*) FROM won) deleted_duplicates,
 (SELECT count(*) FROM tl_events WHERE human_locked) skipped_locked""")
def retime_report(t: Tables) -> DataFrame:
    return rp.retime_events(t.keyed_events, t.told_evidence, t.documents).report


@query("repair_audit", f"""WITH {_RETIMED}, r AS (SELECT (SELECT count(*) FROM won) a, (SELECT count(*) FROM prop) - (SELECT count(*) FROM won) b,
 (SELECT count(*) FROM tl_events WHERE human_locked) c) SELECT 'retime_events' "action", 'repair' object_type, 'success' result,
 '{{"repaired":' || a || ',"deleted_duplicates":' || b || ',"skipped_locked":' || c || '}}' change_summary FROM r""")
def repair_audit(t: Tables) -> DataFrame:
    job = rp.retime_events(t.keyed_events, t.told_evidence, t.documents)
    return job.audit("retime_events", F.current_timestamp()).select("action", "object_type", "result", "change_summary")


_POLLUTED = """moved AS (SELECT *, CASE document_id % 4 WHEN 0 THEN 'https://example.org/n/20' || lpad((document_id % 30)::VARCHAR, 2, '0') || '0315/a.html'
  WHEN 1 THEN 'https://example.org/2000/01/' || lpad((document_id % 40)::VARCHAR, 2, '0') || '/a' ELSE canonical_url END url FROM tl_documents),
days AS (SELECT *, CASE document_id % 4 WHEN 0 THEN TRY_CAST('20' || lpad((document_id % 30)::VARCHAR, 2, '0') || '-03-15' AS TIMESTAMP)
  WHEN 1 THEN CASE WHEN document_id % 40 BETWEEN 1 AND 31 THEN TRY_CAST('2000-01-' || lpad((document_id % 40)::VARCHAR, 2, '0') AS TIMESTAMP) END END d FROM moved),
bad AS (SELECT document_id, d - INTERVAL 8 HOUR new_published FROM days WHERE d IS NOT NULL AND d::DATE IS DISTINCT FROM (published_at + INTERVAL 8 HOUR)::DATE
  AND d::DATE <= (collected_at + INTERVAL 8 HOUR)::DATE)"""


def _moved(t: Tables) -> DataFrame:
    k = F.col("document_id")
    return t.documents.withColumn("canonical_url", F.when(k % 4 == 0, F.concat(
        F.lit("https://example.org/n/20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("0315/a.html"))).when(k % 4 == 1, F.concat(
            F.lit("https://example.org/2000/01/"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("/a"))).otherwise(F.col("canonical_url")))


@query("polluted_documents", f"WITH {_POLLUTED} SELECT document_id, strftime(new_published, {_F}) new_published FROM bad")
def polluted_documents(t: Tables) -> DataFrame:
    return rp.polluted_documents(_moved(t)).select("document_id", seconds_text(F.col("new_published")).alias("new_published"))


@query("repair_published_at", f"""WITH {_POLLUTED}, after AS (SELECT d.document_id, coalesce(b.new_published, d.published_at) published_at, d.collected_at
  FROM tl_documents d LEFT JOIN bad b ON b.document_id = d.document_id),
first_doc AS (SELECT v.event_id, first(d.published_at ORDER BY coalesce(d.published_at, d.collected_at), d.document_id) seen_at FROM tl_evidence v
  JOIN after d ON d.document_id = v.document_id WHERE v.event_id IN (SELECT w.event_id FROM tl_evidence w JOIN bad b ON b.document_id = w.document_id) GROUP BY 1),
first_text AS (SELECT event_id, arg_min(evidence_text, evidence_id) txt FROM tl_told GROUP BY 1),
prop AS (SELECT * FROM (SELECT e.event_id, e.dedup_key, e.start_at, f.seen_at new_start, sha256(person_id || '|' || event_type || '|' ||
  strftime(f.seen_at, '%Y-%m-%d') || '|' || lower(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g'))) new_key
 FROM tl_keyed e JOIN first_doc f ON f.event_id = e.event_id JOIN first_text x ON x.event_id = e.event_id WHERE NOT human_locked AND f.seen_at IS NOT NULL)
 WHERE dedup_key <> new_key OR start_at IS DISTINCT FROM new_start),
outside AS (SELECT dedup_key FROM tl_keyed WHERE event_id NOT IN (SELECT event_id FROM prop)),
won AS (SELECT new_key, min(event_id) event_id, arg_min(new_start, event_id) new_start FROM prop WHERE new_key NOT IN (SELECT dedup_key FROM outside) GROUP BY 1)
SELECT event_id, new_key dedup_key, strftime(new_start, {_F}) start_at FROM won""")
def repair_published_at(t: Tables) -> DataFrame:
    out = rp.repair_published_at(_moved(t), t.keyed_events, t.told_evidence).changes["changed"]
    return out.select("event_id", "dedup_key", seconds_text(F.col("start_at")).alias("start_at"))


@query("cleanup_navigation_report", """WITH nav AS (SELECT p_partkey document_id FROM part WHERE (p_partkey % 5 = 0) AND p_partkey % (SELECT count(*) FROM supplier) % 3 = 1)
SELECT (SELECT count(*) FROM nav) documents, (SELECT count(*) FROM tl_evidence WHERE document_id IN (SELECT document_id FROM nav)) evidence,
 (SELECT count(*) FROM (SELECT event_id FROM tl_evidence GROUP BY 1 HAVING bool_and(document_id IN (SELECT document_id FROM nav)))) events""")
def cleanup_navigation_report(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("canonical_url", F.when(F.col("document_id") % 5 == 0, F.concat(
        F.lit("https://example.org/list/"), F.col("document_id"))).otherwise(F.concat(F.col("canonical_url"), F.lit(".html")))).withColumn(
        "content_text", F.concat(F.col("content_text"), F.lit(" with enough text")))
    return rp.cleanup_navigation(docs, t.sources, t.told_evidence).report


@query("cleanup_family_report", """WITH fam AS (SELECT p_partkey document_id FROM part WHERE p_partkey % 3 = 0),
held AS (SELECT DISTINCT v.document_id FROM tl_evidence v JOIN tl_events e ON e.event_id = v.event_id WHERE human_locked),
hit AS (SELECT document_id FROM fam WHERE document_id NOT IN (SELECT document_id FROM held) AND (document_id % 2 = 0 OR document_id % 5 = 0))
SELECT (SELECT count(*) FROM fam) scanned_documents,
 (SELECT count(*) FROM hit WHERE document_id % 2 = 0) rejected_documents, (SELECT count(*) FROM hit WHERE document_id % 2 = 1) cleanable_documents,
 (SELECT count(*) FROM tl_evidence WHERE document_id IN (SELECT document_id FROM hit)) affected_evidence,
 (SELECT count(*) FROM (SELECT v.event_id FROM tl_evidence v JOIN tl_events e ON e.event_id = v.event_id WHERE NOT human_locked GROUP BY 1
   HAVING bool_and(v.document_id IN (SELECT document_id FROM hit)))) orphan_events,
 (SELECT count(*) FROM fam WHERE document_id IN (SELECT document_id FROM held)) locked_skipped""")
def cleanup_family_report(t: Tables) -> DataFrame:
    k = F.col("document_id")
    docs = t.documents.withColumn("version", F.lit(1)).withColumn("content_hash", F.sha2("content_text", 256)).withColumn(
        "canonical_url", F.when(k % 3 == 0, F.concat(F.lit("https://cn.chinadaily.com.cn/"), F.when(k % 2 == 0, F.lit("list")).otherwise("a"),
                                                     F.lit("/"), k, F.when(k % 2 == 0, F.lit("")).otherwise(".html")))
        .otherwise(F.col("canonical_url"))).withColumn(
        "content_text", F.concat(F.col("content_text"), F.lit(" with enough text"), F.when(k % 5 == 0, F.lit(" 推荐阅读 more")).otherwise("")))
    return rp.cleanup_family(docs, t.told_evidence, t.events).report
