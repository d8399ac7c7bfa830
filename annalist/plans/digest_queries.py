"""Catalogue entries for digests and the delivery ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.times import seconds_text
from annalist.operators import delivery as dl
from annalist.operators import digest as dg
from annalist.plans.catalogue import query
from annalist.plans.standins import Tables

_F = "'%Y-%m-%d %H:%M:%S'"
_WINDOWS = """windows AS (SELECT d.rule_id, d.scheduled_date,
  (d.scheduled_date::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP - INTERVAL 8 HOUR scheduled_at,
  CASE WHEN window_mode = 'previous_calendar_day' THEN d.scheduled_date::TIMESTAMP - INTERVAL 32 HOUR
   ELSE (d.scheduled_date::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP - INTERVAL 8 HOUR - to_hours(rolling_hours) END window_start,
  CASE WHEN window_mode = 'previous_calendar_day' THEN d.scheduled_date::TIMESTAMP - INTERVAL 8 HOUR
   ELSE (d.scheduled_date::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP - INTERVAL 8 HOUR END window_end
  FROM tl_rule_dates d JOIN tl_rules r ON r.rule_id = d.rule_id)"""
_CANDIDATES = _WINDOWS + """, src AS (SELECT DISTINCT v.event_id, d.source_id FROM tl_evidence v JOIN tl_documents d ON d.document_id = v.document_id),
cands AS (SELECT w.rule_id, w.scheduled_date, e.event_id, e.person_id, e.event_type, e.start_at FROM tl_events e
  JOIN tl_persons p ON p.person_id = e.person_id AND p.enabled AND p.deleted_at IS NULL
  JOIN tl_rule_persons rp ON rp.person_id = e.person_id JOIN tl_rules r ON r.rule_id = rp.rule_id
  JOIN windows w ON w.rule_id = r.rule_id AND coalesce(e.start_at, e.created_at) >= w.window_start
   AND coalesce(e.start_at, e.created_at) < w.window_end
  WHERE e.review_status <> 'rejected' AND list_contains(string_split(r.types, ','), e.event_type)
   AND (NOT EXISTS (SELECT 1 FROM tl_rule_sources rs WHERE rs.rule_id = r.rule_id) OR EXISTS (SELECT 1 FROM tl_rule_sources rs
    JOIN src ON src.source_id = rs.source_id WHERE rs.rule_id = r.rule_id AND src.event_id = e.event_id)))"""
_PLACED = _CANDIDATES + """, placed AS (SELECT *, row_number() OVER (PARTITION BY rule_id, scheduled_date
  ORDER BY start_at ASC NULLS LAST, person_id, event_type, event_id) pos FROM cands)"""
_RUNS = _PLACED + """, runs AS (SELECT w.*, coalesce(c.n, 0) candidate_count, r.send_when_empty, r.name rule_name,
  CASE WHEN coalesce(c.n, 0) > 0 OR r.send_when_empty THEN 'pending' ELSE 'empty' END status FROM windows w
  JOIN tl_rules r ON r.rule_id = w.rule_id LEFT JOIN (SELECT rule_id, scheduled_date, count(*) n FROM cands GROUP BY ALL) c
  ON c.rule_id = w.rule_id AND c.scheduled_date = w.scheduled_date)"""
CHUNK = 3


def _windows(t: Tables) -> DataFrame:
    return dg.digest_windows(t.rules, t.rule_dates)


def _candidates(t: Tables) -> DataFrame:
    return dg.digest_candidates(_windows(t), t.rules, t.rule_persons, t.rule_sources, t.events, t.persons, t.evidence, t.documents)


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("scheduled_date", F.col("scheduled_date").cast("string"))


@query("digest_windows", f"""WITH {_WINDOWS} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, strftime(scheduled_at, {_F}) scheduled_at,
  strftime(window_start, {_F}) window_start, strftime(window_end, {_F}) window_end FROM windows""")
def digest_windows(t: Tables) -> DataFrame:
    return _day(_windows(t)).select("rule_id", "scheduled_date", *[
        seconds_text(F.col(c)).alias(c) for c in ("scheduled_at", "window_start", "window_end")])


_NOW = "1992-03-18 14:00:00"


@query("digest_next_run", f"""SELECT rule_id, strftime((CASE WHEN (l::DATE::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP <= l
  THEN (l::DATE::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP + INTERVAL 1 DAY ELSE (l::DATE::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP END)
  - INTERVAL 8 HOUR, {_F}) next_run_at FROM (SELECT *, enabled_at + INTERVAL 8 HOUR l FROM tl_rules)""")
def digest_next_run(t: Tables) -> DataFrame:
    return dg.with_next_run(t.rules, F.col("enabled_at")).select("rule_id", seconds_text(F.col("next_run_at")).alias("next_run_at"))


@query("digest_due_runs", f"""SELECT rule_id, due::VARCHAR scheduled_date, greatest(0, date_diff('day', (next_run_at + INTERVAL 8 HOUR)::DATE, due))::INT missed_count
FROM (SELECT *, CASE WHEN l >= (l::DATE::VARCHAR || ' ' || send_time || ':00')::TIMESTAMP THEN l::DATE ELSE l::DATE - 1 END due
 FROM (SELECT *, TIMESTAMP '{_NOW}' + INTERVAL 8 HOUR l FROM tl_rules)) WHERE enabled AND NOT deleted AND next_run_at <= TIMESTAMP '{_NOW}'""")
def digest_due_runs(t: Tables) -> DataFrame:
    return _day(dg.due_runs(t.rules, F.lit(_NOW).cast("timestamp")))


@query("digest_candidates", f"WITH {_CANDIDATES} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, event_id FROM cands")
def digest_candidates(t: Tables) -> DataFrame:
    return _day(_candidates(t)).select("rule_id", "scheduled_date", "event_id")


@query("digest_positions", f"WITH {_PLACED} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, event_id, pos \"position\" FROM placed")
def digest_positions(t: Tables) -> DataFrame:
    return _day(dg.with_position(_candidates(t))).select("rule_id", "scheduled_date", "event_id", "position")


@query("digest_preview_counts", f"""WITH {_CANDIDATES} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, count(*) candidate_count
FROM cands GROUP BY ALL""")
def digest_preview_counts(t: Tables) -> DataFrame:
    return _day(dg.preview(_candidates(t), t.events, t.persons)[0])


@query("digest_preview_sample", f"""WITH {_PLACED} SELECT c.rule_id, c.scheduled_date::VARCHAR scheduled_date, pos "position", c.event_id, p.name person_name,
  c.event_type, e.title FROM placed c JOIN tl_events e ON e.event_id = c.event_id JOIN tl_persons p ON p.person_id = c.person_id WHERE pos <= 2""")
def digest_preview_sample(t: Tables) -> DataFrame:
    return _day(dg.preview(_candidates(t), t.events, t.persons, 2)[1]).drop("start_at", "person_id")


def _runs(t: Tables, cands: DataFrame) -> DataFrame:
    return dg.create_runs(_windows(t), cands, t.rules)


@query("digest_runs_created", f"""WITH {_RUNS} SELECT r.rule_id, r.scheduled_date::VARCHAR scheduled_date, r.status, r.candidate_count
FROM runs r JOIN tl_rules u ON u.rule_id = r.rule_id WHERE r.scheduled_date >= (u.enabled_at + INTERVAL 8 HOUR)::DATE
 AND NOT (r.rule_id % 2 = 0 AND r.scheduled_date < DATE '1995-01-01')""")
def digest_runs_created(t: Tables) -> DataFrame:
    ledger = t.rule_dates.where((F.col("rule_id") % 2 == 0) & (F.col("scheduled_date") < "1995-01-01"))
    return _day(dg.create_runs(_windows(t), _candidates(t), t.rules, ledger, trigger="manual")).select(
        "rule_id", "scheduled_date", "status", "candidate_count")


@query("digest_batches", f"""WITH {_RUNS} SELECT r.rule_id, r.scheduled_date::VARCHAR scheduled_date, c.recipient, p.part_number::INT part_number
FROM (SELECT *, CASE WHEN candidate_count = 0 AND send_when_empty THEN 1 ELSE (candidate_count + {CHUNK - 1}) // {CHUNK} END parts FROM runs) r
JOIN tl_rule_recipients c ON c.rule_id = r.rule_id, unnest(range(1, r.parts::BIGINT + 1)) p(part_number)""")
def digest_batches(t: Tables) -> DataFrame:
    return _day(dg.batches(_runs(t, _candidates(t)), t.rule_recipients, CHUNK)).select(
        "rule_id", "scheduled_date", "recipient", "part_number")


@query("digest_items", f"""WITH {_PLACED} SELECT p.rule_id, p.scheduled_date::VARCHAR scheduled_date, p.event_id, c.recipient,
  ((pos + {CHUNK - 1}) // {CHUNK})::INT part_number FROM placed p JOIN tl_rule_recipients c ON c.rule_id = p.rule_id""")
def digest_items(t: Tables) -> DataFrame:
    cands = _candidates(t)
    runs = _runs(t, cands)
    out = dg.items(runs, cands, t.rule_recipients, CHUNK).join(runs.select("run_id", "rule_id", "scheduled_date"), "run_id")
    return _day(out).select("rule_id", "scheduled_date", "event_id", "recipient", "part_number")


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("digest_texts", f"""WITH {_RUNS}, names AS (SELECT event_id, string_agg(name, ',' ORDER BY name) source_names FROM (SELECT DISTINCT src.event_id, s.name
  FROM src JOIN tl_sources s ON s.source_id = src.source_id) GROUP BY 1),
parts AS (SELECT r.rule_id, r.scheduled_date, r.rule_name, r.window_start, r.window_end, c.recipient, u.part_number
  FROM (SELECT *, CASE WHEN candidate_count = 0 AND send_when_empty THEN 1 ELSE (candidate_count + {CHUNK - 1}) // {CHUNK} END parts FROM runs) r
  JOIN tl_rule_recipients c ON c.rule_id = r.rule_id, unnest(range(1, r.parts::BIGINT + 1)) u(part_number)),
entries AS (SELECT p.rule_id, p.scheduled_date, (pos + {CHUNK - 1}) // {CHUNK} part_number, count(*) n,
  string_agg(((pos - 1) % {CHUNK} + 1) || '. [' || CASE p.event_type WHEN 'itinerary' THEN '行程' WHEN 'statement' THEN '言论' ELSE '其他' END || '] '
   || q.name || ' · ' || e.title || chr(10) || '时间：' || coalesce(strftime(e.start_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M'), '时间未知') || '（北京时间）'
   || chr(10) || '地点：' || CASE e.location_name WHEN '' THEN '未披露' ELSE e.location_name END || chr(10) || '状态：' || e.confirmation_status || ' / '
   || e.review_status || chr(10) || '来源：' || coalesce(n.source_names, '来源未知') || chr(10) || e.summary || chr(10)
   || '详情：https://t.example.org/?event_id=' || e.event_id, chr(10) || chr(10) ORDER BY pos) body
  FROM placed p JOIN tl_events e ON e.event_id = p.event_id JOIN tl_persons q ON q.person_id = p.person_id
  LEFT JOIN names n ON n.event_id = p.event_id GROUP BY ALL)
SELECT b.rule_id, b.scheduled_date::VARCHAR scheduled_date, b.recipient, coalesce(e.n, 0) event_count,
  'T ' || b.rule_name || '日报 ' || b.scheduled_date::VARCHAR || '：' || coalesce(e.n, 0) || ' 条事件' ||
  CASE WHEN b.part_number > 1 THEN '（第 ' || b.part_number || ' 部分）' ELSE '' END subject,
  '汇总窗口：' || strftime(b.window_start + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' 至 ' || strftime(b.window_end + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')
  || '（北京时间，左闭右开）' || chr(10) || chr(10) || coalesce(e.body, '本期没有符合规则的公开动态。') plain
FROM parts b LEFT JOIN entries e ON e.rule_id = b.rule_id AND e.scheduled_date = b.scheduled_date AND e.part_number = b.part_number""")
def digest_texts(t: Tables) -> DataFrame:
    cands = _candidates(t)
    runs = _runs(t, cands)
    rows = dg.batches(runs, t.rule_recipients, CHUNK)
    out = dg.render_batches(rows, dg.items(runs, cands, t.rule_recipients, CHUNK), runs, t.rules, t.events, t.persons,
                            t.evidence, t.documents, t.sources, "https://t.example.org/", "T")
    out = out.join(runs.select("run_id", "rule_id", "scheduled_date"), "run_id")
    return _day(out).select("rule_id", "scheduled_date", "recipient", "event_count", "subject", "plain")


@query("digest_rules", """SELECT r.rule_id, r.name, r.types event_types, coalesce(p.ids, '') person_ids, coalesce(c.ids, '') recipients, coalesce(s.ids, '') source_ids
FROM tl_rules r LEFT JOIN (SELECT rule_id, string_agg(person_id::VARCHAR, ',' ORDER BY person_id) ids FROM tl_rule_persons GROUP BY 1) p ON p.rule_id = r.rule_id
LEFT JOIN (SELECT rule_id, string_agg(recipient, ',' ORDER BY recipient) ids FROM tl_rule_recipients GROUP BY 1) c ON c.rule_id = r.rule_id
LEFT JOIN (SELECT rule_id, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) ids FROM tl_rule_sources GROUP BY 1) s ON s.rule_id = r.rule_id
WHERE NOT deleted""")
def digest_rules(t: Tables) -> DataFrame:
    out = dg.hydrate_rules(t.rules, t.rule_persons, t.rule_recipients, t.rule_sources)
    return out.select("rule_id", "name", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
                                           for c in ("event_types", "person_ids", "recipients", "source_ids")])


@query("digest_rule_rejects", """SELECT n_nationkey::BIGINT rule_id, CASE WHEN n_nationkey % 3 = 2 THEN 'event_type'
 WHEN n_nationkey % 7 = 3 THEN 'send_time' WHEN 12 + n_nationkey * 12 > 168 THEN 'rolling_hours'
 WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) THEN 'person_unavailable'
 ELSE 'ok' END reason FROM nation WHERE reason <> 'ok'""")
def digest_rule_rejects(t: Tables) -> DataFrame:
    full = dg.hydrate_rules(t.rules, t.rule_persons, t.rule_recipients, t.rule_sources, include_deleted=True)
    full = full.withColumn("event_types", F.from_json("event_types_json", "array<string>")).withColumn(
        "send_time", F.when(F.col("rule_id") % 7 == 3, "24:00").otherwise(F.col("send_time"))).withColumn(
        "rolling_hours", (12 + F.col("rule_id") * 12).cast("int"))
    return dg.validate_rules(full, t.persons, t.sources)[1]


@query("item_split", f"""SELECT batch_id, i.event_id, e.event_id IS NOT NULL deliverable FROM tl_items i LEFT JOIN
 (SELECT event_id FROM tl_events WHERE review_status <> 'rejected') e ON e.event_id = i.event_id""")
def item_split(t: Tables) -> DataFrame:
    return dg.split_deliverable(t.items, t.events).select("batch_id", "event_id", "deliverable")


_AS_OF = "1996-06-01 00:00:00"


@query("delivery_due", f"SELECT batch_id FROM tl_batches WHERE status IN ('pending', 'retrying') AND next_attempt_at <= TIMESTAMP '{_AS_OF}'")
def delivery_due(t: Tables) -> DataFrame:
    return dl.due_batches(t.batches, F.lit(_AS_OF).cast("timestamp")).select("batch_id")


_OUT = """SELECT o_orderkey batch_id, CASE o_custkey % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'skipped' END result,
 'SMTP: bad r' || o_custkey || '@example.org' || chr(10) || 'gone' error FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM')"""


@query("delivery_outcomes", f"""SELECT b.batch_id, CASE WHEN result = 'failed' AND attempt_count + 1 >= 4 THEN 'failed' WHEN result = 'failed' THEN 'retrying'
 ELSE coalesce(result, status) END status, CASE WHEN result IN ('sent', 'failed') THEN attempt_count + 1 ELSE attempt_count END attempt_count,
 strftime(CASE WHEN result = 'failed' THEN TIMESTAMP '{_AS_OF}' + to_seconds((60 * pow(2, attempt_count))::BIGINT) ELSE next_attempt_at END, {_F}) next_attempt_at,
 CASE WHEN result = 'failed' THEN 'SMTP: bad [email] gone' WHEN result IS NULL THEN last_error ELSE '' END last_error
FROM tl_batches b LEFT JOIN ({_OUT}) o ON o.batch_id = b.batch_id""")
def delivery_outcomes(t: Tables) -> DataFrame:
    o = t.raw("orders").where(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"))
    outcomes = o.select(F.col("o_orderkey").alias("batch_id"),
                        F.when(F.col("o_custkey") % 3 == 0, "sent").when(F.col("o_custkey") % 3 == 1, "failed")
                        .otherwise("skipped").alias("result"),
                        F.concat(F.lit("SMTP: bad r"), F.col("o_custkey"), F.lit("@example.org\ngone")).alias("error"))
    out = dl.apply_outcomes(t.batches, outcomes, F.lit(_AS_OF).cast("timestamp"), max_attempts=4)
    return out.select("batch_id", "status", "attempt_count", seconds_text(F.col("next_attempt_at")).alias("next_attempt_at"), "last_error")


@query("delivery_recover", f"""SELECT batch_id, CASE status WHEN 'sending' THEN 'retrying' ELSE status END status,
 strftime(CASE status WHEN 'sending' THEN TIMESTAMP '{_AS_OF}' ELSE next_attempt_at END, {_F}) next_attempt_at FROM tl_batches""")
def delivery_recover(t: Tables) -> DataFrame:
    return dl.recover(t.batches, F.lit(_AS_OF).cast("timestamp")).select(
        "batch_id", "status", seconds_text(F.col("next_attempt_at")).alias("next_attempt_at"))


@query("delivery_retry", """SELECT batch_id, CASE WHEN status = 'failed' AND o_custkey % 2 = 0 THEN 'retrying' ELSE status END status,
 CASE WHEN status = 'failed' AND o_custkey % 2 = 0 THEN 0 ELSE attempt_count END attempt_count FROM tl_batches JOIN orders ON o_orderkey = batch_id""")
def delivery_retry(t: Tables) -> DataFrame:
    chosen = t.raw("orders").where(F.col("o_custkey") % 2 == 0).select(F.col("o_orderkey").alias("batch_id"))
    return dl.retry(t.batches, chosen, F.lit(_AS_OF).cast("timestamp")).select("batch_id", "status", "attempt_count")


@query("run_status_rollup", """SELECT r.run_id, CASE WHEN total IS NULL THEN 'empty' WHEN active > 0 THEN CASE WHEN sent > 0 THEN 'sending' ELSE 'pending' END
 WHEN failed > 0 AND sent > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' WHEN sent > 0 THEN 'sent' ELSE 'skipped' END status,
 coalesce(sent, 0)::BIGINT sent_count, coalesce(failed, 0)::BIGINT failed_count FROM tl_runs r LEFT JOIN (SELECT run_id, count(*) total,
 sum((status = 'sent')::INT) sent, sum((status = 'failed')::INT) failed, sum((status IN ('pending', 'sending', 'retrying'))::INT) active
 FROM tl_batches GROUP BY 1) b ON b.run_id = r.run_id""")
def run_status_rollup(t: Tables) -> DataFrame:
    return dl.run_status(t.batches, t.runs)


@query("digest_run_batches", """SELECT batch_id, run_id, substr(recipient, 1, 1) || '***@example.org' recipient, coalesce(n, 0) item_count FROM tl_batches
LEFT JOIN (SELECT batch_id b, count(*) n FROM tl_items GROUP BY 1) ON b = batch_id""")
def digest_run_batches(t: Tables) -> DataFrame:
    return dg.digest_run_detail(t.batches, t.items, t.events, t.persons)["batches"].select("batch_id", "run_id", "recipient", "item_count")


@query("digest_run_items", """SELECT batch_id, i.event_id, e.title, e.event_type, p.name person_name FROM tl_items i
LEFT JOIN tl_events e ON e.event_id = i.event_id LEFT JOIN tl_persons p ON p.person_id = e.person_id""")
def digest_run_items(t: Tables) -> DataFrame:
    return dg.digest_run_detail(t.batches, t.items, t.events, t.persons)["items"].select(
        "batch_id", "event_id", "title", "event_type", "person_name")


@query("digest_run_list", f"""WITH {_RUNS} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, rule_name, candidate_count FROM runs
WHERE status = 'pending' ORDER BY scheduled_date DESC, rule_id DESC LIMIT 200""")
def digest_run_list(t: Tables) -> DataFrame:
    from annalist.operators.timeline import page
    listed = dg.digest_runs(_runs(t, _candidates(t)), t.rules, status="pending")
    return _day(page(listed, [F.col("scheduled_date").desc(), F.col("rule_id").desc()], 1, 200)).select(
        "rule_id", "scheduled_date", "rule_name", "candidate_count")


@query("delivery_list", """SELECT b.batch_id, r.task_id, t.name task_name, coalesce(n, 0) item_count FROM tl_batches b JOIN tl_runs r ON r.run_id = b.run_id
JOIN tl_tasks t ON t.task_id = r.task_id LEFT JOIN (SELECT batch_id k, count(*) n FROM tl_items GROUP BY 1) ON k = b.batch_id WHERE b.status = 'failed'""")
def delivery_list(t: Tables) -> DataFrame:
    return dl.deliveries(t.batches, t.items, t.runs, t.tasks, status="failed").select("batch_id", "task_id", "task_name", "item_count")


@query("delivery_detail", """SELECT batch_id, i.event_id, e.title, e.event_type, p.name person_name FROM tl_items i
LEFT JOIN tl_events e ON e.event_id = i.event_id LEFT JOIN tl_persons p ON p.person_id = e.person_id""")
def delivery_detail(t: Tables) -> DataFrame:
    return dl.delivery_detail(t.items, t.events, t.persons).select("batch_id", "event_id", "title", "event_type", "person_name")


@query("delivery_texts", """WITH names AS (SELECT event_id, string_agg(name, ',' ORDER BY name) source_names FROM (SELECT DISTINCT v.event_id, s.name
  FROM tl_evidence v JOIN tl_documents d ON d.document_id = v.document_id JOIN tl_sources s ON s.source_id = d.source_id) GROUP BY 1),
entries AS (SELECT i.batch_id, count(*) n, string_agg(num || '. [' || CASE i.event_type WHEN 'itinerary' THEN '行程' WHEN 'statement' THEN '言论' ELSE '其他' END
   || '] ' || i.name || ' · ' || i.title || chr(10) || '时间：' || coalesce(strftime(i.start_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M'), '时间未知') || '（北京时间）'
   || chr(10) || '地点：' || CASE i.location_name WHEN '' THEN '未披露' ELSE i.location_name END || chr(10) || '状态：' || i.confirmation_status || ' / '
   || i.review_status || chr(10) || '来源：' || coalesce(n.source_names, '来源未知') || chr(10) || i.summary, chr(10) || chr(10) ORDER BY num) body
  FROM (SELECT x.batch_id, e.*, p.name, row_number() OVER (PARTITION BY x.batch_id ORDER BY x.event_id) num FROM tl_items x
   JOIN tl_events e ON e.event_id = x.event_id AND e.review_status <> 'rejected' JOIN tl_persons p ON p.person_id = e.person_id) i
  LEFT JOIN names n ON n.event_id = i.event_id GROUP BY 1)
SELECT b.batch_id, CASE WHEN e.n IS NULL THEN 'skip' ELSE 'deliver' END outcome, t.name || '：新增 ' || coalesce(e.n, 0) || ' 条事件' ||
  CASE WHEN b.part_number > 1 THEN '（第 ' || b.part_number || ' 部分）' ELSE '' END subject, coalesce(e.body, '') plain
FROM tl_batches b JOIN tl_runs r ON r.run_id = b.run_id JOIN tl_tasks t ON t.task_id = r.task_id LEFT JOIN entries e ON e.batch_id = b.batch_id""")
def delivery_texts(t: Tables) -> DataFrame:
    items = t.items.withColumn("item_id", F.col("event_id"))
    return dg.render_run_batches(t.batches, items, t.tasks, t.runs, t.events, t.persons, t.evidence, t.documents,
                                 t.sources).select("batch_id", "outcome", "subject", "plain")


@query("digest_missed_late", f"""WITH {_CANDIDATES} SELECT rule_id, scheduled_date::VARCHAR scheduled_date, event_id FROM cands WHERE event_id % 4 = 3""")
def digest_missed_late(t: Tables) -> DataFrame:
    """Every fourth event arrives after its digest was made."""
    cands = _candidates(t)
    early = dg.digest_candidates(_windows(t), t.rules, t.rule_persons, t.rule_sources, t.events.where("event_id % 4 <> 3"),
                                 t.persons, t.evidence, t.documents)
    runs = _runs(t, early)
    made = dg.items(runs, early, t.rule_recipients, CHUNK)
    return _day(dg.missed_by_digest(cands, made, runs)).select("rule_id", "scheduled_date", "event_id")
