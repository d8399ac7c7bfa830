"""The timeline tables as views over the star schema, so that every query can run on given data.

``tables`` builds them with the DataFrame API; ``CTES`` states the same views in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.similarity import dedup_key
from annalist.operators.persons import GroupLinks
from annalist.session import prepare

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "pages", "benchmark", "labels", "conversations")


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table; local parquet times become UTC times."""
    prepare(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _case(c: Column, mapping: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


class Tables:
    """Lazy stand-in views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return given(self.spark, self.folder, name)

    @property
    def persons(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"),
            F.concat(F.lit("N"), F.col("c_custkey")).alias("native_name"),
            F.col("c_mktsegment").alias("organization"),
            (F.col("c_acctbal") >= 0).alias("enabled"), F.lit(None).cast("timestamp").alias("deleted_at"),
        )

    @property
    def aliases(self) -> DataFrame:
        """Alias = market segment and a number, for every second person."""
        return self.raw("customer").where(F.col("c_custkey") % 2 == 0).select(
            F.col("c_custkey").alias("alias_id"), F.col("c_custkey").alias("person_id"),
            F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey")).alias("alias"),
            (F.col("c_custkey") % 3 != 0).alias("enabled"),
        )

    @property
    def sources(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
            _case((F.col("s_suppkey") % 3).cast("string"), {"0": "rss", "1": "web_page"}, "manual").alias("type"),
            (F.col("s_nationkey") % 5 + 1).alias("trust_level"),
            F.when(F.col("s_suppkey") % 3 == 1, F.concat(
                F.lit('{"discovery_enabled":true,"discovery_max_pages":'), F.col("s_suppkey") % 50, F.lit("}")))
            .when(F.col("s_suppkey") % 7 == 0, F.lit("not json")).otherwise(F.lit("{}")).alias("parser_config"),
            (F.col("s_acctbal") >= 0).alias("enabled"),
            F.when(F.col("s_suppkey") % 11 == 10, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
        )

    @property
    def source_persons(self) -> GroupLinks:
        """Every second supplier is linked with the customers of its nation."""
        return GroupLinks(
            self.raw("supplier").where(F.col("s_suppkey") % 2 == 0).select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("group_id")),
            self.raw("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("group_id")))

    @property
    def events(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_name", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name")
        key = F.col("o_orderkey")
        title = F.concat(F.col("o_orderpriority"), F.lit(" order "), key)
        return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select(
            key.alias("event_id"), F.col("o_custkey").alias("person_id"),
            _case(F.col("o_orderpriority"), {"1-URGENT": "itinerary", "2-HIGH": "itinerary", "3-MEDIUM": "statement",
                                             "4-NOT SPECIFIED": "statement"}, "other").alias("event_type"),
            title.alias("title"),
            F.concat(title, F.lit(" worth "), F.floor("o_totalprice")).alias("summary"),
            F.lit("").alias("quote_text"),
            F.when(key % 10 != 0, F.col("o_orderdate")).alias("start_at"),
            F.lit("").alias("original_timezone"),
            F.when(key % 10 != 0, F.lit("day")).otherwise("unknown").alias("time_precision"),
            F.coalesce(F.col("n_name"), F.lit("")).alias("location_name"),
            _case(F.col("o_orderstatus"), {"F": "completed", "O": "expected"}, "rumored").alias("confirmation_status"),
            F.when(F.col("o_orderstatus") == "P", F.lit("rejected")).when(key % 13 == 0, F.lit("needs_review"))
            .otherwise("approved").alias("review_status"),
            (key % 7 == 0).alias("human_locked"),
            F.when(key % 4 != 0, (key % 180 - 90).cast("double")).alias("latitude"),
            F.when(key % 4 != 0, (key % 360 - 180).cast("double")).alias("longitude"),
            (F.col("o_orderdate") + F.expr("interval 1 day")).alias("created_at"),
        )

    @property
    def evidence(self) -> DataFrame:
        """Distinct (order, part) pairs; the evidence text names the part's document."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("event_id"),
                                           F.col("l_partkey").alias("document_id")).distinct()

    @property
    def told_evidence(self) -> DataFrame:
        """Evidence with ids and texts; the text names the part."""
        return self.evidence.select(
            (F.col("event_id") * 1000000 + F.col("document_id")).alias("evidence_id"), "event_id", "document_id",
            F.concat(F.lit("part "), F.col("document_id") % 500).alias("evidence_text"))

    @property
    def keyed_events(self) -> DataFrame:
        """Events with a stored key: that of the title."""
        e = self.events
        return e.withColumn("dedup_key", dedup_key(F.col("person_id"), F.col("event_type"), F.col("start_at"), F.col("title")))

    @property
    def documents(self) -> DataFrame:
        """Parts; the source is the supplier at rank p_partkey modulo the supplier count."""
        ranked = self._ranked_suppliers()
        return self.raw("part").join(ranked, F.col("p_partkey") % F.col("n_sources") == F.col("rank")).select(
            F.col("p_partkey").alias("document_id"), F.col("s_suppkey").alias("source_id"),
            F.col("p_name").alias("title"), F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand")).alias("content_text"),
            F.concat(F.lit("https://example.org/p/"), F.col("p_partkey")).alias("canonical_url"),
            F.when(F.col("p_partkey") % 6 != 0,
                   F.timestamp_seconds(F.lit(883612800) + F.col("p_partkey") % 1000 * 86400)).alias("published_at"),
            F.timestamp_seconds(F.lit(946684800) + F.col("p_partkey") * 60).alias("collected_at"),
            F.when(F.col("p_size") % 2 == 0, F.lit("analyzed")).otherwise("collected").alias("status"),
        )

    def _ranked_suppliers(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey")
        # suppliers are a dimension numbered 0..n-1, so the rank is the key and the count one aggregate
        return s.withColumn("rank", F.col("s_suppkey")).withColumn(
            "n_sources", F.lit(s.count()).cast("bigint"))

    @property
    def tasks(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("task_id"), F.concat(F.lit("Task "), F.col("s_name")).alias("name"),
            F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") >= 0).alias("enabled"))

    @property
    def runs(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("run_id"), F.col("user_id").alias("task_id"),
            _case(F.col("event_type"), {"purchase": "partial_success", "error": "failed"}, "success").alias("status"),
            F.col("ts").alias("started_at"), F.col("props").alias("error_summary"))

    @property
    def batches(self) -> DataFrame:
        """Delivery batches: three parts per run, states by order priority."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("batch_id"), F.floor(F.col("o_orderkey") / 3).cast("bigint").alias("run_id"),
            F.concat(F.lit("r"), F.col("o_custkey"), F.lit("@example.org")).alias("recipient"),
            (F.col("o_orderkey") % 3 + 1).cast("int").alias("part_number"),
            _case(F.col("o_orderpriority"), {"1-URGENT": "sent", "2-HIGH": "pending", "3-MEDIUM": "retrying",
                                             "4-NOT SPECIFIED": "failed"}, "sending").alias("status"),
            (F.col("o_custkey") % 5).cast("int").alias("attempt_count"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
                   F.concat(F.lit("error "), F.col("o_orderkey"))).otherwise("").alias("last_error"),
            F.col("o_orderdate").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("sent_at"))

    @property
    def items(self) -> DataFrame:
        """One item per distinct (order, part); the event is the part number, so some events are missing."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey").distinct()
        return li.select(
            F.col("l_orderkey").alias("batch_id"), F.floor(F.col("l_orderkey") / 3).cast("bigint").alias("run_id"),
            (F.col("l_partkey") * 11).alias("event_id"))

    @property
    def rules(self) -> DataFrame:
        """One digest rule per nation."""
        k = F.col("n_nationkey")
        return self.raw("nation").select(
            k.cast("bigint").alias("rule_id"), F.concat(F.lit("Rule "), F.col("n_name")).alias("name"),
            F.when(k % 3 == 0, F.lit('["itinerary","statement","other"]')).when(k % 3 == 1, F.lit('["statement"]'))
            .otherwise('["other","bogus"]').alias("event_types_json"),
            F.when(k % 2 == 0, F.lit("08:30")).otherwise("21:15").alias("send_time"),
            F.when(k % 4 < 2, F.lit("previous_calendar_day")).otherwise("rolling_hours").alias("window_mode"),
            (F.lit(12) + k * 2).cast("int").alias("rolling_hours"), (k % 5 == 0).alias("send_when_empty"),
            (k % 6 != 5).alias("enabled"), F.timestamp_seconds(F.lit(694224000) + k * 86400).alias("enabled_at"),
            F.timestamp_seconds(F.lit(700000000) + k * 40000).alias("next_run_at"),
            F.when(k == 24, F.timestamp_seconds(F.lit(0))).alias("deleted_at"))

    @property
    def rule_persons(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_nationkey").cast("bigint").alias("rule_id"),
                                           F.col("c_custkey").alias("person_id"))

    @property
    def rule_recipients(self) -> DataFrame:
        base = self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("rule_id"))
        return base.select("rule_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("u")).select(
            "rule_id", F.concat(F.col("u"), F.lit("@example.org")).alias("recipient"))

    @property
    def rule_sources(self) -> DataFrame:
        """Suppliers of the nation, for odd rules only."""
        return self.raw("supplier").where(F.col("s_nationkey") % 2 == 1).select(
            F.col("s_nationkey").cast("bigint").alias("rule_id"), F.col("s_suppkey").alias("source_id"))

    @property
    def rule_dates(self) -> DataFrame:
        """Business dates that occur as order dates, for every rule."""
        dates = self.raw("orders").select(F.to_date("o_orderdate").alias("scheduled_date")).distinct()
        # nations are numbered 0..24
        return dates.select(F.explode(F.expr("sequence(0L, 24L)")).alias("rule_id"), "scheduled_date")

    @property
    def logs(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("run_id"), F.col("turn").alias("log_id"), F.col("role").alias("level"),
            F.col("text").alias("message"))

    @property
    def audit(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("audit_id"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"),
            F.col("props").alias("change_summary"), F.col("ts").alias("created_at"))

    @property
    def users(self) -> DataFrame:
        return self.raw("customer").where(F.col("c_custkey") % 5 != 0).select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))

    @property
    def articles(self) -> DataFrame:
        """Documents as news articles: the source number is the source, the id a synthetic URL."""
        d = self.raw("documents")
        return d.select(
            F.col("doc_id").alias("document_id"),
            F.regexp_extract("source", "(\\d+)$", 1).cast("bigint").alias("source_id"),
            F.concat(F.lit("https://example.org/d/"), F.col("doc_id")).alias("canonical_url"),
            F.substring(F.col("text"), 1, 60).alias("title"), F.col("text").alias("content_text"),
            F.col("lang").alias("language"), F.lit("").alias("author"),
            F.when(F.col("doc_id") % 9 != 0,
                   F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 40 * 43200)).alias("published_at"),
            F.timestamp_seconds(F.lit(1710000000) + F.col("doc_id") * 60).alias("collected_at"))


def _sql_case(column: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {column}='{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {arms} ELSE '{default}' END"


_TITLE = "o_orderpriority || ' order ' || o_orderkey"
CTES = {
    "tl_persons": "SELECT c_custkey person_id, c_name name, 'N' || c_custkey native_name, c_mktsegment organization, "
                  "c_acctbal >= 0 enabled, NULL::TIMESTAMP deleted_at FROM customer",
    "tl_aliases": "SELECT c_custkey alias_id, c_custkey person_id, c_mktsegment || '-' || c_custkey alias, "
                  "c_custkey % 3 <> 0 enabled FROM customer WHERE c_custkey % 2 = 0",
    "tl_sources": "SELECT s_suppkey source_id, s_name name, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'web_page' "
                  "ELSE 'manual' END AS \"type\", s_nationkey % 5 + 1 trust_level, "
                  "s_suppkey % 3 = 1 AS disc, s_suppkey % 50 AS disc_pages, s_acctbal >= 0 enabled, "
                  "CASE WHEN s_suppkey % 11 = 10 THEN TIMESTAMP '1970-01-01' END deleted_at FROM supplier",
    "tl_source_persons": "SELECT s_suppkey source_id, c_custkey person_id FROM supplier JOIN customer "
                         "ON s_nationkey = c_nationkey WHERE s_suppkey % 2 = 0",
    "tl_events": f"SELECT o_orderkey event_id, o_custkey person_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'itinerary' "
                 "WHEN '2-HIGH' THEN 'itinerary' WHEN '3-MEDIUM' THEN 'statement' WHEN '4-NOT SPECIFIED' THEN 'statement' "
                 f"ELSE 'other' END event_type, {_TITLE} title, {_TITLE} || ' worth ' || floor(o_totalprice)::BIGINT summary, "
                 "'' quote_text, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END start_at, "
                 "CASE WHEN o_orderkey % 10 <> 0 THEN 'day' ELSE 'unknown' END time_precision, "
                 "coalesce(n_name, '') location_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'expected' "
                 "ELSE 'rumored' END confirmation_status, CASE WHEN o_orderstatus = 'P' THEN 'rejected' "
                 "WHEN o_orderkey % 13 = 0 THEN 'needs_review' ELSE 'approved' END review_status, "
                 "o_orderkey % 7 = 0 human_locked, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 180 - 90)::DOUBLE END latitude, "
                 "CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 360 - 180)::DOUBLE END longitude, "
                 "o_orderdate + INTERVAL 1 DAY created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
                 "LEFT JOIN nation ON c_nationkey = n_nationkey",
    "tl_evidence": "SELECT DISTINCT l_orderkey event_id, l_partkey document_id FROM lineitem",
    "tl_told": "SELECT event_id * 1000000 + document_id evidence_id, event_id, document_id, 'part ' || document_id % 500 evidence_text FROM tl_evidence",
    "tl_keyed": "SELECT *, sha256(person_id || '|' || event_type || '|' || coalesce(strftime(start_at, '%Y-%m-%d'), '') || '|' || "
                "lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g'))) dedup_key FROM tl_events",
    "tl_documents": "SELECT p_partkey document_id, s_suppkey source_id, p_name title, p_name || ' by ' || p_brand content_text, "
                    "'https://example.org/p/' || p_partkey canonical_url, CASE WHEN p_partkey % 6 <> 0 THEN "
                    "TIMESTAMP '1998-01-01' + to_days((p_partkey % 1000)::INT) END published_at, "
                    "TIMESTAMP '2000-01-01' + to_minutes(p_partkey) collected_at, "
                    "CASE WHEN p_size % 2 = 0 THEN 'analyzed' ELSE 'collected' END status "
                    "FROM part JOIN supplier ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey",
    "tl_tasks": "SELECT s_suppkey task_id, 'Task ' || s_name name, s_suppkey source_id, s_acctbal >= 0 enabled FROM supplier",
    "tl_runs": "SELECT event_id run_id, user_id task_id, CASE event_type WHEN 'purchase' THEN 'partial_success' WHEN 'error' "
               "THEN 'failed' ELSE 'success' END status, ts started_at, props error_summary FROM events",
    "tl_batches": "SELECT o_orderkey batch_id, o_orderkey // 3 run_id, 'r' || o_custkey || '@example.org' recipient, "
                  "(o_orderkey % 3 + 1)::INT part_number, CASE o_orderpriority WHEN '1-URGENT' THEN 'sent' WHEN '2-HIGH' THEN "
                  "'pending' WHEN '3-MEDIUM' THEN 'retrying' WHEN '4-NOT SPECIFIED' THEN 'failed' ELSE 'sending' END status, "
                  "(o_custkey % 5)::INT attempt_count, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'error ' || o_orderkey "
                  "ELSE '' END last_error, o_orderdate next_attempt_at FROM orders",
    "tl_items": "SELECT DISTINCT l_orderkey batch_id, l_orderkey // 3 run_id, l_partkey * 11 event_id FROM lineitem",
    "tl_rules": "SELECT n_nationkey::BIGINT rule_id, 'Rule ' || n_name name, CASE n_nationkey % 3 WHEN 0 THEN "
                "'itinerary,statement,other' WHEN 1 THEN 'statement' ELSE 'other' END types, "
                "CASE WHEN n_nationkey % 2 = 0 THEN '08:30' ELSE '21:15' END send_time, CASE WHEN n_nationkey % 4 < 2 THEN "
                "'previous_calendar_day' ELSE 'rolling_hours' END window_mode, 12 + n_nationkey * 2 rolling_hours, "
                "n_nationkey % 5 = 0 send_when_empty, n_nationkey % 6 <> 5 enabled, "
                "to_timestamp(694224000 + n_nationkey * 86400)::TIMESTAMP enabled_at, "
                "to_timestamp(700000000 + n_nationkey * 40000)::TIMESTAMP next_run_at, n_nationkey = 24 deleted FROM nation",
    "tl_rule_persons": "SELECT c_nationkey::BIGINT rule_id, c_custkey person_id FROM customer",
    "tl_rule_recipients": "SELECT n_nationkey::BIGINT rule_id, u || '@example.org' recipient FROM nation, (VALUES ('a'), ('b')) t(u)",
    "tl_rule_sources": "SELECT s_nationkey::BIGINT rule_id, s_suppkey source_id FROM supplier WHERE s_nationkey % 2 = 1",
    "tl_rule_dates": "SELECT n_nationkey::BIGINT rule_id, d scheduled_date FROM nation, "
                     "(SELECT DISTINCT o_orderdate::DATE d FROM orders) t",
    "tl_articles": "SELECT doc_id document_id, regexp_extract(source, '(\\d+)$', 1)::BIGINT source_id, "
                   "'https://example.org/d/' || doc_id canonical_url, substr(text, 1, 60) title, text content_text, lang \"language\", "
                   "CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(doc_id % 40 * 43200) END published_at, "
                   "TIMESTAMP '2024-03-09 16:00:00' + to_minutes(doc_id) collected_at FROM documents",
}


def with_views(sql: str) -> str:
    """Put the views a statement names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name in needed or not _names(text, name):
                continue
            visit(body)
            needed.append(name)

    visit(sql)
    head = ", ".join(f"{name} AS ({CTES[name]})" for name in needed)
    sql = sql.strip()
    if not head:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"


def _names(text: str, name: str) -> bool:
    at = text.find(name)
    while at >= 0:
        end = at + len(name)
        if end == len(text) or not (text[end].isalnum() or text[end] == "_"):
            return True
        at = text.find(name, at + 1)
    return False
