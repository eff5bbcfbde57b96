"""Queries of the ledger, logs, cached documents, aliases and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators import ledger
from millcheck.plans.mapping import table
from millcheck.queries import query

VERDICT = "CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'HITL' ELSE 'PENDING' END"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a session, an order a batch."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("batch_id"), F.expr(VERDICT).alias("verdict"), F.col("o_orderpriority").alias("grade"), F.col("o_orderstatus").alias("standard"), F.lit(None).cast("string").alias("supplier"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches(spark, sf_dir).groupBy("session_id").agg(F.collect_list(F.struct("verdict", "grade", "standard", "supplier")).alias("batches"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"))
    return c.join(b, "session_id", "left").withColumn("batches", F.coalesce("batches", F.array().cast("array<struct<verdict:string,grade:string,standard:string,supplier:string>>")))


@query(f"""SELECT o_custkey AS session_id, count(*) AS total, CASE WHEN o_custkey % 10 = 0 THEN 7 ELSE count(*) FILTER (v = 'PASS') END AS passed, count(*) FILTER (v = 'FAIL') AS failed, count(*) FILTER (v = 'HITL') AS hitl, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS grades FROM (SELECT *, {VERDICT} AS v FROM orders) GROUP BY o_custkey""")
def q_ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches(spark, sf_dir)
    none = F.lit(None).cast("long")
    stored = b.select("session_id").distinct().where("session_id % 10 = 0").select("session_id", F.lit(0).cast("long").alias("total"), F.lit(7).cast("long").alias("passed"), none.alias("failed"), none.alias("hitl"))
    return ledger.rollup(b, stored).select("session_id", "total", "passed", "failed", "hitl", F.array_join("grades", ",").alias("grades"))


S = f"s AS (SELECT c_custkey AS session_id, c_name AS title, count(o_orderkey) AS n, count(*) FILTER ({VERDICT} = 'PASS' AND o_orderkey IS NOT NULL) AS p, count(*) FILTER ({VERDICT} = 'FAIL' AND o_orderkey IS NOT NULL) AS f, count(*) FILTER ({VERDICT} = 'HITL' AND o_orderkey IS NOT NULL) AS h, count(*) FILTER ({VERDICT} = 'PENDING' AND o_orderkey IS NOT NULL) AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"WITH {S} SELECT count(*) AS total, count(*) FILTER (n > 0 AND p = n) AS passed, count(*) FILTER (f > 0) AS failed, count(*) FILTER (n = 0 OR w > 0) AS pending, count(*) FILTER (h > 0) AS hitl, round(count(*) FILTER (n > 0 AND p = n)::DOUBLE / count(*) * 100, 1) AS pass_rate FROM s")
def q_ledger_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.kpis(sessions(spark, sf_dir))


@query(f"WITH {S} SELECT session_id FROM s WHERE f > 0 AND contains(lower(title), '00001')")
def q_ledger_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.search(sessions(spark, sf_dir), ["title"], "00001", "fail").select("session_id")


@query("SELECT o_orderkey AS session_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def q_session_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("saved_at"))
    return ledger.sequence_numbers(s).select("session_id", "seq")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, length(text), text)")
def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("doc_pos"), F.struct(F.length("text"), "text").alias("batch_pos"), F.col("turn").alias("batch_id"))
    return ledger.neighbours(b).select(F.col("session_id").alias("conv_id"), F.col("batch_id").alias("turn"), "previous", "next")


@query("SELECT event_id FROM (SELECT *, max(event_id % 3) OVER (PARTITION BY user_id, event_type) AS newest FROM events) WHERE event_id % 3 = newest")
def q_current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("batch_id"), (F.col("event_id") % 3).alias("run_id"))
    return ledger.current_runs(e).select("event_id")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("info").alias("level"), F.upper("event_type").alias("tag"), F.col("event_type").alias("message"), F.col("props").alias("metadata"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND contains(props, '\"k\": 1')")
def q_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.log_filter(logs(spark, sf_dir), "error", "SYSTEM", '"K": 1').select("event_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200")
def q_log_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_n(ledger.log_filter(logs(spark, sf_dir), None, "click"), 200, "ts", "event_id").select("event_id", "ts")


@query("""SELECT md5, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY tier, id DESC) AS n FROM (SELECT md5(text) AS md5, 1 AS tier, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT md5(text), 2, doc_id FROM documents WHERE lang <> 'en' UNION ALL SELECT md5(html), 3, page_id FROM pages)) WHERE n = 1""")
def q_doc_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    of = lambda x: x.select(F.md5("text").alias("md5"), F.col("doc_id").alias("parsed_at"))
    p = table(spark, sf_dir, "pages").select(F.md5("html").alias("md5"), F.col("page_id").alias("parsed_at"))
    x = ledger.cached_documents(of(d.where("lang = 'en'")), of(d.where("lang <> 'en'")), p)
    return x.select("md5", "tier", F.col("parsed_at").alias("id"))


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source || lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def q_doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("key", F.concat("source", "lang"))
    return ledger.distinct_documents(d, "key", "n_chars", "doc_id").select("source", "lang", "doc_id")


@query("""SELECT key, status, value AS property_key FROM (SELECT upper(event_type) || (user_id % 50) AS key, CASE event_id % 5 WHEN 0 THEN 'revoked' WHEN 1 THEN 'deleted' ELSE 'active' END AS status, (value * 100)::BIGINT::VARCHAR AS value, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND status <> 'deleted'""")
def q_alias_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 5 == 0, "revoked").when(F.col("event_id") % 5 == 1, "deleted").otherwise("active")
    e = table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit("-"), F.col("user_id") % 50).alias("alias"), F.col("ts").alias("event_at"), "event_id", status.alias("status"), F.round(F.col("value") * 100).cast("long").cast("string").alias("property_key"))
    return ledger.alias_registry(e).select("key", "status", "property_key")


@query("SELECT event_type AS element, count(DISTINCT event_id % 10) AS n_hit, count(DISTINCT user_id % 7) AS n_values, round(count(DISTINCT event_id % 10) / 10, 6)::DOUBLE AS hit_rate, count(DISTINCT event_id % 10) = 10 AND count(DISTINCT user_id % 7) = 1 AS stable FROM events GROUP BY 1")
def q_stability_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("run_id"), F.col("event_type").alias("element"), (F.col("user_id") % 7).alias("value"))
    return ledger.stability(r, 10)


@query("SELECT conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2")
def q_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT user_id AS task_id, event_type AS raw_name, min(event_id) AS pos FROM events GROUP BY 1, 2")
def q_keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("raw_name"), F.col("event_id").alias("pos"))
    return ledger.first_by_name(e)


@query("SELECT l_orderkey AS cert_id, count(*) AS n_items, count(*) FILTER (l_returnflag = 'N') AS aligned, count(*) FILTER (l_returnflag = 'R') AS missing, count(*) FILTER (l_returnflag = 'A') AS trace, true AS identity_holds FROM lineitem GROUP BY 1")
def q_zero_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: ledger.count_if(F.col("l_returnflag") == s)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cert_id")).agg(F.count("*").alias("n_items"), n("N").alias("aligned"), n("R").alias("missing"), n("A").alias("trace"))
    return ledger.zero_drop(g, "n_items", "aligned", "missing", "trace")


@query("SELECT coalesce(o_orderstatus, 'all') AS structure_type, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def q_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("structure_type"), "n")


@query("SELECT l_orderkey AS cert_id, l_linenumber AS pos, k AS property_key, v + 0.0 AS value FROM lineitem UNPIVOT (v FOR k IN (l_quantity, l_discount, l_tax))")
def q_unpivot_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cert_id"), F.col("l_linenumber").alias("pos"), "l_quantity", "l_discount", "l_tax")
    return li.unpivot(["cert_id", "pos"], ["l_quantity", "l_discount", "l_tax"], "property_key", "value").select("cert_id", "pos", "property_key", (F.col("value") + 0.0).alias("value"))


GATED = """e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), g AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'UNKNOWN_STANDARD' WHEN k % 7 = 0 THEN 'UNKNOWN_GRADE' WHEN k % 5 = 0 THEN 'LOW_CONFIDENCE' END AS gate FROM e),
told AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN gate IS NOT NULL THEN 'hitl_interrupt' WHEN event_type = 'view' THEN 'tier1_ready' WHEN event_type = 'click' THEN 'tier2_patch' WHEN event_type = 'purchase' THEN 'complete' END AS kind FROM g)"""


@query(f"WITH {GATED} SELECT kind, coalesce(gate, '-') AS gate, count(*) AS n FROM told WHERE kind IS NOT NULL GROUP BY 1, 2")
def q_stream_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millcheck.streaming.progressive import replay

    return replay(spark, f"{sf_dir}/events.parquet")
