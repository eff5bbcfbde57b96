"""Queries of the stateful streams, versioned tables and the log sink. Their SQL works the same rows out from all rows at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators.lineage import shared_dir
from millcheck.queries import query
from millcheck.sources.versions import Versions, refresh
from millcheck.streaming import log_sink, progressive, threads

#: Events of the tables as the audit's, with the run a thread is in when each comes.
EVENTS = """k AS (SELECT event_id, ts, user_id::VARCHAR || '::b' || (user_id % 3) AS thread, (json_extract_string(props, '$.k'))::INT AS k, event_type, floor(epoch_us(ts) // 1000000 / 432000)::BIGINT AS r FROM events),
e AS (SELECT event_id, ts, thread, r - CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS run, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'eval' WHEN 'click' THEN 'patch' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'correction' END AS stage,
 CASE WHEN k % 10 = 0 THEN 'UNKNOWN_STANDARD' WHEN k % 7 = 0 THEN 'UNKNOWN_GRADE' WHEN k % 5 = 0 THEN 'LOW_CONFIDENCE' END AS gate FROM k)"""
PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 86400000"


@query(f"""WITH {EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ts, event_id) AS pos FROM e WHERE {PASSED}),
live AS (SELECT * FROM (SELECT *, max(run) OVER (PARTITION BY thread ORDER BY pos) AS newest FROM p) WHERE run = newest AND stage IS NOT NULL),
s AS (SELECT *, min(CASE WHEN stage = 'eval' AND gate IS NOT NULL THEN pos END) OVER (PARTITION BY thread, run) AS s FROM live),
c AS (SELECT *, min(CASE WHEN stage = 'correction' AND pos > s THEN pos END) OVER (PARTITION BY thread, run) AS c FROM s),
f AS (SELECT *, CASE WHEN s IS NULL OR pos <= s OR stage IN ('error', 'correction') THEN pos WHEN c IS NOT NULL THEN greatest(pos, c) END AS eff, stage NOT IN ('error', 'correction') AND pos > s AND pos < c AS held FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY eff, coalesce(held, false), pos) AS o FROM f WHERE eff IS NOT NULL),
t AS (SELECT *, min(CASE WHEN (stage = 'eval' AND pos IS DISTINCT FROM s) OR pos = c OR stage = 'done' THEN o END) OVER w AS t1, min(CASE WHEN stage IN ('error', 'done') THEN o END) OVER w AS fin FROM o WINDOW w AS (PARTITION BY thread, run)),
x AS (SELECT thread, run, event_id, NULL AS gate, o AS a, 1 AS b, o AS d, 'tier1_ready' AS kind, fin FROM t WHERE o = t1 UNION ALL SELECT thread, run, event_id, gate, o, 0, o, 'hitl_interrupt', fin FROM t WHERE pos = s UNION ALL SELECT thread, run, event_id, NULL, o, 0, o, 'resumed', fin FROM t WHERE pos = c
 UNION ALL SELECT thread, run, event_id, NULL, greatest(o, t1), 2, o, 'tier2_patch', fin FROM t WHERE stage = 'patch' AND t1 IS NOT NULL UNION ALL SELECT thread, run, event_id, NULL, o, 3, o, 'complete', fin FROM t WHERE stage = 'done' UNION ALL SELECT thread, run, event_id, NULL, o, 0, o, 'error', fin FROM t WHERE stage = 'error')
SELECT thread, run AS run_id, row_number() OVER (PARTITION BY thread ORDER BY run, a, b, d) AS seq, kind, gate, event_id FROM x WHERE fin IS NULL OR a <= fin""")
def q_stream_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = threads.threads(threads.events_stream(spark, f"{sf_dir}/events.parquet"), "1 day")
    return threads.to_table(told, f"{shared_dir(spark)}/threads-{uuid.uuid4().hex}").drop("ts")


@query(f"""WITH {EVENTS}, s AS (SELECT * FROM e WHERE stage = 'eval' AND gate IS NOT NULL), c AS (SELECT * FROM e WHERE stage = 'correction'),
j AS (SELECT s.thread, s.event_id, s.gate, s.ts, c.event_id AS correction_id FROM s LEFT JOIN c ON c.thread = s.thread AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 2 DAY)
SELECT thread, event_id, gate, correction_id FROM j WHERE correction_id IS NOT NULL OR epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 3 * 86400000""")
def q_stream_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = threads.events_stream(spark, f"{sf_dir}/events.parquet").withWatermark("ts", "1 day")
    e = e.select("event_id", "ts", "stage", progressive.gate().alias("gate"), progressive.thread_key("session_id", "batch_id", F.lit(None).cast("string")).alias("thread"))
    stops, corrections = threads.of_all(e, "stage = 'deterministic_eval' and gate is not null"), threads.of_all(e, "stage = 'correction'")
    return threads.to_table(threads.freed(stops, corrections, "2 days"), f"{shared_dir(spark)}/freed-{uuid.uuid4().hex}")


LEDGER = """o AS (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'HITL' END AS verdict, date_trunc('month', o_orderdate)::DATE AS day FROM orders),
l AS (SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'WAIVED' ELSE verdict END AS verdict, CASE WHEN session_id % 10 = 0 THEN DATE '1999-01-01' ELSE day END AS day FROM o WHERE verdict <> 'HITL' OR session_id % 10 = 0)"""


def increments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """All orders as sessions by month, and in three parts."""
    verdict = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("HITL")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("session_id"), verdict.alias("verdict"), F.trunc("o_orderdate", "month").alias("day"))
    return o, [o.where(f"session_id % 3 = {i}") for i in range(3)]


@query(f"WITH {LEDGER} SELECT session_id, verdict, day::VARCHAR AS day, session_id % 3 = 0 AND session_id IN (SELECT session_id FROM o) AS in_first FROM l")
def q_ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends, a deletion and a replacement; the first version can still be read."""
    o, parts = increments(spark, sf_dir)
    ledger = Versions(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", "session_id long, verdict string, day date")
    for p in parts:
        ledger.append(p)
    ledger.change(o.where("verdict = 'HITL'"), "session_id")
    again = o.where("session_id % 10 = 0").select("session_id", F.lit("WAIVED").alias("verdict"), F.lit("1999-01-01").cast("date").alias("day"))
    ledger.change(again, "session_id", again)
    first = ledger.read(1).select("session_id", F.lit(True).alias("in_first"))
    return ledger.read().join(first, "session_id", "left").select("session_id", "verdict", F.col("day").cast("string").alias("day"), F.coalesce("in_first", F.lit(False)).alias("in_first"))


@query(f"WITH {LEDGER} SELECT day::VARCHAR AS day, count(*) AS total, count(*) FILTER (verdict IN ('PASS', 'WAIVED')) AS passed, count(*) FILTER (verdict = 'FAIL') AS failed FROM l GROUP BY 1")
def q_rollup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup by day kept up to date after each change of the ledger; every time only the changed days are worked out."""
    o, parts = increments(spark, sf_dir)
    path = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    ledger = Versions(spark, f"{path}/ledger", "session_id long, verdict string, day date")
    kept = Versions(spark, f"{path}/rollup", "day date, total long, passed long, failed long, source_version long")
    partial = lambda x: x.groupBy("day").agg(F.count("*").alias("total"), F.count(F.when(F.col("verdict").isin("PASS", "WAIVED"), 1)).alias("passed"), F.count(F.when(F.col("verdict") == "FAIL", 1)).alias("failed"))
    for p in parts:
        ledger.append(p)
        refresh(ledger, kept, partial)
    ledger.change(o.where("verdict = 'HITL'"), "session_id")
    refresh(ledger, kept, partial)
    again = o.where("session_id % 10 = 0").select("session_id", F.lit("WAIVED").alias("verdict"), F.lit("1999-01-01").cast("date").alias("day"))
    ledger.change(again, "session_id", again)
    refresh(ledger, kept, partial)
    return kept.read().select(F.col("day").cast("string").alias("day"), "total", "passed", "failed")


@query("SELECT event_id, event_type AS tag, (SELECT count(*) FROM events) AS n_lines FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def q_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept as log lines from a stream; the newest thousand, and how many there are in all."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    file = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(file).schema).option("pathGlobFilter", "*.parquet").parquet(f"{file[:-8]}*").select("event_id", F.col("event_type").alias("tag"), "ts")
    log_sink.sink(stream, path, ("ts", "event_id"))
    n = log_sink.lines(spark, path).agg(F.count("*").alias("n_lines"))
    return log_sink.recent(spark, path, log_sink.RING, "ts", "event_id").crossJoin(F.broadcast(n)).select("event_id", "tag", "n_lines")
