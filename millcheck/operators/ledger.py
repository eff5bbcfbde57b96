"""The ledger of audit sessions, log search, and tables of cached documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.operators.lineage import cut
from millcheck.operators.lookup import contains_any, first_of


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1)).cast("long")


def rollup(batches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A row per session of batches (session_id, verdict, grade, standard, supplier): counts and distinct names. Totals
    stored with the session (session_id, total, passed, failed, hitl) win over counted ones; a stored total of zero
    does not."""
    names = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    g = batches.groupBy("session_id").agg(F.count("*").cast("long").alias("total"), count_if(F.col("verdict") == "PASS").alias("passed"), count_if(F.col("verdict") == "FAIL").alias("failed"), count_if(F.col("verdict") == "HITL").alias("hitl"), names("grade"), names("standard"), names("supplier"))
    if stored is None:
        return g
    s = stored.select("session_id", *(F.col(c).alias(f"{c}_") for c in ("total", "passed", "failed", "hitl")))
    x = g.join(s, "session_id", "left")
    return x.select("session_id", F.coalesce(F.nullif("total_", F.lit(0)), "total").alias("total"), *(F.coalesce(f"{c}_", c).alias(c) for c in ("passed", "failed", "hitl")), "grades", "standards", "suppliers")


def is_passed(batches: Column) -> Column:
    return (F.size(batches) > 0) & F.forall(batches, lambda b: b["verdict"] == "PASS")


def is_failed(batches: Column) -> Column:
    return F.exists(batches, lambda b: b["verdict"] == "FAIL")


def is_hitl(batches: Column) -> Column:
    return F.exists(batches, lambda b: b["verdict"] == "HITL")


def is_pending(batches: Column) -> Column:
    return (F.size(batches) == 0) | F.exists(batches, lambda b: b["verdict"].isin("PENDING", "UNAUDITED"))


def kpis(sessions: DataFrame) -> DataFrame:
    """One row: sessions in all and by bucket (buckets overlap), and the share passed in percent to one decimal, 100 for
    no session."""
    b = F.col("batches")
    g = sessions.agg(F.count("*").cast("long").alias("total"), count_if(is_passed(b)).alias("passed"), count_if(is_failed(b)).alias("failed"), count_if(is_pending(b)).alias("pending"), count_if(is_hitl(b)).alias("hitl"))
    return g.withColumn("pass_rate", F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.try_divide(F.col("passed").cast("double"), F.col("total")) * 100, 1)))


def search(sessions: DataFrame, columns: list[str], q: str = "", bucket: str = "all") -> DataFrame:
    """Sessions of a bucket (pass, fail, pending, hitl, all) with q in one of the columns or a batch's names."""
    b = F.col("batches")
    test = {"pass": is_passed, "fail": is_failed, "pending": is_pending, "hitl": is_hitl}.get(bucket)
    x = sessions.where(test(b)) if test else sessions
    if not q.strip():
        return x
    inner = F.exists(b, lambda y: F.coalesce(F.contains(F.lower(F.concat_ws("\n", y["grade"], y["standard"], y["supplier"])), F.lit(q.strip().lower())), F.lit(False)))
    return x.where(contains_any(columns, q.strip()) | inner)


def sequence_numbers(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, saved_at) with seq, their number by time and id. Ranges of both are sorted apart, as many as the
    shuffle has partitions, and each is shifted by the counts of those before; so a day with very many sessions is many tasks.
    The sorted ranges are written out once, as their counts and their rows must be of one partitioning."""
    ranges = sessions.repartitionByRange("saved_at", "session_id").sortWithinPartitions("saved_at", "session_id").withColumn("at_", F.monotonically_increasing_id())
    # the upper bits of that number are the partition, the lower ones count within it
    x = cut(ranges).withColumn("range_", F.shiftrightunsigned("at_", 33)).withColumn("n_", F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = Window.orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    shift = x.groupBy(F.col("range_").alias("r_")).agg(F.count("*").alias("c_")).select("r_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("shift_"))
    # a row per partition
    return x.join(F.broadcast(shift), F.col("range_") == F.col("r_")).withColumn("seq", (F.col("n_") + F.col("shift_")).cast("long")).drop("at_", "range_", "n_", "r_", "c_", "shift_")


def newest_first(sessions: DataFrame, *times: str) -> DataFrame:
    """sessions (session_id, and times, of which the first that is there counts) with position, 1 for the newest; those without a
    time come last, and of equal times the greater id comes first."""
    x = sequence_numbers(sessions.withColumn("saved_at_", F.coalesce(*times)).withColumnsRenamed({"saved_at": "kept_"} if "saved_at" in sessions.columns else {}).withColumnRenamed("saved_at_", "saved_at"))
    n = x.agg(F.max("seq").alias("last_"))
    out = x.crossJoin(F.broadcast(n)).withColumn("position", F.col("last_") - F.col("seq") + 1).drop("seq", "last_", "saved_at")
    return out.withColumnsRenamed({"kept_": "saved_at"} if "kept_" in out.columns else {}).select(*sessions.columns, "position")


def traces(snapshots: DataFrame) -> DataFrame:
    """task_id, trace: what the nodes of a task (task_id, node_pos, items) have noted, one after the other. A node hands on all that
    its collector has, so a note may be there again. A task has a few nodes."""
    g = snapshots.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("node_pos", F.coalesce("items", F.array().cast("array<string>")).alias("items")))).alias("s"))
    return g.select("task_id", F.flatten(F.transform("s", lambda x: x["items"])).alias("trace"))


def neighbours(batches: DataFrame) -> DataFrame:
    """batches (session_id, doc_pos, batch_pos, batch_id) with the ids before and after in flattened order."""
    w = Window.partitionBy("session_id").orderBy("doc_pos", "batch_pos")
    return batches.withColumn("previous", F.lag("batch_id").over(w)).withColumn("next", F.lead("batch_id").over(w))


def current_runs(events: DataFrame) -> DataFrame:
    """Events of the newest run of each batch (session_id, batch_id, run_id)."""
    w = Window.partitionBy("session_id", "batch_id")
    return events.withColumn("newest_", F.max("run_id").over(w)).where("run_id = newest_").drop("newest_")


def log_filter(logs: DataFrame, level: str | None = None, tag: str | None = None, q: str = "") -> DataFrame:
    """logs (level, tag, message, metadata) of a level and tag (SYSTEM and ALL are no filter) with q in a text."""
    x = logs
    if level and level.upper() != "ALL":
        x = x.where(F.lower("level") == level.lower())
    if tag and tag.upper() not in ("SYSTEM", "ALL"):
        x = x.where(F.upper("tag") == tag.upper())
    return x.where(contains_any(["message", "tag", "metadata"], q)) if q.strip() else x


def last_n(logs: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest n rows, n within 1 and 1000, by a top-n that keeps n rows a task."""
    n = max(1, min(1000, n))
    return logs.orderBy(*(F.desc(c) for c in order)).limit(n)


#: Severity of log levels.
SEVERITY = {"debug": 10, "info": 20, "warn": 30, "error": 40, "silent": 99}


def cached_documents(*tiers: DataFrame) -> DataFrame:
    """One row per md5 of the tiers (md5, parsed_at, and more of one shape), from the first tier that has it, newest
    first within a tier."""
    x = None
    for i, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(i))
        x = t if x is None else x.unionByName(t)
    return first_of(x, ["md5"], F.col("tier"), F.desc("parsed_at"))


def valid_cache(cache: DataFrame, version: str) -> DataFrame:
    """Cache rows of a parser version that are complete: not level L2, not pending, some batch not empty."""
    some = F.exists("batches", lambda b: (F.size(b["chemical"]) > 0) | (F.size(b["tests"]) > 0))
    return cache.where((F.col("version") == version) & (F.coalesce("level", F.lit("")) != "L2") & (F.coalesce("status", F.lit("")) != "PENDING") & some)


def distinct_documents(docs: DataFrame, key: str, richness: str, order: str) -> DataFrame:
    """One row per key: the richest, the later of equals."""
    return first_of(docs, [key], F.desc(richness), F.desc(order))


def admitted(name: Column) -> Column:
    """Whether a file's format is one that is read."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(".pdf", ".png", ".jpg", ".jpeg", ".bmp")


def alias_registry(events: DataFrame) -> DataFrame:
    """The state of each learned alias by its latest event (alias, event_at, event_id, status, property_key), without
    deleted ones."""
    latest = events.groupBy(F.upper(F.regexp_replace("alias", r"[\s\-_]", "")).alias("key")).agg(F.max_by(F.struct("status", "property_key", "event_at"), F.struct("event_at", "event_id")).alias("s"))
    return latest.select("key", "s.*").where("status <> 'deleted'")


def stability(runs: DataFrame, n_runs: int) -> DataFrame:
    """Per element of repeated extractions (run_id, element, value): in how many runs, their share, distinct values."""
    g = runs.groupBy("element").agg(F.countDistinct("run_id").cast("long").alias("n_hit"), F.countDistinct("value").cast("long").alias("n_values"))
    return g.withColumn("hit_rate", F.round(F.col("n_hit") / n_runs, 6)).withColumn("stable", (F.col("n_hit") == n_runs) & (F.col("n_values") == 1))


def first_by_name(resolved: DataFrame) -> DataFrame:
    """Keyed merge: the first resolution (pos) of each raw_name of a task stays."""
    return first_of(resolved, ["task_id", "raw_name"], F.col("pos"))


def zero_drop(certs: DataFrame, n_items: str, aligned: str, missing: str, trace: str) -> DataFrame:
    """Certificates with whether every item is accounted for: aligned + missing + trace is the number of items."""
    return certs.withColumn("identity_holds", F.col(aligned) + F.col(missing) + F.col(trace) == F.col(n_items))
