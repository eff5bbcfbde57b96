"""The progressive audit as a state machine per thread, kept by the stream's state store.

Events of a session's batch arrive in any order. A thread's state holds those that the watermark has not passed; passed ones
are taken in the order of their time, so what listeners are told depends on the events alone, not on their arrival, as long
as none is later than the delay. A newer run of a batch supersedes an older one at once. A first verdict goes out before its
patches; a gate stops the run until a correction, and what came meanwhile is held; an error or a result ends it.

The state of a thread is one row: its events within the delay, and those held by a stop. Threads are independent, so the work
spreads over as many tasks as the state has partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millcheck.streaming.progressive import gate, thread_key

OUT = "thread string, run_id long, seq long, kind string, gate string, event_id long, ts timestamp"
NEW = {"stopped": False, "corrected": False, "tier1": False, "over": False, "held": [], "patches": []}


def said(state: dict, e: dict) -> list[tuple[str, str | None, dict]]:
    """What a listener is told when an event is taken, as (kind, gate, event); changes the state."""
    if state["run"] is None or e["run"] > state["run"]:
        state |= {k: list(v) if isinstance(v, list) else v for k, v in NEW.items()} | {"run": e["run"]}
    if e["run"] < state["run"] or state["over"]:
        return []
    stage, out = e["stage"], []

    def first() -> None:
        state["tier1"] = True
        out.append(("tier1_ready", None, e))
        out.extend(("tier2_patch", None, p) for p in state["patches"])
        state["patches"] = []

    if stage == "error":
        state["over"] = True
        return [("error", None, e)]
    if stage == "correction":
        if state["stopped"]:
            held, state["held"] = state["held"], []
            state |= {"stopped": False, "corrected": True}
            out.append(("resumed", None, e))
            if not state["tier1"]:
                first()
            for h in held:
                out += said(state, h)
        return out
    if state["stopped"]:
        state["held"].append(e)
    elif stage == "deterministic_eval" and e["gate"] and not state["corrected"]:
        state["stopped"] = True
        out.append(("hitl_interrupt", e["gate"], e))
    elif stage == "deterministic_eval" and not state["tier1"]:
        first()
    elif stage == "reevaluated" and state["tier1"]:
        out.append(("tier2_patch", None, e))
    elif stage == "reevaluated":
        state["patches"].append(e)
    elif stage == "done":
        if not state["tier1"]:
            first()
        state["over"] = True
        out.append(("complete", None, e))
    return out


def advance(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """Takes a thread's events that the watermark has passed, in order, and keeps the others."""
    state = json.loads(group.get[0]) if group.exists else {"run": None, "seq": 0, "waiting": [], **NEW, "held": [], "patches": []}
    for p in parts:
        state["waiting"] += [{"run": int(r), "stage": s, "gate": g if isinstance(g, str) else None, "id": int(i), "at": int(t)} for r, s, g, i, t in zip(p["run_id"], p["stage"], p["gate"], p["event_id"], p["at"])]
    passed = group.getCurrentWatermarkMs() * 1000
    ready = sorted((e for e in state["waiting"] if e["at"] // 1000 * 1000 < passed), key=lambda e: (e["at"], e["id"]))
    state["waiting"] = [e for e in state["waiting"] if e["at"] // 1000 * 1000 >= passed]
    rows = []
    for e in ready:
        for kind, stop, of in said(state, e):
            state["seq"] += 1
            rows.append((key[0], state["run"], state["seq"], kind, stop, of["id"], of["at"]))
    group.update((json.dumps(state),))
    if state["waiting"]:
        group.setTimeoutTimestamp(max(min(e["at"] for e in state["waiting"]) // 1000, group.getCurrentWatermarkMs() + 1))
    if rows:
        out = pd.DataFrame(rows, columns=["thread", "run_id", "seq", "kind", "gate", "event_id", "ts"])
        yield out.assign(ts=pd.to_datetime(out["ts"], unit="us"))


def threads(events: DataFrame, delay: str) -> DataFrame:
    """A stream of what listeners are told: thread, run_id, seq (in the order told), kind, gate (of a stop), event_id, ts.

    events, a stream: session_id, batch_id, run_id long (null: older than any), stage, event_id, ts, and the columns of GATES.
    Stages: deterministic_eval, reevaluated, done, error, correction; others say nothing. Rows without a session, a batch or a
    time are left out. delay: how much later than the newest event one may come."""
    rows = events.where("session_id is not null and batch_id is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select(thread_key("session_id", "batch_id", F.lit(None).cast("string")).alias("thread"), F.coalesce("run_id", F.lit(-(1 << 62))).alias("run_id"), F.coalesce("stage", F.lit("")).alias("stage"), gate().alias("gate"), "event_id", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("thread").applyInPandasWithState(advance, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def freed(stops: DataFrame, corrections: DataFrame, within: str) -> DataFrame:
    """A stream of stopped rows (thread, event_id, ts, gate) with each correction (thread, event_id, ts) that comes up to
    `within` after the stop: thread, event_id, gate, correction_id. A stop that none has freed in time comes with null, when
    the watermark says so; until then both sides wait in the state store. Both streams come with their watermark on ts."""
    s = stops.select(F.col("thread").alias("t"), F.col("event_id"), "gate", F.col("ts").alias("stopped"))
    c = corrections.select("thread", F.col("event_id").alias("correction_id"), F.col("ts").alias("corrected"))
    near = (F.col("t") == F.col("thread")) & (F.col("corrected") >= F.col("stopped")) & (F.col("corrected") <= F.col("stopped") + F.expr(f"interval {within}"))
    return s.join(c, near, "left").select(F.col("t").alias("thread"), "event_id", "gate", "correction_id")


def of_all(stream: DataFrame, condition: str) -> DataFrame:
    """The rows of a stream with a watermark on ts that fulfil a condition. The watermark follows all rows: as the filter
    names ts, it is not pushed below it."""
    return stream.where(f"case when ts is not null then {condition} end")


def to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream to its end into files; begun again with the same path it goes on where it stopped, each row written once."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The driver's events as a stream of audit events: a user is a session, five days are a run, a few events are of the run
    before."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    df = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{folder}/{file[:-8]}*")
    stage = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "deterministic_eval").when(F.col("event_type") == "click", "reevaluated").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "correction")
    k, ts = F.get_json_object("props", "$.k").cast("int"), F.col("ts").cast("timestamp")
    run = F.floor(F.unix_seconds(ts) / (5 * 86400)) - F.when(k % 17 == 0, 1).otherwise(0)
    return df.select(
        "event_id", ts.alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("b"), F.col("user_id") % 3).alias("batch_id"), run.cast("long").alias("run_id"), stage.alias("stage"),
        (k % 10 != 0).alias("standard_known"), (k % 7 != 0).alias("grade_known"), F.when(k % 5 == 0, 0.7).otherwise(0.9).alias("confidence"), F.lit("mechanical").alias("category"), F.lit(0.9).alias("property_confidence"),
    )
