"""The stateful streams: any order of arrival, late events, and a restart from the checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millcheck.streaming import threads

SCHEMA = "session_id string, batch_id string, run_id long, stage string, event_id long, ts timestamp, standard_known boolean, grade_known boolean, confidence double, category string, property_confidence double, thread string, held string"
DAY = dt.datetime(2024, 1, 1)


def event(i, minutes, stage, run=1, session="s", gate=None):
    return (session, "b", run, stage, i, DAY + dt.timedelta(minutes=minutes), gate != "UNKNOWN_STANDARD", True, 0.5 if gate == "LOW_CONFIDENCE" else 0.9, "mechanical", 0.9, "clash", "clash")


def told(spark, path, files, delay="1 hour"):
    """What a stream over the files, one after the other, has told in the end; each is its own run of the stream."""
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = threads.to_table(threads.threads(stream, delay), f"{path}/out")
    return [tuple(r) for r in out.orderBy("thread", "seq").select("thread", "run_id", "seq", "kind", "gate", "event_id").collect()]


END = [event(999, 10_000, "note", session="clock")]


def kinds(rows, thread="s::b"):
    return [(r[3], r[5]) for r in rows if r[0] == thread]


def test_patches_wait_for_the_first_verdict(spark, tmp_path):
    rows = [event(1, 1, "reevaluated"), event(2, 2, "reevaluated"), event(3, 3, "deterministic_eval"), event(4, 4, "reevaluated"), event(5, 5, "done"), event(6, 6, "reevaluated")]
    assert kinds(told(spark, str(tmp_path), [rows, END])) == [("tier1_ready", 3), ("tier2_patch", 1), ("tier2_patch", 2), ("tier2_patch", 4), ("complete", 5)]


def test_a_result_without_first_verdict_brings_it(spark, tmp_path):
    assert kinds(told(spark, str(tmp_path), [[event(1, 1, "reevaluated"), event(2, 2, "done")], END])) == [("tier1_ready", 2), ("tier2_patch", 1), ("complete", 2)]


def test_stop_and_correction(spark, tmp_path):
    rows = [event(1, 1, "deterministic_eval", gate="LOW_CONFIDENCE"), event(2, 2, "reevaluated"), event(3, 3, "done"), event(4, 4, "correction"), event(5, 5, "reevaluated")]
    rows += [event(11, 1, "deterministic_eval", session="never", gate="UNKNOWN_STANDARD"), event(12, 2, "done", session="never"), event(13, 0, "correction", session="never")]
    rows += [event(21, 1, "deterministic_eval", session="bad", gate="UNKNOWN_STANDARD"), event(22, 2, "error", session="bad"), event(23, 3, "correction", session="bad")]
    got = told(spark, str(tmp_path), [rows, END])
    assert kinds(got) == [("hitl_interrupt", 1), ("resumed", 4), ("tier1_ready", 4), ("tier2_patch", 2), ("complete", 3)]
    assert kinds(got, "never::b") == [("hitl_interrupt", 11)] and kinds(got, "bad::b") == [("hitl_interrupt", 21), ("error", 22)]
    assert {r[4] for r in got if r[3] == "hitl_interrupt"} == {"LOW_CONFIDENCE", "UNKNOWN_STANDARD"}


def test_a_newer_run_supersedes(spark, tmp_path):
    rows = [event(1, 1, "deterministic_eval"), event(2, 2, "deterministic_eval", run=2), event(3, 3, "reevaluated"), event(4, 4, "done", run=2), event(5, 5, "done"), event(6, 6, "deterministic_eval", run=None)]
    assert kinds(told(spark, str(tmp_path), [rows, END])) == [("tier1_ready", 1), ("tier1_ready", 2), ("complete", 4)]


def made(seed):
    r = random.Random(seed)
    stages = ["deterministic_eval"] * 3 + ["reevaluated"] * 3 + ["correction"] * 2 + ["done", "error", "note", None]
    rows = [event(i, r.randrange(0, 600), r.choice(stages), r.choice([None, 1, 1, 2, 2, 3]), r.choice("abcdef"), r.choice([None, None, "LOW_CONFIDENCE"])) for i in range(240)]
    return sorted(rows, key=lambda e: (e[5], e[4]))


def brute(rows):
    out = []
    for s in sorted({e[0] for e in rows}):
        state, n = {"run": None}, 0
        for e in rows:
            if e[0] == s:
                run = -(1 << 62) if e[2] is None else e[2]
                for kind, gate, of in threads.said(state, {"run": run, "stage": e[3], "gate": "LOW_CONFIDENCE" if e[8] < 0.8 else None, "id": e[4], "at": 0}):
                    n += 1
                    out.append((f"{s}::b", run, n, kind, gate, of["id"]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_arrival_does_not_matter_and_a_restart_goes_on(spark, tmp_path, seed):
    """Events shuffled within the delay, over three runs of the stream, tell what all events in order tell."""
    rows = made(seed)
    r = random.Random(seed)
    late = sorted(rows, key=lambda e: e[5] + dt.timedelta(minutes=r.randrange(0, 55)))
    files = [late[:80], late[80:170], late[170:], END]
    assert told(spark, str(tmp_path), files) == brute(rows)


def test_events_later_than_the_delay_are_dropped(spark, tmp_path):
    files = [[event(1, 500, "deterministic_eval")], [event(2, 10, "error"), event(3, 501, "done")], END]
    assert kinds(told(spark, str(tmp_path), files)) == [("tier1_ready", 1), ("complete", 3)]


def test_freed_within_the_time(spark, tmp_path):
    path = str(tmp_path)
    rows = [event(1, 0, "stop"), event(2, 30, "fix"), event(3, 50, "stop", session="t"), event(4, 200, "fix", session="t"), event(5, 59, "fix")] + END
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).withColumn("thread", F.col("session_id")).withColumn("gate", F.lit("g")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA + ", gate string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withWatermark("ts", "1 hour")
    out = threads.to_table(threads.freed(threads.of_all(stream(), "stage = 'stop'"), threads.of_all(stream(), "stage = 'fix'"), "1 hour"), f"{path}/out")
    assert sorted(((r.event_id, r.correction_id) for r in out.collect()), key=str) == [(1, 2), (1, 5), (3, None)]
