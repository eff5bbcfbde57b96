"""Versioned tables, their summaries, and the log sink."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millcheck.sources.versions import Versions, refresh
from millcheck.streaming import log_sink

SCHEMA = "session_id long, verdict string, day date"
SUMMARY = "day date, total long, passed long, source_version long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, d and dt.date(2024, 1, d)) for i, v, d in rows], SCHEMA)


def held(df):
    return sorted((r.session_id, r.verdict) for r in df.collect())


def folders(v):
    return {r.day: r.part for r in v.manifest().collect()}


def test_append_delete_and_old_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path), SCHEMA)
    assert v.latest() == 0 and v.read().count() == 0
    v.append(frame(spark, [(1, "PASS", 1), (2, "FAIL", 1), (3, "PASS", 2)]))
    v.append(frame(spark, [(4, "PASS", 2), (5, "PASS", None)]))
    old, before = v.read(), folders(v)
    v.change(spark.createDataFrame([(2,), (99,), (None,)], "session_id long"), "session_id")
    assert held(v.read()) == [(1, "PASS"), (3, "PASS"), (4, "PASS"), (5, "PASS")]
    assert held(old) == held(v.read(2)) == [(1, "PASS"), (2, "FAIL"), (3, "PASS"), (4, "PASS"), (5, "PASS")]
    # only the day that the deletion touches was written again
    after = folders(v)
    assert {d for d in after if after[d] != before[d]} == {dt.date(2024, 1, 1)}
    assert held(v.read(days=("2024-01-02", "2024-01-09"))) == [(3, "PASS"), (4, "PASS")] and held(v.read(1)) == [(1, "PASS"), (2, "FAIL"), (3, "PASS")]
    v.change(frame(spark, [(3, "", 1)]), "session_id", frame(spark, [(3, "WAIVED", 3)]))
    assert held(v.read()) == [(1, "PASS"), (3, "WAIVED"), (4, "PASS"), (5, "PASS")]
    v.change(frame(spark, [(i, "", 1) for i in range(9)]), "session_id")
    assert v.read().count() == 0 and v.latest() == 5 and len(held(v.read(4))) == 4


def test_a_writer_that_died_left_nothing(spark, tmp_path, monkeypatch):
    v = Versions(spark, str(tmp_path), SCHEMA)
    v.append(frame(spark, [(1, "PASS", 1)]))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", die)
        with pytest.raises(RuntimeError):
            v.append(frame(spark, [(2, "PASS", 1)]))
        with pytest.raises(RuntimeError):
            v.change(frame(spark, [(1, "", 1)]), "session_id")
    assert held(v.read()) == [(1, "PASS")] and v.latest() == 1 and v.all_rows().count() == 2
    v.append(frame(spark, [(3, "FAIL", 1)]))
    assert held(v.read()) == [(1, "PASS"), (3, "FAIL")]


def test_summary_follows_changed_days_only(spark, tmp_path):
    v, s = Versions(spark, f"{tmp_path}/t", SCHEMA), Versions(spark, f"{tmp_path}/s", SUMMARY)
    partial = lambda x: x.groupBy("day").agg(F.count("*").alias("total"), F.count(F.when(F.col("verdict") == "PASS", 1)).alias("passed"))
    whole = lambda: sorted(tuple(r) for r in partial(v.read()).collect())
    kept = lambda: sorted((r.day, r.total, r.passed) for r in s.read().collect())
    for rows in ([(1, "PASS", 1), (2, "FAIL", 2)], [(3, "PASS", 2), (4, "FAIL", 3)], [(5, "PASS", 4)]):
        v.append(frame(spark, rows))
        refresh(v, s, partial)
        assert kept() == whole()
    before = folders(s)
    v.change(frame(spark, [(4, "", 1)]), "session_id", frame(spark, [(6, "PASS", 2)]))
    refresh(v, s, partial)
    after = folders(s)
    assert kept() == whole() and {d.day for d in after if after[d] != before.get(d)} == {2} and {d.day for d in before if d not in after} == {3}
    refresh(v, s, partial)
    assert kept() == whole()


LOG = "ts timestamp, tag string, message string"


def log_file(spark, path, n, start):
    spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=start + i), "T", f"line {start + i}") for i in range(n)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_log_sink_has_each_line_once_after_a_crash(spark, tmp_path):
    path = str(tmp_path)
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    log_file(spark, path, 30, 0)
    log_sink.sink(stream(), f"{path}/log", ("ts", "message"), ring=20)
    log_file(spark, path, 30, 30)
    log_file(spark, path, 5, 60)

    def die(batch):
        raise RuntimeError(f"lost in batch {batch}")

    with pytest.raises(Exception, match="lost in batch 1"):
        log_sink.sink(stream(), f"{path}/log", ("ts", "message"), ring=20, after_lines=die)
    assert {r.message for r in log_sink.recent(spark, f"{path}/log", 20, "ts", "message").collect()} == {f"line {i}" for i in range(10, 30)}
    log_sink.sink(stream(), f"{path}/log", ("ts", "message"), ring=20)
    got = [r.message for r in log_sink.lines(spark, f"{path}/log").collect()]
    assert len(got) == 65 and set(got) == {f"line {i}" for i in range(65)}
    assert [r.message for r in log_sink.recent(spark, f"{path}/log", 20, "ts", "message").collect()] == [f"line {i}" for i in range(64, 44, -1)]
    assert log_sink.recent(spark, f"{path}/log", 3, "ts", "message").columns == ["ts", "tag", "message"]


def test_a_change_writes_a_day_by_one_task(spark, tmp_path):
    """What stays after a deletion comes by session; without a shuffle by day each task would write a file of each day."""
    v = Versions(spark, str(tmp_path), "session_id long, verdict string, day date")
    rows = spark.range(4000).selectExpr("id session_id", "'PASS' verdict", "date_add(date'2024-01-01', cast(id % 5 as int)) day")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v.append(rows)
        v.change(rows.where("session_id % 10 < 5").select("session_id"), "session_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert v.read().count() == 2000
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in tmp_path.glob("rows/*/*") if d.is_dir()) and len(list(tmp_path.glob("rows/*/*"))) == 10
