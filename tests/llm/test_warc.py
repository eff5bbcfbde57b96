import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millcheck.llm import warc

ROWS = [(3, "u3", "é\r\n\r\nx"), (1, "u1", "same"), (2, "u2", "same"), (2, "u2", "same"), (5, None, None), (4, "u\r\n4", ""), (None, "n", "same"), (6, "u6", "long " * 40_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, id int")


def test_round_trip(spark, tmp_path):
    p = str(tmp_path / "archive")
    warc.write(pages(spark, ROWS), p)
    got = warc.read(spark, p).collect()
    text = {i: t or "" for i, _, t in ROWS}
    first = {}
    for i, t in text.items():
        if i is not None:
            first[t] = min(first.get(t, i), i)
    assert len(got) == len(ROWS)
    for r in got:
        b = text[r.id].encode()
        assert r.verified and r.payload_bytes == len(b) and r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.id == first[text[r.id]] else ("revisit", first[text[r.id]]))
    assert spark.read.parquet(f"{p}/payloads").count() == len(set(text.values()))
    rebuilt = {r.id: r.record for r in warc.reconstruct(spark, p).collect()}
    head = {r.id: r.header for r in spark.read.parquet(f"{p}/records").collect()}
    assert rebuilt[3] == head[3] + text[3] and rebuilt[2] == head[2] and "WARC-Refers-To: <urn:page:1:" in head[2]
    warc.export(spark, p, str(tmp_path / "out"))
    read = warc.read_files(spark, str(tmp_path / "out")).collect()
    want = sorted((r.header, text[r.id].encode() if "WARC-Type: response" in r.header else b"") for r in spark.read.parquet(f"{p}/records").collect())
    assert sorted((r.header, bytes(r.payload)) for r in read) == want
    back = warc.read_back(spark, str(tmp_path / "out")).collect()
    assert sorted(map(str, back)) == sorted(map(str, got)) and all(r.verified for r in back)
    names = [h.split("WARC-Record-ID: ")[1].split("\r")[0] for h, _ in want]
    assert len(set(names)) == len(names)
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in Path(tmp_path, "out").glob("*.gz") if gzip.decompress(f.read_bytes()))


def test_damage_is_seen(spark, tmp_path):
    p, q = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write(pages(spark, ROWS), p)
    spark.read.parquet(f"{p}/records").write.parquet(f"{q}/records")
    bad = F.when(F.col("payload") == F.lit("same").cast("binary"), F.lit("sane").cast("binary")).otherwise(F.col("payload"))
    spark.read.parquet(f"{p}/payloads").withColumn("payload", bad).write.parquet(f"{q}/payloads")
    assert {r.id for r in warc.read(spark, q).where("not verified").collect()} == {1, 2, None}


def test_small_payloads_and_empty(spark, tmp_path):
    p = str(tmp_path / "s")
    warc.write(pages(spark, ROWS), p, revisit_bytes=5)
    assert {r.record_type for r in warc.read(spark, p).collect()} == {"response"}
    warc.write(pages(spark, []), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("payload", ["", "\r\n", "x\r\n", "\r\n\r\n", "a\r\n\r\n\r\nb", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "x" * 300_000, "end\r", "\n\r\n\r\n\r\n"])
def test_payloads_with_line_ends(spark, tmp_path, payload):
    p = str(tmp_path / "a")
    warc.write(pages(spark, [(1, "u", payload), (2, "v", "next"), (3, "w", payload)]), p)
    warc.export(spark, p, f"{p}/files")
    got = {r.id: r for r in warc.read_back(spark, f"{p}/files").collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes, r.verified) for i, r in got.items()} == {1: ("response", None, len(payload), True), 2: ("response", None, 4, True), 3: ("revisit", 1, len(payload), True)}


def test_damaged_files(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    cases = b"no header at all\r\n\r\n" + good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + good + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc.gz").write_bytes(gzip.compress(cases))
    got = [None if r.payload is None else bytes(r.payload) for r in warc.read_files(spark, str(tmp_path / "x")).collect()]
    assert got == [None, b"abc", None, b"abc", None]
    assert [r.verified for r in warc.read_back(spark, str(tmp_path / "x")).collect()].count(True) == 0


def response(i, body, says=None):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d:0>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body) if says is None else says, body)


def read(spark, folder, *files):
    folder.mkdir()
    for i, data in enumerate(files):
        (folder / f"{i}.warc.gz").write_bytes(gzip.compress(data))
    rows = warc.read_files(spark.newSession(), str(folder)).collect()
    return sorted((r.header.split("urn:page:")[-1].split(":")[0], None if r.payload is None else bytes(r.payload)) for r in rows)


@pytest.mark.parametrize("says", [6, 50, 95, 100, 101, 130, 10**9])
def test_a_record_cut_short_takes_no_other(spark, tmp_path, says):
    whole = [response(1, b"one"), response(2, b"cut", says), response(3, b"three"), response(4, b"a\r\n\r\nb"), response(5, b"")]
    assert read(spark, tmp_path / "x", b"".join(whole)) == [("1", b"one"), ("2", None), ("3", b"three"), ("4", b"a\r\n\r\nb"), ("5", b"")]


def test_several_cut_records(spark, tmp_path):
    data = response(1, b"x", 70) + response(2, b"y", 10**6) + response(3, b"z") + response(4, b"w", 9)
    assert read(spark, tmp_path / "x", data) == [("1", None), ("2", None), ("3", b"z"), ("4", None)]


def test_no_record_goes_on_in_another_file(spark, tmp_path):
    """Both files are read by one task."""
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "x").mkdir()
        for i, data in enumerate([response(1, b"one") + response(2, b"cut", 400), response(3, b"three") + response(4, b"cut", 5), response(5, b"five")]):
            (tmp_path / "x" / f"{i}.warc.gz").write_bytes(gzip.compress(data))
        df = warc.read_files(spark, str(tmp_path / "x"))
        got = sorted((r.header.split("urn:page:")[1][0], None if r.payload is None else bytes(r.payload)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert got == [("1", b"one"), ("2", None), ("3", b"three"), ("4", None), ("5", b"five")]


def test_ids_of_any_text(spark, tmp_path):
    ids = ["null", "", None, "a:b", "line\r\nend", "50%", "%", "%41", "é x>", "urn:page:1:2"]
    p = str(tmp_path / "a")
    df = spark.createDataFrame([(i, f"http://x/{n}", f"body {n // 2}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    warc.write(df, p)
    warc.export(spark, p, f"{p}/files")
    back = warc.read_back(spark, f"{p}/files", "string").collect()
    assert sorted(map(str, (r.id for r in back))) == sorted(map(str, ids)) and all(r.verified for r in back)
    pairs = {(ids[n], ids[n + 1]) for n in range(0, len(ids), 2)}
    assert {frozenset((r.id, r.refers_to)) for r in back if r.record_type == "revisit"} == {frozenset(x) for x in pairs}
