"""Payloads of all shapes, merged documents, numbers by time."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from millcheck.operators import ledger, review
from millcheck.sources import payloads


def frame(spark, bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b, ensure_ascii=False), "clash") for i, b in enumerate(bodies)], "payload_id int, body string, name string")


RESULTS = [
    ({"raw_property_name": "抗拉强度 Rm", "raw_value": "58.5", "raw_unit": "kgf/mm²"}, ("mechanical", "tensile_strength", 573.689, "MPa", None, None, "kgf/mm²")),
    ({"raw_property_name": "C", "raw_value": 0.05}, ("chemical", "C", 0.05, "%", None, None, None)),
    ({"raw_property_name": "伸长率", "raw_value": "45 %"}, ("mechanical", "elongation_A", 45.0, "%", None, None, None)),
    ({"raw_property_name": "硬度HV", "raw_value": "HV10 152 153 155"}, ("mechanical", "hardness", 153.3, "HV", None, None, None)),
    ({"raw_property_name": "晶粒度", "raw_value": "7.5级"}, ("metallographic", "grain_size", 7.5, "级", None, None, None)),
    ({"raw_property_name": "UT", "raw_value": "PASS (U2 等级)"}, ("ndt", "ultrasonic_test", 2.0, None, "PASS", "U2", None)),
    ({"raw_property_name": "压扁", "raw_value": ""}, ("process", "flattening_test", None, None, "NOT_TESTED", None, None)),
    ({"raw_property_name": "粗糙度", "raw_value": 0.8, "raw_unit": "um"}, ("surface", "surface_roughness", 0.8, "um", "PASS", None, None)),
    ({"raw_property_name": "屈服强度", "raw_value": "n/a"}, ("mechanical", "yield_strength_rp02", None, None, None, None, None)),
]


def got(df, i=0):
    rows = df.where(F.col("payload_id") == i).orderBy("pos").collect()
    return [(r.category, r.property_key, None if r.value is None else round(r.value, 3), r.unit, r.text, r.level, r.from_unit) for r in rows]


def test_all_shapes_are_one(spark):
    raw = [r for r, _ in RESULTS]
    wrapped = [{k: {"value": v, "box": [1, 2]} for k, v in r.items()} for r in raw]
    by_name = {r["raw_property_name"]: {"value": r["raw_value"]} | ({"unit": r["raw_unit"]} if "raw_unit" in r else {}) for r in raw}
    alone = {r["raw_property_name"]: r["raw_value"] for r in raw if "raw_unit" not in r}
    df = payloads.records(frame(spark, [{"test_records": raw}, {"test_records": wrapped}, {"test_records": by_name}, {"test_records": alone}]))
    want = [w for _, w in RESULTS]
    assert got(df) == want and got(df, 1) == want
    # an object's entries come in the order of their names
    assert sorted(got(df, 2), key=str) == sorted(want, key=str)
    assert sorted(got(df, 3), key=str) == sorted((w for r, w in RESULTS if "raw_unit" not in r), key=str)


def test_problems_and_odd_payloads(spark):
    odd = [None, "", "no json", "[]", "{}", {"test_records": []}, {"test_records": None}, {"test_records": "x"}, {"test_records": [1, None, {}, {"raw_property_name": " "}, {"raw_property_name": "what is it", "raw_value": {"a": 1}}, {"raw_property_name": "Mn", "raw_value": "much"}]}, {"header": 5}]
    df = payloads.records(frame(spark, odd))
    rows = df.orderBy("payload_id", "pos").collect()
    assert [(r.payload_id, r.pos, r.property_key, r.problem, r.raw) for r in rows] == [(8, 4, "what_is_it", "unknown property", ""), (8, 5, "Mn", "not a number", "much")]
    assert payloads.certificates(frame(spark, odd)).where("declared_grade = 'UNKNOWN' and certificate_no = 'UNKNOWN-NO' and confidence = 0.95").count() == len(odd)


def test_headers(spark):
    h = {"certificate_no": {"value": " N1 "}, "declared_grade": "TP-316L", "declared_standard": {"value": None}, "heat_number": 77, "lot_number": " ", "supplier_name": {"name": "x"}}
    body = "```json\n" + json.dumps({"header": h, "overall_confidence": 0.5}) + "\n```"
    r = payloads.certificates(frame(spark, [body])).first()
    assert (r.certificate_no, r.declared_grade, r.declared_standard, r.heat_number, r.lot_number, r.supplier_name, r.confidence) == ("N1", "TP-316L", "UNKNOWN", "77", None, None, 0.5)


DOCS = "seq int, doc_id string, md5 string, filename string, richness int, pages array<string>, note string, c_ string"


def test_merged_documents(spark):
    rows = [
        (1, "a", None, "f1", 1, ["p"], "", "x"), (2, "a", "m1", None, 5, [], None, "x"), (3, None, "m1", "f3", 5, None, " ", "x"), (4, None, None, "f3", 0, ["q", "r"], "said", "x"),
        (5, "b", None, None, 9, None, None, "x"), (6, None, None, None, 1, None, "lone", "x"), (7, None, None, None, 1, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, DOCS).drop("c_")
    got_ = {r.n_merged: r for r in review.merged_documents(df).where("n_merged > 1").collect()}
    r = got_[4]
    # 3 is the later of the richest; pages come from 1, which is richer than 4, and the note from 4
    assert (r.seq, r.doc_id, r.md5, r.filename, r.richness, r.pages, r.note) == (3, "a", "m1", "f3", 5, ["p"], "said")
    assert review.merged_documents(df).count() == 4 and {x.seq for x in review.same_documents(df).collect()} == {3, 5, 6, 7}


def test_numbers_by_time_with_all_on_one_day(spark):
    r = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, r.randrange(50))) for i in r.sample(range(10_000), 3000)] + [(20_000, None), (20_001, None)]
    df = spark.createDataFrame(rows, "session_id long, saved_at timestamp").repartition(7)
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda x: (x[1] is not None, x[1] or dt.datetime.min, x[0])), 1)}
    found = ledger.sequence_numbers(df)
    assert found.columns == ["session_id", "saved_at", "seq"] and {x.session_id: x.seq for x in found.collect()} == want
    assert ledger.sequence_numbers(df.limit(0)).count() == 0


def test_a_small_file_of_payloads_is_work_for_all_tasks(spark):
    df = spark.range(10, numPartitions=1).selectExpr("id payload_id", "'{}' body")
    assert "RoundRobinPartitioning" in payloads.records(df)._jdf.queryExecution().executedPlan().toString()
