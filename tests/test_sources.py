import json

from pyspark.sql import functions as F

from millcheck.sources import rule_store
from millcheck.streaming import progressive


def test_rule_store(spark, tmp_path):
    d = tmp_path / "GB_T_1"
    (d / "indices").mkdir(parents=True)
    rules = [
        {"rule_id": "C1", "conformance_level": "MANDATORY", "selection": {"category": "chemical", "data_element_id": "chem.element.C"}, "applicability": [{"field": "product.wall_thickness", "operator": ">=", "value": 1.7}], "requirement": {"operator": "<=", "value": 0.08, "unit": "%"}},
        {"rule_id": "T1", "conformance_level": "OPTIONAL", "selection": {"data_element_id": "chem.element.Ti"}, "requirement": {"operator": ">=", "value": 0.7, "formula": "4 * chem.element.C"}},
        {"rule_id": "H1", "selection": {"category": "mechanical", "data_element_id": "mech.hardness.HV"}, "requirement": {"operator": "between", "value": [100, 200]}},
        {"rule_id": "P1", "selection": {"category": "ndt", "data_element_id": "test.pressure_tightness"}, "requirement": {"operator": "==", "value": "PASS"}},
        {"rule_id": "I1_EXEMPT", "selection": {"data_element_id": "test.intergranular_corrosion"}, "requirement": {"operator": "==", "value": "x"}},
    ]
    (d / "rules.json").write_text(json.dumps(rules))
    (d / "indices" / "grade_index.json").write_text(json.dumps({"G": ["C1", "T1", "gone"], "H": ["H1"]}))
    (d / "clauses_tree.json").write_text(json.dumps([{"clause_id": "4", "title": "a", "children": [{"clause_id": "4.1", "text": "b", "children": []}]}, {"clause_id": "5", "children": []}]))
    r = rule_store.atomic_rules(spark, f"{d}/rules.json")
    s = rule_store.slices_of(r, rule_store.grade_index(spark, f"{d}/indices/grade_index.json"))
    assert {(x.spec_key, x.rule_id) for x in s.collect()} == {("G", "C1"), ("G", "T1"), ("H", "H1")}
    e = {x.rule_id: x for x in rule_store.evaluation_rules(r).collect()}
    assert e["C1"].standard_id == "GB_T_1" and (e["C1"].hi, e["C1"].property_key, e["C1"].trigger) == (0.08, "C", "ctx.header.dimensions.wall_thickness_mm >= 1.7")
    assert (e["T1"].rule_type, e["T1"].formula_lo, e["T1"].level, e["T1"].hi) == ("dynamic_expression", "4 * ctx.chemical.C", "OPTIONAL_AGREED", 0.7)
    assert (e["H1"].lo, e["H1"].hi, e["H1"].sub_property) == (100.0, 200.0, "HV")
    assert e["P1"].rule_type == "alternative_group" and e["P1"].options[1].required_level == "E3H" and e["I1_EXEMPT"].rule_type == "exemption"
    assert {x.clause_id: x.parent for x in rule_store.clauses(spark, f"{d}/clauses_tree.json").collect()} == {"4": None, "4.1": "4", "5": None}
    assert rule_store.validate(r.union(r)).where("problem = 'repeated id'").count() == 5


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("nonsense",)], "t string")
    assert [r.parsed.a for r in rule_store.answers(df, "t", "a int").collect()] == [1, None]


def test_logs_and_cache(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "level": "info", "tag": "ENGINE", "message": "m", "metadata": {"k": 1}}\n')
    assert rule_store.logs(spark, str(tmp_path / "l.jsonl")).first().metadata .replace(" ", "") == '{"k":1}'
    old = spark.createDataFrame([("a", "v1", 1), ("b", "v1", 1)], "md5 string, parserConfigVersion string, n int")
    new = spark.createDataFrame([("a", "v1", 2)], old.schema)
    assert {(r.md5, r.n) for r in rule_store.put_cache(new, old).collect()} == {("a", 2), ("b", 1)}


def test_ledger_writer(spark, tmp_path):
    s = spark.createDataFrame([("s", ["data:image/png;base64,xx", "kept"])], "session_id string, pages array<string>").withColumn("saved_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    rule_store.write_ledger(s, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).first().pages == ["asset:/s/0", "kept"]


def test_gates_and_corrections(spark):
    rows = [("s", "b", None, "deterministic_eval", True, True, 0.9, "other", 0.1), ("s", "b", "2", "deterministic_eval", False, False, 0.1, "other", 0.1), ("s", "b", None, "reevaluated", True, True, 0.9, "chemical", 0.5)]
    t = progressive.told(spark.createDataFrame(rows, "session_id string, batch_id string, run_id string, stage string, standard_known boolean, grade_known boolean, confidence double, category string, property_confidence double"))
    assert {(r.thread, r.kind, r.gate) for r in t.collect()} == {("s::b", "tier1_ready", None), ("s::b::2", "hitl_interrupt", "UNKNOWN_STANDARD"), ("s::b", "hitl_interrupt", "PROPERTY_AMBIGUITY")}
    r = spark.createDataFrame([("t", "x", "1"), ("t", "y", "2")], "thread string, property_key string, value string")
    c = spark.createDataFrame([("t", "x", "z", "5", False, 1), ("t", "x", None, "6", True, 2)], "thread string, property_key string, new_key string, value string, rejected boolean, at int")
    assert {(x.property_key, x.value, x.is_rejected) for x in progressive.corrected(r, c).collect()} == {("x", "6", True), ("y", "2", False)}


def test_stream_matches_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = {(r.kind, r.gate): r.n for r in progressive.replay(spark, path).collect()}
    want = progressive.told(progressive.event_rows(spark.read.parquet(path))).groupBy("kind", F.coalesce("gate", F.lit("-")).alias("gate")).count().collect()
    assert got == {(r.kind, r.gate): r["count"] for r in want}


def test_clause_library(spark, tmp_path):
    def put(folder, name, value):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(value if isinstance(value, str) else json.dumps(value))

    put("GB_T_1", "clauses_tree.json", [{"clause_id": "4", "title": "a", "children": [{"clause_id": "4.1", "text": "b"}]}])
    put("GB_T_1", "clauses.json", [{"clause_id": "never", "title": "flat"}])
    put("NB-T-2", "clauses_tree.json", "no json")
    put("NB-T-2", "clauses.json", [{"clause_id": "1", "title": "flat"}, {"clause_id": "2", "title": "flat too"}])
    put("nb t 2", "clauses.json", [{"clause_id": "second", "title": "later by name"}])
    put("X_3", "clauses_tree.json", [])
    put("X_3", "clauses.json", [{"clause_id": "never", "title": "an empty tree is one"}])
    put("X 3", "clauses.json", [{"clause_id": "9", "title": "other folder of the name"}])
    put("X 3", "rules.json", [{"clause_id": "never"}])
    library = rule_store.clause_library(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "GB/T-1"), (2, "gb t 1"), (3, "NB/T 2"), (4, "X-3"), (5, "nothing"), (6, "nb t 2")], "key_id int, standard_id string")
    got = sorted((r.key_id, r.folder, r.clause_id, r.parent) for r in rule_store.clauses_of(library, asked).collect())
    assert got == [(1, "GB_T_1", "4", None), (1, "GB_T_1", "4.1", "4"), (2, "GB_T_1", "4", None), (2, "GB_T_1", "4.1", "4"), (3, "NB-T-2", "1", None), (3, "NB-T-2", "2", None), (4, "X 3", "9", None), (6, "nb t 2", "second", None)]


def test_reports(spark, tmp_path):
    certs = spark.createDataFrame([(1, "FAIL"), (2, "PASS"), (3, None)], "cert_id int, verdict string")
    items = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "cert_id int, pos int, rule_id string")
    rule_store.write_reports(certs, items, str(tmp_path / "r"))
    got = rule_store.read_reports(spark, str(tmp_path / "r"), "cert_id int, verdict string, items array<struct<pos:int,rule_id:string>>").collect()
    assert {r.cert_id: (r.verdict, None if r["items"] is None else [(i.pos, i.rule_id) for i in r["items"]]) for r in got} == {1: ("FAIL", [(1, "a"), (2, "b")]), 2: ("PASS", [(1, None)]), 3: (None, None)}


def test_traces_parts_and_newest(spark):
    from millcheck.operators import ledger, review

    t = spark.createDataFrame([("t", 2, ["a", "b"]), ("t", 1, ["a"]), ("t", 3, None), ("u", 1, [])], "task_id string, node_pos int, items array<string>")
    assert {r.task_id: r.trace for r in ledger.traces(t).collect()} == {"t": ["a", "a", "b"], "u": []}
    cases = {("chemical", "numeric_range"): "chemical", ("chemical", "dynamic_expression"): "other", ("mechanical", "dynamic_expression"): "mechanical", ("ndt", "x"): "process", ("corrosion", None): "process", ("metallographic", "x"): "other", (None, "x"): "other", ("chemical", None): "chemical"}
    rules = spark.createDataFrame([("s", i, f"r{i}", c, k) for i, (c, k) in enumerate(cases)], "spec_key string, pos int, rule_id string, category string, rule_type string")
    want = {}
    for i, part in enumerate(cases.values()):
        want.setdefault(part, []).append(f"r{i}")
    assert {r.part: (r.n_rules, r.rule_ids) for r in review.rules_by_part(rules).collect()} == {k: (len(v), v) for k, v in want.items()}
    s = spark.createDataFrame([(1, "2024-01-02", None), (2, None, "2024-01-03"), (3, None, None), (4, "2024-01-02", "2025-01-01")], "session_id int, saved_at string, created_at string")
    got = ledger.newest_first(s, "saved_at", "created_at")
    assert got.columns == ["session_id", "saved_at", "created_at", "position"] and {r.session_id: r.position for r in got.collect()} == {2: 1, 4: 2, 1: 3, 3: 4}
