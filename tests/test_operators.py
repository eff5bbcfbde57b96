import pytest
from pyspark.sql import functions as F

from millcheck.operators import adapter, audit, ledger, lookup, overlay, rank
from millcheck.plans import audit as plan

RECORD = "cert_id string, pos int, category string, property_key string, sub_property string, value double, text string, level string, provenance string"


def test_arbitration_by_rank_then_order(spark):
    r = spark.createDataFrame([("a", 0, "mechanical", "yield_strength_rp02", None, 0.2, None, None, "additional"), ("a", 1, "mechanical", "yield_strength_rp02", None, 334.0, None, None, "core"), ("a", 2, "mechanical", "yield_strength_rp02", None, 335.0, None, None, "core")], RECORD)
    held = {x.slot: x.record.value for x in audit.arbitrate(audit.slots(r)).collect()}
    assert held["yield_strength_rp02"] == held["Rp0.2"] == held["yield_strength_rp02#num"] == 334.0
    assert audit.superseded(audit.slots(r).where("slot = property_key")).first().value == 335.0


def test_mixed_slots_fold_in_order(spark):
    rows = [("a", 0, "ndt", "x", None, None, "PASS", None, "core"), ("a", 1, "ndt", "x", None, 1.0, None, None, "core"), ("a", 2, "ndt", "x", None, 2.0, None, None, "tier2_resolved")]
    h = audit.held_slots(spark.createDataFrame(rows, RECORD)).first()
    assert (h.main, h.num, h.qual) == (0, 2, 0)


def run(spark, records, rules, thickness=2.0):
    certs = spark.createDataFrame([("c", "g", {"form": "tube"}, {"wall_thickness_mm": thickness}), ("empty", "none", {}, {})], "cert_id string, spec_key string, header map<string,string>, dimensions map<string,double>")
    names = plan.SCHEMA.split(", ")
    names = [f.name for f in spark.createDataFrame([], plan.SCHEMA).schema]
    rules = spark.createDataFrame([tuple(({"spec_key": "g", "pos": i, "level": "MANDATORY"} | r).get(n) for n in names) for i, r in enumerate(rules)], plan.SCHEMA)
    recs = spark.createDataFrame([tuple(({"cert_id": "c", "pos": i, "provenance": "core"} | r).get(n) for n in ("cert_id", "pos", "category", "property_key", "sub_property", "value", "text", "level", "provenance")) for i, r in enumerate(records)], RECORD)
    a = plan.audit(certs, recs, rules)
    return {r.rule_id: r.status for r in a.items.collect()}, {r.cert_id: r.verdict for r in a.summary.collect()}, a


def test_audit_scenarios(spark):
    rules = [
        dict(rule_id="c", rule_type="numeric_range", category="chemical", property_key="C", hi=0.08),
        dict(rule_id="ti", rule_type="dynamic_expression", category="chemical", property_key="Ti", formula_lo="4 * (ctx.chemical.C + ctx.chemical.N)", decimals=2),
        dict(rule_id="hard", rule_type="or_choice_group", category="mechanical", property_key="hardness", trigger="S >= 1.7", options=[("HRB", None, None, 90.0, 0), ("HV", None, None, 200.0, 0)]),
        dict(rule_id="tight", rule_type="alternative_group", category="ndt", property_key="pressure_tightness", options=[("hydraulic_test", None, None, None, None), ("eddy_current_test", "E3H", None, None, None)]),
        dict(rule_id="ut", rule_type="qualitative_enum", category="ndt", property_key="ultrasonic_test", required_level="U2"),
        dict(rule_id="igc", rule_type="exemption", category="corrosion", property_key="intergranular_corrosion", level="EXEMPT"),
        dict(rule_id="flat", rule_type="dynamic_formula_pass", category="process", property_key="flattening_test"),
    ]
    records = [
        dict(category="chemical", property_key="C", value=0.06), dict(category="chemical", property_key="N", value=0.03), dict(category="chemical", property_key="Ti", value=0.30), dict(category="mechanical", property_key="hardness", sub_property="HV", value=150.0),
        dict(category="ndt", property_key="eddy_current_test", level="E3H", text="E3H"), dict(category="ndt", property_key="ultrasonic_test", level="U2", text="合格"), dict(category="process", property_key="flattening_test", text="合格"), dict(category="other", property_key="odd", text="x"),
    ]
    status, verdict, a = run(spark, records, rules)
    assert status == {"c": "PASS", "ti": "FAIL", "hard": "PASS", "tight": "PASS", "ut": "PASS", "igc": "EXEMPT", "flat": "PASS"}
    assert verdict == {"c": "FAIL", "empty": "MANUAL_REVIEW"}
    assert "odd" in {r.property_key for r in a.unmatched.collect()}


def test_untriggered_but_reported_is_checked(spark):
    rule = [dict(rule_id="h", rule_type="numeric_range", category="mechanical", property_key="hardness", hi=90.0, trigger="S >= 1.7")]
    assert run(spark, [], rule, 1.5)[0]["h"] == "SKIPPED"
    assert run(spark, [dict(category="mechanical", property_key="hardness", value=80.0)], rule, 1.5)[0]["h"] == "PASS"
    assert run(spark, [dict(category="mechanical", property_key="hardness", value=95.0)], rule, 1.5)[0]["h"] == "FAIL"
    assert run(spark, [], rule, 2.0) [1]["c"] == "FAIL"


def test_groups(spark):
    rows = [("c", "g", "OR", 1, s, l, i, f"r{i}") for i, (s, l) in enumerate([("PASS", "MANDATORY"), ("FAIL", "MANDATORY"), ("MISSING", None)])] + [("d", "g", "OR", 1, "MISSING", None, 0, "r0"), ("e", "g", "AND", None, "PASS", None, 0, "r0"), ("e", "g", "AND", None, "SKIPPED", None, 1, "r1")]
    items = spark.createDataFrame(rows, "cert_id string, group_id string, group_op string, min_pass int, status string, level string, pos int, rule_id string")
    g = audit.group_verdicts(items)
    assert {r.cert_id: (r.group_status, r.blocking) for r in g.collect()} == {"c": ("PASS_WITH_WARNING", False), "d": ("FAIL", False), "e": ("FAIL", False)}
    s = {(r.cert_id, r.rule_id): (r.status, r.order_) for r in audit.with_groups(items).collect()}
    assert s["c", "r2"] == ("SKIPPED", 3) and s["c", "r1"] == ("FAIL", 2)


SOURCE = "property_key string, sub_property string, standard_id string, category string, priority int, pos int, rule_id string, level string, lo double, hi double, unit string, decimals int"


def test_envelope_and_relaxation(spark):
    rows = [("A", None, "GB", "national_standard", 4, 0, "r1", "MANDATORY", 35.0, None, "%", 0), ("A", None, "NB", "industry_standard", 2, 1, "r2", None, 40.0, None, "%", 1), ("P", None, "GB", "national_standard", 4, 0, "r3", "MANDATORY", None, 0.035, "%", None), ("P", None, "TA-1", "technical_agreement", 1, 1, "r4", "MANDATORY", None, 0.040, "%", None)]
    e = {r.key: r for r in overlay.envelope(spark.createDataFrame(rows, SOURCE)).collect()}
    assert (e["A"].lo, e["A"].governing, e["A"].decimals, e["A"].relaxed) == (40.0, "NB", 1, False)
    assert (e["P"].hi, e["P"].governing, e["P"].relaxed, e["P"].baseline) == (0.040, "TA-1", True, "<= 0.0350")


def test_standard_priorities(spark):
    df = spark.createDataFrame([("TA-2024", ""), ("NB/T 47019.5", ""), ("Q/AB 1", ""), ("GB/T 13296", "")], "s string, n string")
    assert [r.p.priority for r in df.select(overlay.priority_of(F.col("s"), F.col("n")).alias("p")).collect()] == [1, 2, 3, 4]


def test_tolerance(spark):
    steps = spark.createDataFrame([(1, "wall", "all", "min_wall", 0.0, 2.0, 10.0, True, 0.0, True, 38.0, "D <= 38"), (2, "wall", "all", "min_wall", 0.0, 2.0, 20.0, True, 0.0, True, 38.0, "D > 38")], "pos int, property string, process string, delivery string, range_min double, range_max double, plus double, plus_percent boolean, minus double, minus_percent boolean, diameter_limit double, note string")
    parts = spark.createDataFrame([(1, 2.0, 25.0, 2.3), (2, 2.0, 50.0, 2.3), (3, 2.1, 25.0, 9.0)], "part_id int, nominal double, diameter double, value double").selectExpr("*", "'wall' property", "'min_wall' delivery", "'cold_drawn' process")
    t = {r.part_id: (r.step_pos, r.ok, r.deviation) for r in lookup.tolerance(parts, steps).collect()}
    assert t == {1: (1, False, 0.1), 2: (2, True, 0.0), 3: (None, True, 0.0)}


def test_recommend_and_fuzzy(spark):
    slices = spark.createDataFrame([("a", "GB", "06Cr19Ni10", ["SUS304", "S30408"], 0), ("b", "GB", "06Cr18Ni11Ti", ["SUS321"], 1), ("c", "NB", "06Cr19Ni10", ["S30408"], 2)], "slice_id string, standard_id string, grade string, names array<string>, pos int")
    chem = rank.chemistry_scores(spark.createDataFrame([("x", "C", 0.05), ("x", "TI", 0.01)], "cert_id string, element string, value double"), spark.createDataFrame([("a", "C", None, 0.08), ("b", "TI", 0.3, 0.7)], "slice_id string, element string, lo double, hi double"), spark.createDataFrame([("x", i) for i in "abc"], "cert_id string, slice_id string"))
    got = rank.recommend(spark.createDataFrame([("x", "SUS 304-SPECIALX", ["GB", "NB"])], "cert_id string, raw string, standard_ids array<string>"), slices, chem).orderBy("rank_").collect()
    assert got[0].grade == "06Cr19Ni10" and got[0].recommended and len({r.grade for r in got}) == len(got) == 2
    pool = spark.createDataFrame([("TP316L", "S31603", ["SUS316L"], ""), ("TP304", "S30408", [], "316 like")], "grade string, code string, aliases array<string>, shown string")
    assert [(r.grade, r.score) for r in rank.fuzzy_search(pool, "316").collect()] == [("TP316L", 80), ("TP304", 70)]
    assert rank.fuzzy_search(pool, "SUS316L").first().score == 95 and rank.fuzzy_search(pool, " ").count() == 0


def test_recommendations_are_ranked_by_text_not_by_certificate(spark):
    """Where there is no chemistry, certificates meet three rows each, not every slice; rows that repeat an id have their own."""
    slices = spark.createDataFrame([(f"s{i}", "GB", f"grade {i}", [f"G{i:04d}"], i) for i in range(50)], "slice_id string, standard_id string, grade string, names array<string>, pos int")
    asked = spark.createDataFrame([(1, "G0007", ["GB"]), (2, "G0007", ["GB"]), (2, "G0033", ["GB"]), (3, None, ["GB"]), (4, "G0001", ["NB"])], "cert_id int, raw string, standard_ids array<string>")
    got = rank.recommend(asked, slices)
    assert sorted((r.cert_id, r.grade) for r in got.where("rank_ = 1").collect()) == [(1, "grade 7"), (2, "grade 33"), (2, "grade 7")] and got.count() == 9
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert windows and not any("cert_id" in line for line in windows)


def test_ledger_edges(spark):
    s = spark.createDataFrame([], "session_id int, batches array<struct<verdict:string>>")
    assert ledger.kpis(s).first().pass_rate == 100.0
    assert ledger.last_n(spark.range(5), 0, "id").count() == 1


def test_adapter(spark):
    b = spark.createDataFrame([("b1", [("C", "<0.018"), ("Si", "")], {"tensile_rm": "520 MPa", "yield_rp02": "Rp0.2: 334 Rm: 520", "hardness": "HV10 150 152"}, {"flattening": "合格", "ndt": "x"}, [("抗拉强度", "520", "MPa", None), ("note", "Rm: 1 Rp: 2", None, None)])], "batch_id string, chemical array<struct<element:string,value:string>>, mechanical map<string,string>, process map<string,string>, extra array<struct<name:string,value:string,unit:string,category:string>>")
    r = {(x.property_key, x.provenance): x for x in adapter.records(b).collect()}
    assert r["C", "core"].value == 0.018 and r["tensile_strength", "core"].value == 520.0 and r["yield_strength_rp02", "core"].value is None
    assert (r["hardness", "core"].value, r["hardness", "core"].sub_property) == (151.0, "HV") and r["flattening_test", "core"].text == "PASS"
    extras = b.select("batch_id", "mechanical", "process", F.explode("extra").alias("x")).select("batch_id", "mechanical", "process", "x.*")
    tags = {x.name: (x.is_composite, x.duplicate_of) for x in adapter.annotate(extras).collect()}
    assert tags == {"抗拉强度": (False, "tensile_strength"), "note": (True, None)}
    e = adapter.set_value(b, spark.createDataFrame([("b1", "chem_C", "0.02")], "batch_id string, field string, value string")).first()
    assert e.chemical[0].value == "0.02" and e.mechanical["tensile_rm"] == "520 MPa"


def test_deep_clauses_and_large_numbers(spark):
    from millcheck.functions import rounding

    n = 60
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"t{i}", None, 2_000_000 + i) for i in range(n)], "clause_id string, parent string, title string, text string, pos int")
    tree = lookup.clause_tree(nodes).collect()
    assert len(tree) == n and max(r.depth for r in tree) == n - 1 and [r.clause_id for r in sorted(tree, key=lambda r: r.path)] == [str(i) for i in range(n)]
    row = spark.range(1).select(rounding.half_even(F.lit(0.12345678905), F.lit(10)).alias("fine"), rounding.half_even(F.lit(1e22), 2).alias("large"), rounding.half_even(F.lit(1e22), F.lit(2)).alias("large2"), rounding.compare(F.lit(2e22), F.lit(1e22), "<=")[0].alias("holds")).first()
    assert (row.fine, row.large, row.large2, row.holds) == (0.123456789, 1e22, 1e22, False)


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from millcheck.operators import lineage

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        lineage.shared_dir(fake)


def test_only_the_best_record_of_a_kind_is_looked_up(spark):
    """Certificates of a few hundred records have slots by kinds of records, and the same records hold them."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    rows = [(c, i, pick("hardness", "Rm", "ultrasonic_test"), pick(None, "HV"), pick("mechanical", "chemical", None), pick(None, 1.0, 2.0, 3.0), pick(None, "PASS", "FAIL"), pick(None, "U2"), pick("core", "additional", "tier2_resolved", None)) for c in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "cert_id long, pos int, property_key string, sub_property string, category string, value double, text string, level string, provenance string")
    columns = ["cert_id", "slot", "rank_", "pos", "value", "text", "level"]
    all_ = lambda x: sorted(map(repr, x.select("cert_id", "slot", "record.pos", "record.value", "record.text", "record.level", "n_records").collect()))
    slotted, few = audit.slots(df).select(*columns), audit.settled_slots(df)
    assert all_(audit.arbitrate(slotted)) == all_(audit.arbitrate(few.select(*columns, "n_")))
    assert few.count() * 2 < slotted.count()
    plan = audit.settled(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert audit.dealt(df, "cert_id", 10).rdd.getNumPartitions() == 61 and audit.dealt(df.where(F.lit(True)), "cert_id").rdd.getNumPartitions() < 61
