"""Formulas, conditions and offsets as data against the compiler of single formulas and the rules they state."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millcheck.functions import programs
from millcheck.functions.formula import FormulaError, compile_formula, trigger
from millcheck.plans.audit import SCHEMA, audit

NAMES = ["S", "D", "ctx.header.dimensions.width", "ctx.mechanical.Rm", "ctx.header.total", "nowhere", "ctx.chemical.C"]
HEADER, DIMENSIONS, RECORDS = {"total": "7.5", "form": "welded"}, {"wall_thickness_mm": 2.0, "outer_diameter_mm": 0.0, "width": 9.0}, {"Rm": 520.0, "C": None}


def made(r, depth):
    kind = r.randrange(9) if depth else r.randrange(2)
    if kind == 0:
        return r.choice(["1", "2.5", ".5", "10", "0", "3."])
    if kind == 1:
        return r.choice(NAMES)
    x = lambda: made(r, depth - 1)
    space = r.choice(["", " "])
    return [lambda: f"({x()})", lambda: f"-{x()}", lambda: f"sqrt({x()})", lambda: f"{r.choice(['min', 'max'])}({', '.join(x() for _ in range(r.randrange(1, 4)))})"][kind - 2]() if kind < 6 else f"{x()}{space}{r.choice('+-*/')}{space}{x()}"


def lookup(source, name):
    return F.when(source == "record", F.try_element_at("r", name)).when(source == "dimension", F.try_element_at("d", name)).when(source == "header", F.try_element_at("h", name).try_cast("double"))


def rows(spark, texts):
    maps = F.lit(None)
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    entry = lambda m, kind: F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v).cast(kind)) for k, v in m.items())))
    assert maps is not None
    return x.withColumns({"h": entry(HEADER, "string"), "d": entry(DIMENSIONS, "double"), "r": entry(RECORDS, "double")})


def variable(name):
    """As resolve(), for the compiler of single formulas."""
    source, key = programs.resolve(name)
    if source == "dimension":
        return F.lit(DIMENSIONS.get(key))
    return F.lit(RECORDS.get(key)) if source == "record" else F.lit(float(HEADER[key])) if source == "header" else F.lit(None).cast("double")


BAD = ["", " ", "1 +", "* 2", "(1", "1)", "min(", "sqrt(1, 2)", "foo(1)", "1 2", "S D", "min()", "1,2", "(1,2)", "a b", "1 $ 2", "()", "max(1,)", "sqrt"]


def test_steps_give_what_the_compiler_gives(spark):
    r = random.Random(4)
    texts = list(dict.fromkeys([made(r, 4) for _ in range(150)] + ["-2 * -3", "8 / 4 / 2", "1 - 2 - 3", "2 + 3 * 4", "(2 + 3) * 4", "--1", "+1", "min(1)", "max(S, sqrt(4), 3)"] + BAD))
    want = {}
    for i, t in enumerate(texts):
        try:
            want[i] = compile_formula(t, variable)
        except FormulaError:
            want[i] = F.lit(None).cast("double")
    one = spark.range(1).select(*(c.alias(f"c{i}") for i, c in want.items())).first()
    got = {x.i: x.v for x in rows(spark, texts).withColumn("s", programs.compiled(F.col("t"))).select("i", programs.evaluate(F.col("s"), lookup).alias("v")).collect()}
    same = lambda a, b: a == b or (a is not None and b is not None and (a != a and b != b))
    assert [(t, got[i], one[f"c{i}"]) for i, t in enumerate(texts) if not same(got[i], one[f"c{i}"])] == []
    assert sum(v is not None for v in got.values()) > 40


def test_conditions(spark):
    texts = [None, "", "S >= 2", "S > 2", "ctx.header.form == 'welded'", "ctx.header.form != \"welded\"", "ctx.header.total < 8 && S == 2", "ctx.header.total < 8 && D > 0", "ctx.header.none != 'x'", "no condition", "S >= 1 && what?", "ctx.header.form >= 'a'", "ctx.header.form == 3", "unknown == 1"]
    of = lambda n: {"S": F.lit(2.0), "D": F.lit(0.0), "ctx.header.form": F.lit("welded"), "ctx.header.total": F.lit("7.5"), "ctx.header.none": F.lit(None).cast("string")}.get(n)
    want = spark.range(1).select(*(trigger(t, of).alias(f"c{i}") for i, t in enumerate(texts))).first()
    got = rows(spark, texts).withColumn("c", programs.conditions(F.col("t"))).select("i", programs.holds(F.col("c"), F.col("h"), F.col("d")).alias("v")).collect()
    assert {x.i: x.v for x in got} == {i: want[f"c{i}"] for i in range(len(texts))}


def test_offsets(spark):
    """Each that holds is added; a missing value differs from any text; what cannot be read or names no bound does nothing."""
    one = lambda w, lo=None, hi=None: {"when": w, "min_offset": lo, "max_offset": hi}
    cases = [
        (None, 490.0, 600.0), ([], 490.0, 600.0), ([one("ctx.header.form == 'welded'", -20.0)], 470.0, 600.0), ([one("ctx.header.form != 'welded'", -20.0, 5.0)], 490.0, 600.0), ([one("ctx.header.none != 'x'", 1.0, 2.0)], 491.0, 602.0),
        ([one("ctx.header.form=='welded'", 1.0), one('x ctx.header.total == "7.5" y', 2.0, -3.0), one("gibberish", 99.0, 99.0), one(None, 5.0)], 493.0, 597.0), ([one("ctx.header.none == 'x'", 1.0, 2.0)], 490.0, 600.0), ([one("ctx.header.total >= 7", 1.0, 2.0)], 490.0, 600.0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a array<struct<when:string,min_offset:double,max_offset:double>>").join(rows(spark, [""] * len(cases)).drop("t"), "i")
    x = df.withColumn("m", programs.moved(F.col("a")))
    b = lambda v, w: programs.move(F.lit(v).cast("double"), F.col("m"), w, F.col("h"))
    got = {r.i: (r.lo, r.hi, r.none) for r in x.select("i", b(490.0, "min_offset").alias("lo"), b(600.0, "max_offset").alias("hi"), b(None, "min_offset").alias("none")).collect()}
    assert got == {i: (lo, hi, None) for i, (_, lo, hi) in enumerate(cases)}


def rule(**k):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple({"spec_key": "g", "rule_type": "numeric_range", "category": "mechanical", "property_key": "Rm", "level": "MANDATORY", "decimals": 0, "pos": 1} | k for _ in [0])[0], names


def audited(spark, rules, header, value):
    certs = spark.createDataFrame([(1, "g", header, {"wall_thickness_mm": 4.0})], "cert_id long, spec_key string, header map<string,string>, dimensions map<string,double>")
    recs = spark.createDataFrame([(1, 0, "mechanical", "Rm", None, value, None, None, "core")], "cert_id long, pos int, category string, property_key string, sub_property string, value double, text string, level string, provenance string")
    cat = spark.createDataFrame([tuple(r.get(c) for c in spark.createDataFrame([], SCHEMA).columns) for r in rules], SCHEMA)
    return {r.rule_id: (r.status, r.deviation) for r in audit(certs, recs, cat).items.collect()}


@pytest.mark.parametrize(("process", "value", "want"), [("hot_extrusion", 505.0, ("PASS", 0.0)), ("cold", 505.0, ("FAIL", 15.0)), ("hot_extrusion", 495.0, ("FAIL", 5.0))])
def test_the_audit_moves_limits(spark, process, value, want):
    r, _ = rule(rule_id="r", lo=520.0, adjustments=[("ctx.header.manufacturing_process == 'hot_extrusion'", -20.0, None)])
    f, _ = rule(rule_id="f", rule_type="dynamic_expression", formula_lo="min(100 * S, ctx.mechanical.Rm) + ctx.header.total / 2", formula_hi="nonsense(", decimals=1)
    got = audited(spark, [r, f], {"manufacturing_process": process, "total": "3"}, value)
    assert got["r"] == want and got["f"][0] == "FAIL"


def test_a_large_catalogue_plans_at_once(spark):
    """A hundred thousand distinct formulas: the plan does not grow, and nothing of them comes to the driver."""
    n = 100_000
    cat = spark.range(n).select("id", F.concat(F.lit("ctx.mechanical.x * "), F.col("id").cast("string"), F.lit(" + S - max(3, "), F.col("id").cast("string"), F.lit(")")).alias("t"))
    began = time.perf_counter()
    x = cat.withColumn("s", programs.compiled(F.col("t"))).select("id", programs.evaluate(F.col("s"), lambda s, k: F.when(s == "record", 2.0).otherwise(0.5)).alias("v"))
    x._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 10
    assert x.where(F.col("v") != F.col("id") * 2 + 0.5 - F.greatest(F.lit(3), "id")).count() == 0 and x.where("v is not null").count() == n


def test_steps_of_a_large_catalogue_are_not_broadcast(spark):
    """The parts' file is small, their steps are not: a broadcast chosen by the file fails."""
    from millcheck.queries import QUERIES

    plan = QUERIES["q_formula_catalogue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_large_catalogue_is_dealt_before_it_is_compiled(spark, monkeypatch):
    """Parts are compiled in the tasks of a shuffle, not in those of their file; lines are dealt to as many tasks as they need."""
    from millcheck.operators.audit import dealt
    from millcheck.queries import QUERIES, rules

    monkeypatch.setattr(rules, "dealt", lambda df, key: dealt(df, key, 500), raising=False)
    x = QUERIES["q_formula_catalogue"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(p_partkey", plan[plan.index("ArrowEvalPython") :])
    assert set(re.findall(r"hashpartitioning\([lp]_partkey#\d+L?, (\d+)\), (?:REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", plan)) == {str(n // 500 + 1)}
    assert x.count() == n
