"""Aliases as of a time, usual grades, standards by alias and without dots, interval bins, clause trees that repeat, results."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from millcheck.functions import text
from millcheck.functions.keys import canonical
from millcheck.operators import aliases, lookup

DAY = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, event_at timestamp, alias string, status string, property_key string, category string, key string, life string"


def event(i, day, status, key="tensile_strength", alias="My Rm"):
    return (i, None if day is None else DAY + dt.timedelta(days=day), alias, status, key, "mechanical", "clash", "clash")


def test_aliases_are_valid_from_time_to_time(spark):
    events = [event(1, 1, "registered"), event(2, 3, "revoked"), event(3, 5, "restored"), event(4, 6, "registered", "yield"), event(5, 8, "deleted"), event(6, 9, "restored"), event(7, 11, "registered", "elongation_A", "my-rm"), event(8, None, "registered"), event(9, 2, "what"), event(10, 2, "revoked", alias=None)]
    known = aliases.intervals(spark.createDataFrame(events, EVENTS))
    got = sorted(((r.valid_from - DAY).days, None if r.valid_to is None else (r.valid_to - DAY).days, r.property_key) for r in known.collect())
    assert got == [(1, 3, "tensile_strength"), (5, 6, "tensile_strength"), (6, 8, "yield"), (11, None, "elongation_A")]
    days = [0, 1, 2, 3, 4, 5, 6, 7.9, 8, 10, 11, 99, None]
    recs = spark.createDataFrame([(i, " mech_MY (rm) ", None if d is None else DAY + dt.timedelta(days=d), "x") for i, d in enumerate(days)] + [(50, "Other name", DAY, "x"), (51, None, DAY, "x"), (52, "抗拉强度", DAY, "x")], "i int, raw string, at timestamp, key_ string").drop("key_")
    of = {r.i: r.property for r in aliases.property_as_of(recs, known, "raw", "at").collect()}
    want = [None, "tensile_strength", "tensile_strength", None, None, "tensile_strength", "yield", "yield", None, None, "elongation_A", "elongation_A", None]
    assert [of[i].property_key if of[i].is_learned else None for i in range(len(days))] == want
    assert of[50].property_key == "other_name" and not of[50].is_known and of[51].property_key is None and of[52].property_key == "tensile_strength" and not of[52].is_learned


def test_as_of_matches_brute_force(spark):
    r = random.Random(3)
    events = [event(i, r.randrange(0, 60), r.choice(["registered", "revoked", "restored", "deleted"]), r.choice("pqr"), f"a{r.randrange(5)}") for i in range(150)]
    recs = [(i, f"A{r.randrange(6)}", DAY + dt.timedelta(days=r.randrange(0, 62))) for i in range(300)]

    def brute(raw, at):
        now = taught = None
        for e in sorted((e for e in events if e[2].upper() == raw and e[1] <= at), key=lambda e: (e[1], e[0])):
            taught = e[4] if e[3] == "registered" else None if e[3] == "deleted" else taught
            now = taught if e[3] in ("registered", "restored") else None
        return now

    known = aliases.intervals(spark.createDataFrame(events, EVENTS))
    got = aliases.as_of(spark.createDataFrame(recs, "i long, raw string, at timestamp"), known, "raw", "at").collect()
    assert len(got) == 300 and {x.i: x.learned and x.learned.property_key for x in got} == {i: brute(raw, at) for i, raw, at in recs}


def test_usual_grades(spark):
    cases = {
        "TP304": ("06Cr19Ni10", "S30408", 0.98), "tp-304L": ("022Cr19Ni10", "S30403", 0.98), "ASTM A213/A213M TP316L (UNS S31603)": ("022Cr17Ni12Mo2", "S31603", 0.98), "GB/T 13296-2023: 0Cr18Ni9": ("06Cr19Ni10", "S30408", 0.98),
        "N08904": ("015Cr21Ni26Mo5Cu2", "S39042", 0.98), "JIS G3459 SUS430": ("10Cr17", "S11710", 0.98), "Odd (x)": ("Odd", None, 0.5), "": ("", None, 0.5), None: (None, None, 0.5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "g string")
    assert {r.g: (r.u.primary_grade, r.u.unified_code, r.u.confidence) for r in df.select("g", aliases.usual_grade(F.col("g")).alias("u")).collect()} == cases


def test_standards_by_alias_and_without_dots(spark):
    cat = spark.createDataFrame([("GB/T 13296", ["GB13296", "old one"]), ("NB/T 470195", ["NB.X"]), ("NB/T 47019.6", None)], "standard_id string, aliases array<string>")
    asked = spark.createDataFrame([(1, "gb 13296"), (2, "GB/T13296、OLD-ONE"), (3, "NB/T 47019.5"), (4, "NBX"), (5, "NB/T 47019.6; nothing"), (6, "NB.X"), (7, "NB/T 47019.6")], "key_id int, raw string")
    got = {r.key_id: r.standard_ids for r in lookup.resolve_standards(asked, cat).collect()}
    # dots are left out of what is asked, not of the catalogue
    assert got == {1: ["GB/T 13296"], 2: ["GB/T 13296", "GB/T 13296"], 3: ["NB/T 470195"], 4: None, 5: None, 6: ["NB/T 470195"], 7: ["NB/T 47019.6"]}


STEPS = "pos int, property string, process string, delivery string, range_min double, range_max double, plus double, plus_percent boolean, minus double, minus_percent boolean, diameter_limit double, note string, level_ string, bin_ string"


def step(pos, lo, hi, process="all"):
    return (pos, "wall", process, "d", lo, hi, 1.0, False, -1.0, False, None, None, "clash", "clash")


def parts_of(spark, sizes):
    return spark.createDataFrame([(i, "wall", "d", "cold", x, None, x) for i, x in enumerate(sizes)], "part_id int, property string, delivery string, process string, nominal double, diameter double, value double")


@pytest.mark.parametrize("seed", range(3))
def test_bins_hold_the_first_step(spark, seed):
    r = random.Random(seed)
    edge = lambda: r.choice([None, 0.0, 10.0, 10.5, 1000.0, r.uniform(-5, 1000)])
    steps = [step(i, edge(), edge(), r.choice(["all", "cold", "hot"])) for i in range(60)]
    sizes = [None, -5.0, 0.0, 10.0, 10.5, 1000.0, 2000.0, -99.0] + [r.uniform(-10, 1100) for _ in range(150)]
    holds = lambda s, x: s[2] in ("all", "cold") and (s[4] is None or (x is not None and x > s[4])) and (s[5] is None or (x is not None and x <= s[5]))
    want = {i: min((s[0] for s in steps if holds(s, x)), default=None) for i, x in enumerate(sizes)}
    got = lookup.tolerance(parts_of(spark, sizes), spark.createDataFrame(steps, STEPS).drop("level_", "bin_")).collect()
    assert {g.part_id: g.step_pos for g in got} == want and len(got) == len(sizes)


def test_many_steps(spark):
    """Two hundred thousand narrow steps and as many sizes; a size meets a few steps only."""
    n = 200_000
    s = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.lit("wall").alias("property"), F.lit("all").alias("process"), F.lit("d").alias("delivery"), F.col("id").cast("double").alias("range_min"), (F.col("id") + 1.0).alias("range_max"), F.lit(1.0).alias("plus"), F.lit(False).alias("plus_percent"), F.lit(-1.0).alias("minus"), F.lit(False).alias("minus_percent"), F.lit(None).cast("double").alias("diameter_limit"), F.lit(None).cast("string").alias("note"))
    p = spark.range(n).select(F.col("id").cast("int").alias("part_id"), F.lit("wall").alias("property"), F.lit("d").alias("delivery"), F.lit("cold").alias("process"), (F.col("id") + 0.5).alias("nominal"), F.lit(None).cast("double").alias("diameter"), F.col("id").cast("double").alias("value"))
    began = time.perf_counter()
    assert lookup.tolerance(p, s).where("step_pos = part_id").count() == n
    assert time.perf_counter() - began < 60


def test_clause_trees_that_repeat_themselves(spark):
    nodes = [("a", None, "A", None, 1), ("b", "a", "B", None, 1), ("a", "b", "A", None, 1), ("c", "b", "C", None, 2), ("b", "c", "B", None, 1), ("s", None, "S", None, 2), ("c", "s", "C", None, 1), ("x", "x", "self", None, 1)]
    df = spark.createDataFrame(nodes, "clause_id string, parent string, title string, text string, pos int")
    got = sorted((r.depth, r.clause_id, r.path) for r in lookup.clause_tree(df).collect())
    at = lambda *p: "/".join(f"{i:010d}" for i in p)
    # below s, c has a b, whose a and c are new to that path but for c
    assert got == sorted([(0, "a", at(1)), (0, "s", at(2)), (1, "b", at(1, 1)), (1, "c", at(2, 1)), (2, "c", at(1, 1, 2)), (2, "b", at(2, 1, 1)), (3, "a", at(2, 1, 1, 1))])
    assert "above_" not in lookup.clause_tree(df).columns


def test_results_of_free_text(spark):
    """The result and the level of cells as certificates have them."""
    cases = {
        "合格 (未见裂纹)": ("PASS", None), "PASS (E3H 验收合格)": ("PASS", "E3H"), "合格 (U2 等级)": ("PASS", "U2"), "无晶间腐蚀倾向 (E法合格)": ("PASS", "Method_E"), "压扁至间距 H 时表面开裂 (不合格)": ("FAIL", None), "NG": ("FAIL", None), "未做": ("NOT_TESTED", None),
        "-": ("NOT_TESTED", None), "N/A": ("NOT_TESTED", None), "": ("NOT_TESTED", None), "  　": ("NOT_TESTED", None), None: ("NOT_TESTED", None), "SIZE1": ("PASS", None), "PRICE12": ("PASS", None), "U25": ("PASS", None), "E法": ("PASS", "Method_E"), "a法": ("PASS", "Method_A"), "B法": ("PASS", "B法"),
        "method_e": ("PASS", "METHOD_E"), "e4h,ok": ("PASS", "E4H"), "xE3H": ("PASS", None), "E5": ("PASS", None), "（U3）": ("PASS", "U3"), " U1 ": ("PASS", "U1"), "E2合格": ("PASS", "E2"), "no": ("FAIL", None), "NO cracks": ("PASS", None), "rejected": ("FAIL", None), "none": ("NOT_TESTED", None), "--/_\\": ("NOT_TESTED", None), "未测 NG": ("NOT_TESTED", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.result(F.col("t")).alias("r"), text.level(F.col("t")).alias("l"))
    assert {x.t: (x.r, x.l) for x in df.collect()} == cases


def test_one_busy_name(spark):
    """A hundred thousand intervals and as many records of one name: the work grows with the rows, not with their product."""
    n = 100_000
    at = lambda shift: F.timestamp_seconds(F.col("id") * 60 + shift)
    known = spark.range(n).select(F.lit("RM").alias("key"), F.concat(F.lit("p"), "id").alias("property_key"), F.lit("c").alias("category"), at(0).alias("valid_from"), F.when(F.col("id") % 3 > 0, at(30)).otherwise(at(60)).alias("valid_to"))
    records = spark.range(n).select("id", F.lit(" rm").alias("raw"), at(30).alias("at"))
    began = time.perf_counter()
    got = aliases.as_of(records, known, "raw", "at")
    right = F.col("learned.property_key").eqNullSafe(F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), "id")))
    assert got.agg(F.count("*"), F.count(F.when(right, 1))).collect() == [(n, n)]
    assert time.perf_counter() - began < 60


def test_a_name_is_cleaned_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(canonical(F.col("s")).alias("k")).select("k.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 9
