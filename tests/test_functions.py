from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millcheck.functions import keys, rounding, text, units, verdicts
from millcheck.functions.formula import FormulaError, adjustment, compile_formula, trigger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("v,d,want", [(1.145, 2, 1.14), (1.135, 2, 1.14), (-1.145, 2, -1.14), (15.5, 0, 16.0), (14.5001, 0, 15.0), (1.1450000001, 2, 1.15), (0.0005, 3, 0.0), (1e-5, 4, 0.0)])
def test_half_even(spark, v, d, want):
    assert one(spark, rounding.half_even(F.lit(v), d)) == want
    assert one(spark, rounding.half_even(F.lit(v), F.lit(d))) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(-10000, 10000, places=4), min_size=1, max_size=30))
def test_half_even_is_decimal_rounding(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", rounding.half_even(F.col("v"), 2).alias("r")).collect()
    assert all(r.r == float(Decimal(repr(r.v)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for r in rows)


def test_compare(spark):
    ok, dev = rounding.compare(F.lit(0.086), F.lit(0.08), "<=")
    assert one(spark, ok) is False and one(spark, dev) == 0.006


@pytest.mark.parametrize("raw,want", [("GB/T13296-2023、NB/T 47019.5; GB/T 13296-2023", ["GB/T 13296-2023", "NB/T 47019.5"]), ("　 ,", []), ("ASTM A213", ["ASTM A213"])])
def test_standards(spark, raw, want):
    assert one(spark, text.standards(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("520 MPa", 520.0), ("Rp0.2", None), ("Rp0.2: 334 Rm: 520", None), ("<0.005", 0.005), ("HV10", None), ("", None), (None, None)])
def test_measured(spark, raw, want):
    assert one(spark, text.measured(F.lit(raw).cast("string"))) == want


def test_hardness(spark):
    assert one(spark, text.hardness_values(F.lit("HV10 152 153 155"))) == [152.0, 153.0, 155.0]
    assert one(spark, text.hardness_mean(F.lit("HRB 80; 81; 81.15"))) == 80.7
    assert one(spark, text.hardness_mean(F.lit("none"))) is None


@pytest.mark.parametrize("raw,want", [("合格", "PASS"), ("不合格", "FAIL"), ("未见开裂", "FAIL"), ("免检", "NOT_TESTED"), ("--", "NOT_TESTED"), ("n/a", "NOT_TESTED"), ("NO", "FAIL"), ("whatever", "PASS"), (None, "NOT_TESTED"), ("", "NOT_TESTED")])
def test_result(spark, raw, want):
    assert one(spark, text.result(F.lit(raw).cast("string"))) == want


def test_quantity_and_units(spark):
    q = one(spark, text.quantity(F.lit(" ≤ 12.5 ksi")))
    assert (q.op, q.number, q.unit) == ("≤", 12.5, "ksi")
    assert one(spark, text.quantity(F.lit("abc"))).number is None
    assert one(spark, units.to_mpa(F.lit(50.0), F.lit("kgf/mm2"))) == pytest.approx(490.3325)
    assert one(spark, units.to_mm(F.lit(2.0), F.lit("inch"))) == 50.8
    assert one(spark, units.to_mm(F.lit(2.0), F.lit(None).cast("string"))) == 2.0


def test_dimensions(spark):
    d = one(spark, text.dimensions(F.lit("Φ25.0×2.0×6000mm 最小壁厚")))
    assert (d.outer, d.wall, d.length, d.delivery) == (25.0, 2.0, 6000.0, "min_wall")
    d = one(spark, text.dimensions(F.lit("OD: 38 WT=2.5")))
    assert (d.outer, d.wall) == (38.0, 2.5)


@pytest.mark.parametrize("raw,key,cat", [("C", "C", "chemical"), ("锰", "Mn", "chemical"), ("mech_Rm", "tensile_strength", "mechanical"), ("Rp0.2", "yield_strength_rp02", "mechanical"), ("AKV", "elongation_A", "mechanical"), ("冲击韧度", "冲击韧度", "other"), ("ET", "eddy_current_test", "ndt"), ("表面质量", "surface_quality", "surface"), ("My Thing", "my_thing", "other")])
def test_canonical(spark, raw, key, cat):
    k = one(spark, keys.canonical(F.lit(raw)))
    assert (k.property_key, k.category) == (key, cat)


def test_surface_by_unit(spark):
    assert one(spark, keys.canonical(F.lit("表面"), None, F.lit("μm"))).property_key == "surface_roughness"


def test_formula(spark):
    v = {"ctx.chemical.C": 0.06, "ctx.chemical.N": 0.03, "S": 2.0}
    get = lambda n: F.lit(v[n]) if n in v else None
    run = lambda t: one(spark, compile_formula(t, get))
    assert run("4 * (ctx.chemical.C + ctx.chemical.N)") == pytest.approx(0.36)
    assert run("-2 + 3 * -S / 4") == -3.5
    assert run("max(1, min(S, 5), sqrt(9))") == 3.0
    assert run("1 / (S - 2)") is None and run("sqrt(0 - 1)") is None
    for bad in ("1 +", "foo(1)", "X + 1", "1 2", "(1"):
        with pytest.raises(FormulaError):
            compile_formula(bad, get)


def test_conditions(spark):
    get = lambda n: {"ctx.header.form": F.lit("welded"), "S": F.lit(1.5)}.get(n)
    t = lambda s: one(spark, trigger(s, get))
    assert t(None) and t("not a condition") and t("S <= 1.7 && ctx.header.form == 'welded'")
    assert not t("S >= 1.7") and not t("ctx.header.missing == 'x'") and not t("ctx.header.form > 'a'")
    assert not one(spark, adjustment("gibberish", get)) and one(spark, adjustment("ctx.header.form == 'welded'", get))


def test_numeric_range(spark):
    r = lambda *a, **k: one(spark, verdicts.numeric_range(*(F.lit(x).cast("double") for x in a), F.lit("MANDATORY"), **k))
    x = r(0.086, None, 0.08)
    assert (x.status, x.deviation, x.deviation_percent) == ("FAIL", 0.006, 7.5)
    assert r(None, 1, 2).status == "MISSING" and r(1, 1, 2).status == "PASS"
    assert r(1, 1, 2, lo_in=F.lit(False)).status == "FAIL"
    assert r(0.085, None, 0.08, decimals=F.lit(2)).status == "PASS"


@pytest.mark.parametrize("level,ranged,other", [("MANDATORY", "MISSING", "MISSING"), ("CONDITIONAL", "MISSING", "SKIPPED"), ("OPTIONAL_AGREED", "SKIPPED", "SKIPPED")])
def test_missing_policy(spark, level, ranged, other):
    assert one(spark, verdicts.absent(F.lit(level), True)) == ranged and one(spark, verdicts.absent(F.lit(level), False)) == other


def test_words(spark):
    p = lambda t, w: one(spark, verdicts.passes(F.lit(t), w))
    assert p("合格", verdicts.VISUAL) and not p("不合格", verdicts.VISUAL) and not p("不合格FAIL", verdicts.ALTERNATIVE) and p("无渗漏", verdicts.ALTERNATIVE) and not p(None, verdicts.ENUM)


@pytest.mark.parametrize("s,h,want", [("PASS", None, "RELEASE"), ("PASS", "REJECT", "REJECTED_BY_HUMAN"), ("FAIL", "WAIVED", "CONCESSION_RELEASE"), ("FAIL", "REJECT", "REJECTED_BY_SYSTEM"), ("UNAUDITED", "PASS", "PENDING_AUDIT"), ("odd", None, "REJECTED_BY_SYSTEM")])
def test_disposition(spark, s, h, want):
    assert one(spark, verdicts.disposition(F.lit(s), F.lit(h).cast("string"))).disposition == want


def test_critical_value(spark):
    c = one(spark, verdicts.critical_value(F.array(F.lit(10.0), F.lit(44.0), F.lit(20.0)), F.lit(5.0), F.lit(45.0)))
    assert (c.value, c.margin) == (44.0, 1.0)
