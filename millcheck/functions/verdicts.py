"""Evaluators of rules, scores and dispositions as columns.

Statuses are PASS, FAIL, MISSING, SKIPPED and EXEMPT. What a missing record means depends on the evaluator: for ranges
and choices it is MISSING if the rule is mandatory or conditional, for all others only if it is mandatory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millcheck.functions.rounding import difference, half_even

# Ranks, and the words of results, which differ by evaluator.
LEVEL_RANK = {"MANDATORY": 4, "CONDITIONAL": 3, "OPTIONAL_AGREED": 2, "EXEMPT": 1}
EDDY_RANK = {"E1H": 4, "E2H": 3, "E3H": 2, "E4H": 1}
ULTRASONIC_RANK = {"U1": 4, "U2": 3, "U25": 2, "U3": 1}
PROVENANCE_RANK = {"core": 3, "tier2_resolved": 1}
STATUS_RANK = {"PASS": 1, "FAIL": 2, "MISSING": 3, "SKIPPED": 4}
WORD = "(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
VISUAL = ("(?i)不合格|开裂|未通过|未达标|有裂纹|有裂口|有腐蚀|UNQUALIFIED|" + WORD.format("FAIL"), "(?i)合格|PASS|OK|无裂|QUALIFIED|NO_CRACK|NO_CORROSION")
ALTERNATIVE = ("(?i)不合格|未达到|未通过|有渗漏|渗水|破裂|开裂|UNQUALIFIED|" + WORD.format("FAIL") + "|" + WORD.format("FALSE"), "(?i)合格|PASS|OK|QUALIFIED|无渗漏|完好|NO_LEAK|" + WORD.format("TRUE"))
LEAST_LEVEL = ("(?i)不合格|FAIL|UNQUALIFIED|" + WORD.format("FALSE"), "(?i)合格|PASS|OK|QUALIFIED|" + WORD.format("TRUE"))
ENUM = ("(?i)不合格|未达到|未通过|有腐蚀|有裂纹|有裂口|开裂|UNQUALIFIED|" + WORD.format("FAIL") + "|" + WORD.format("FALSE"), "(?i)合格|PASS|OK|QUALIFIED|无裂|NO_CRACK|NO_CORROSION|" + WORD.format("TRUE"))


def rank(c: Column, ranks: dict, other: int | None) -> Column:
    out = None
    for k, v in ranks.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def absent(level: Column, conditional: bool) -> Column:
    """Status of a rule whose record is missing."""
    return F.when(level.isin("MANDATORY", "CONDITIONAL") if conditional else level == "MANDATORY", "MISSING").otherwise("SKIPPED")


def passes(text: Column, words: tuple[str, str]) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.rlike(words[1]) & ~text.rlike(words[0])


def status(found: Column, ok: Column, level: Column, conditional: bool = False) -> Column:
    return F.when(~found, absent(level, conditional)).when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")


def numeric_range(value: Column, lo: Column, hi: Column, level: Column, decimals: Column | None = None, lo_in: Column | None = None, hi_in: Column | None = None) -> Column:
    """struct(status, value, deviation, deviation_percent): lo is looked at first, hi only if lo holds."""
    v = value if decimals is None else half_even(value, decimals)
    lo_in = F.lit(True) if lo_in is None else F.coalesce(lo_in, F.lit(True))
    hi_in = F.lit(True) if hi_in is None else F.coalesce(hi_in, F.lit(True))
    below = F.coalesce((v < lo) | (~lo_in & (v == lo)), F.lit(False))
    above = F.coalesce((v > hi) | (~hi_in & (v == hi)), F.lit(False))
    deviation = F.when(below, difference(lo, v)).when(above, difference(v, hi)).otherwise(0.0)
    base = F.coalesce(F.nullif(hi, F.lit(0.0)), F.nullif(lo, F.lit(0.0)), F.lit(1.0))
    percent = F.when(below | above, F.abs(half_even(F.try_divide(deviation, base) * 100, 2))).otherwise(0.0)
    present = value.isNotNull()
    return F.struct(status(present, ~below & ~above, level, True).alias("status"), v.alias("value"), F.when(present, deviation).alias("deviation"), F.when(present, percent).alias("deviation_percent"))


def formula_bound(value: Column, lo: Column | None, hi: Column | None, level: Column, decimals: int = 3) -> Column:
    """struct(status, bound): value and bounds rounded alike, bounds inclusive; a bound that has no value fails."""
    v, known, ok = half_even(value, decimals), F.lit(True), F.lit(True)
    bounds = []
    for bound, op in ((lo, ">="), (hi, "<=")):
        if bound is not None:
            r = half_even(bound, decimals)
            bounds.append(r)
            known = known & r.isNotNull()
            ok = ok & (v >= r if op == ">=" else v <= r)
    bound = F.coalesce(*bounds) if bounds else F.lit(None).cast("double")
    return F.struct(status(value.isNotNull(), known & ok, level).alias("status"), F.when(value.isNotNull(), bound).alias("bound"))


def visual(text: Column, found: Column, level: Column) -> Column:
    return status(found, passes(text, VISUAL), level)


def alternative(text: Column, claimed: Column, required: Column) -> Column:
    """Whether one candidate of an alternative passes."""
    return passes(text, ALTERNATIVE) | F.coalesce(F.upper(claimed) == F.upper(required), F.lit(False))


def enum(text: Column, claimed: Column, claimed_number: Column, required: Column, least: Column, found: Column, level: Column) -> Column:
    """Least numeric level first, then an equal level, then the words; no evidence fails."""
    numeric = F.when(claimed_number.isNotNull(), claimed_number >= least).otherwise(passes(text, LEAST_LEVEL))
    named = F.when(claimed.isNotNull(), F.upper(claimed) == F.upper(required)).otherwise(passes(text, ENUM))
    ok = F.when(least.isNotNull(), numeric).when(required.isNotNull(), named).otherwise(passes(text, ENUM))
    return status(found, ok, level)


def dispatch(triggered: Column, reported: Column, verdict: Column) -> Column:
    """A rule that does not apply is skipped, unless its record is reported: then it is checked."""
    return F.when(~triggered & ~reported, "SKIPPED").otherwise(verdict)


def critical_value(values: Column, lo: Column, hi: Column) -> Column:
    """struct(value, margin): of several specimens, that nearest to failing, and how far it is on the right side."""
    low, high = F.array_min(values), F.array_max(values)
    nearest = F.array_min(F.transform(values, lambda v: F.struct(F.least(v - lo, hi - v).alias("d"), v.alias("v"))))
    value = F.when(lo.isNotNull() & hi.isNotNull(), nearest["v"]).when(lo.isNotNull(), low).when(hi.isNotNull(), high)
    return F.struct(value.alias("value"), half_even(F.least(value - lo, hi - value), 4).alias("margin"))


def ocr_confidence(header: dict[str, Column], n_chemical: Column, mechanical: dict[str, Column], other: Column, n_items: Column, n_boxes: Column) -> Column:
    """Confidence of an extraction, 50 to 99: up to 30 for header fields that are there, 25 for numeric chemistry, 20
    for mechanics, 25 for the share of n_items + 9 fields located by boxes, or, without boxes, of the rest's share.

    header: certificate, batch, grade, supplier, standard; mechanical: tensile, yield, elongation; both boolean, as is
    other (any process, extra or hardness result)."""
    # fixed values: points of each field
    points = {"certificate": 6, "batch": 8, "grade": 8, "supplier": 4, "standard": 4, "tensile": 6, "yield": 6, "elongation": 4}
    part = F.least(3 * n_chemical, F.lit(25)) + F.when(other, 4).otherwise(0)
    for name, there in (header | mechanical).items():
        part = part + F.when(there, points[name]).otherwise(0)
    boxes = F.floor(F.least(F.lit(1.0), n_boxes / (n_items + 9)) * 25 + 0.5)
    rest = F.floor(part / 75 * 25 + 0.5)
    return F.greatest(F.lit(50), F.least(F.lit(99), part + F.when(n_boxes > 0, boxes).otherwise(rest))).cast("long")


def grade_confidence(alias_known: Column, alias_primary: Column, text: Column) -> Column:
    """0 for no grade, 100 for a primary name, 98 for a known alias or a usual form, else 50."""
    key = F.regexp_replace(F.upper(text), r"[\s\-_/\\.]", "")
    usual = text.rlike(r"(?i)^SA\s*387") | key.rlike(r"^S[0-9]{5}$") | key.rlike(r"^[0-9]{2,3}CR[0-9]+")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).when(alias_known & alias_primary, 100).when(alias_known | usual, 98).otherwise(50)


#: Fixed values: (system verdict, human verdict) to (disposition, release, concession, effective verdict); * is any.
DISPOSITIONS = {
    ("UNAUDITED", "*"): ("PENDING_AUDIT", False, False, "UNAUDITED"),
    ("MANUAL_REVIEW", "*"): ("PENDING_REVIEW", False, False, "MANUAL_REVIEW"),
    ("PASS", None): ("RELEASE", True, False, "PASS"),
    ("PASS", "PASS"): ("RELEASE_VERIFIED", True, False, "PASS"),
    ("PASS", "WAIVED"): ("RELEASE_VERIFIED", True, False, "PASS"),
    ("PASS", "REJECT"): ("REJECTED_BY_HUMAN", False, False, "FAIL"),
    ("FAIL", None): ("REJECTED_BY_SYSTEM", False, False, "FAIL"),
    ("FAIL", "REJECT"): ("REJECTED_BY_SYSTEM", False, False, "FAIL"),
    ("FAIL", "PASS"): ("CONCESSION_RELEASE", True, True, "PASS"),
    ("FAIL", "WAIVED"): ("CONCESSION_RELEASE", True, True, "PASS"),
}


def disposition(system: Column, human: Column) -> Column:
    """struct(disposition, release, concession, effective)."""
    made = lambda d: F.struct(F.lit(d[0]).alias("disposition"), F.lit(d[1]).alias("release"), F.lit(d[2]).alias("concession"), F.lit(d[3]).alias("effective"))
    out = None
    for (s, h), d in DISPOSITIONS.items():
        test = (system == s) if h == "*" else (system == s) & (human.isNull() if h is None else F.coalesce(human == h, F.lit(False)))
        out = F.when(test, made(d)) if out is None else out.when(test, made(d))
    return out.otherwise(made(("REJECTED_BY_SYSTEM", False, False, "FAIL")))


def display(status_: Column, scissors: Column, resolved: Column) -> Column:
    """What a reader is shown: FAIL_SCISSORS over FAIL_MISSING over FAIL, INFO for skipped, PASS for exempt; RESOLVED
    marks what a later stage settled."""
    return F.when(scissors, "FAIL_SCISSORS").when(status_ == "MISSING", "FAIL_MISSING").when(status_ == "FAIL", "FAIL").when(status_ == "SKIPPED", "INFO").when(resolved, "RESOLVED").otherwise("PASS")
