"""Names, numbers and free text of certificates as columns.

Patterns name their white space: \\s of the JVM is ASCII, while source texts have full-width and no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

S = "[\\s\u3000\u00a0]"
#: A number that is not part of an identifier or of another number.
NUMBER = r"(?<![A-Za-z0-9.])[-+]?[0-9]+(?:\.[0-9]+)?"


def clean(c: Column) -> Column:
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def standards(raw: Column) -> Column:
    """The standards that a field names: split, trimmed, a space after the prefix, distinct in order."""
    parts = F.filter(F.transform(F.split(raw, "[、,;，；\\n]+"), clean), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.regexp_replace(x, f"^([A-Za-z]+(?:/[A-Za-z]+)?){S}*([A-Za-z]?[0-9].*)$", "$1 $2")))


def standard_key(c: Column) -> Column:
    """Fingerprint of a standard's id."""
    return F.upper(F.regexp_replace(c, r"[\s\-_/\\]", ""))


def same_standards(a: Column, b: Column) -> Column:
    """Whether two arrays of ids have the same set of fingerprints."""
    a, b = (F.array_distinct(F.transform(x, standard_key)) for x in (a, b))
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def routing_key(c: Column) -> Column:
    """A grade without its bracketed suffix, in upper case, without spaces, hyphens and underscores."""
    return F.regexp_replace(F.upper(F.regexp_replace(c, "[(（].*?[)）]", "")), r"[\s\-_]", "")


def grade_text(c: Column) -> Column:
    """A grade without the name of a standard body before it or brackets after it."""
    return clean(F.regexp_replace(F.regexp_replace(c, r"(?i)^(ASTM|ASME|GB/T|GB|JIS|EN|DIN)[\s\-]*(?:[A-Z]?[0-9]+[\s:/]+)?", ""), r"[(（].*?[)）]", ""))


def quantity(c: Column) -> Column:
    """struct(op, number, unit) of a text like '<= 12.5 MPa'; the number is read without its comparison. Null number
    where there is none."""
    p = rf"^{S}*(<=|>=|≤|≥|<|>)?{S}*([-+]?[0-9]+(?:\.[0-9]+)?){S}*(.*?){S}*$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("op"), part(2).try_cast("double").alias("number"), part(3).alias("unit"))


def segments(c: Column) -> Column:
    """How many assignments ('Rm: 520') a text has."""
    return F.regexp_count(c, F.lit(r"[:：=]\s*[-+]?[0-9]"))


def packaged(c: Column) -> Column:
    """Whether a text packs several measurements."""
    return segments(c) >= 2


def measured(c: Column) -> Column:
    """The first measured number of a text, null for none or a packaged text."""
    found = F.nullif(F.regexp_extract(c, NUMBER, 0), F.lit(""))
    return F.when(~packaged(c), found.try_cast("double"))


def hardness_values(c: Column) -> Column:
    """All numbers of a hardness text, its scale names taken out."""
    bare = c
    for scale in ("HRB", "HRC", "HBW", "HBS", "HB", "HV"):
        bare = F.regexp_replace(bare, rf"(?i){scale}[0-9]*(?:/[0-9]+)*", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(rf"({NUMBER})"), 1), lambda x: x.cast("double"))


def hardness_mean(c: Column) -> Column:
    """Mean of the hardness values to one decimal, half up."""
    v = hardness_values(c)
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))
    return F.floor(mean * 10 + 0.5) / 10


#: Words of free-text results.
NOT_TESTED = ("未做", "未测", "免做", "免检")
FAILED = ("不合格", "不符合", "开裂", "超标", "有裂纹", "超差", "REJECT", "CRACKS_FOUND")


def result(c: Column) -> Column:
    """PASS, FAIL or NOT_TESTED of a free text. Not tested goes before failed, what is neither passes, and an empty cell is not
    tested."""
    # searches in the text itself, so nothing is made of it first; a pattern only for words that have cases
    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | (F.contains(c, F.lit(w)) if w.upper() == w.lower() else c.rlike(f"(?iu){w}"))
        return out

    alone = lambda pattern: c.rlike(rf"(?iu)\A{S}*(?:{pattern}){S}*\z")
    return (
        F.when(c.isNull() | alone(""), "NOT_TESTED")
        .when(any_of(NOT_TESTED) | alone(r"[-/\\_]+|N/?A|NONE"), "NOT_TESTED")
        .when(any_of(FAILED) | alone("FAIL|NG|NO"), "FAIL")
        .otherwise("PASS")
    )


#: A test level or method, what stands before it, and what after it; methods that have another name.
LEVEL = r"(?i)(?:\A|[\s\u3000\u00a0(（,，])(E[1-4]H?|U[1-4]|METHOD_[A-E]|[A-E]法)(?:\z|[\s\u3000\u00a0)）,，\u4e00-\u9fa5])"
METHODS = {"E法": "Method_E", "A法": "Method_A"}


def level(c: Column) -> Column:
    """The test level or method that a text claims, null for none. It stands for itself: between the ends of the text, white
    space, brackets and commas, or before a Chinese character."""
    found = F.upper(F.regexp_extract(c, LEVEL, 1))
    out = F.when(found == "", F.lit(None).cast("string"))
    for method, name in METHODS.items():
        out = out.when(found == method, name)
    return out.otherwise(found)


def dimensions(c: Column) -> Column:
    """struct(outer, wall, length, delivery) of a size text like 'Φ25.0×2.0×6000mm'."""
    p = r"([0-9]+(?:\.[0-9]+)?)[\s]*(?:mm)?[\s]*[×*xX/][\s]*([0-9]+(?:\.[0-9]+)?)(?:[\s]*(?:mm)?[\s]*[×*xX/][\s]*([0-9]+(?:\.[0-9]+)?))?"
    num = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).try_cast("double")
    alone = F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    labelled = lambda name: F.nullif(F.regexp_extract(c, rf"(?i){name}[\s:=]*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    delivery = F.when(F.contains(c, F.lit("最小壁厚")) | c.rlike("(?i)min"), "min_wall").when(F.contains(c, F.lit("平均壁厚")) | c.rlike("(?i)avg|average"), "average_wall")
    labels = c.rlike("(?i)OD|WT")
    return F.struct(F.coalesce(labelled("OD"), F.when(~labels, F.coalesce(num(1), alone))).alias("outer"), F.coalesce(labelled("WT"), F.when(~labels, num(2))).alias("wall"), F.when(~labels, num(3)).alias("length"), delivery.alias("delivery"))


def json_body(c: Column) -> Column:
    """The JSON of an answer without code fences, '{}' where it does not parse."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    return F.when(F.get_json_object(bare, "$").isNotNull(), bare).otherwise("{}")
