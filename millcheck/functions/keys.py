"""Canonical property keys: an ordered list of tests on a cleaned name; the first that holds names the property."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chemical symbols and element names, and the tests in order. A test is (start pattern, parts to contain,
# parts not to contain, whole names), then property, category, sub-property.
SYMBOLS = "C SI MN P S NI CR MO CU N TI NB AL V W B CO FE PB SN".split()
ELEMENTS = {"碳": "C", "CARBON": "C", "硅": "SI", "SILICON": "SI", "锰": "MN", "MANGANESE": "MN", "磷": "P", "PHOSPHORUS": "P", "硫": "S", "SULFUR": "S", "SULPHUR": "S", "镍": "NI", "NICKEL": "NI", "铬": "CR", "CHROMIUM": "CR", "钼": "MO", "MOLYBDENUM": "MO", "铜": "CU", "COPPER": "CU", "氮": "N", "NITROGEN": "N", "钛": "TI", "TITANIUM": "TI", "铌": "NB", "NIOBIUM": "NB", "铝": "AL", "ALUMINUM": "AL", "钒": "V", "VANADIUM": "V"}
TESTS = (
    ("RM|TS|TENSILE|抗拉强度|抗张强度|拉伸强度", ("抗拉强度",), (), (), "tensile_strength", "mechanical", None),
    ("RP02|RP0\\.2|REH|REL|YS|YIELD|屈服强度|规定塑性延伸强度|规定非比例延伸强度", ("屈服强度", "RP02"), (), (), "yield_strength_rp02", "mechanical", None),
    ("ELONGATION|EL|A50|A|断后伸长率|伸长率|延伸率", ("伸长率", "延伸率", "ELONGATION"), (), (), "elongation_A", "mechanical", None),
    (None, ("HRB", "洛氏"), (), (), "hardness", "mechanical", "HRB"),
    (None, ("HBW", "HBS", "布氏"), (), (), "hardness", "mechanical", "HBW"),
    (None, ("HV", "维氏"), (), (), "hardness", "mechanical", "HV"),
    (None, ("硬度", "HARDNESS"), (), (), "hardness", "mechanical", None),
    (None, ("冲击", "AKV", "CHARPY"), ("韧度", "K1C"), (), "impact_absorbed_energy", "mechanical", None),
    (None, ("压扁", "FLATTENING"), (), (), "flattening_test", "process", None),
    (None, ("扩口", "FLARING"), (), (), "flaring_test", "process", None),
    (None, ("弯曲", "BENDING"), (), (), "bending_test", "process", None),
    (None, ("晶粒度", "GRAINSIZE"), (), (), "grain_size", "metallographic", None),
    (None, ("晶间腐蚀", "晶腐", "IGC", "CORROSION"), (), (), "intergranular_corrosion", "corrosion", None),
    (None, ("涡流", "EDDY"), (), ("ET",), "eddy_current_test", "ndt", None),
    (None, ("超声", "ULTRASONIC"), (), ("UT",), "ultrasonic_test", "ndt", None),
    (None, ("水压", "液压", "HYDROSTATIC", "HYDRAULIC"), (), (), "hydraulic_test", "ndt", None),
    (None, ("致密性", "承压", "PRESSURETIGHTNESS", "PRESSURETEST"), (), (), "pressure_tightness", "ndt", None),
    ("ROUGHNESS|RA|RZ|RQ|表面粗糙度|粗糙度", ("粗糙度", "ROUGHNESS"), (), (), "surface_roughness", "surface", "Ra"),
    (None, ("表面", "SURFACE", "外观"), ("光洁", "FINISH"), (), "surface_quality", "surface", None),
    (None, ("尺寸", "DIMENSION", "外径壁厚"), (), (), "dimensions", "geometric", None),
    (None, ("铁素体", "FERRITE"), (), (), "ferrite_content", "metallographic", None),
)
HINTS = (("chemical", ("CHEM", "化学", "成分")), ("mechanical", ("MECH", "力学", "拉伸", "硬度")), ("process", ("PROC", "工艺")), ("metallographic", ("METALLO", "金相")), ("corrosion", ("CORROSION", "腐蚀")), ("ndt", ("NDT", "无损", "探伤")), ("geometric", ("GEO", "尺寸")), ("surface", ("SURFACE", "表面")))
ROUGHNESS_UNITS = ("μm", "um", "nm", "µm")


def cleaned(name: Column) -> Column:
    """Upper case without a category prefix, white space and marks."""
    bare = F.regexp_replace(name, "(?i)^(geo|proc|ndt|mech|metallo|chem)_", "")
    return F.regexp_replace(F.upper(bare), r"[\s\-_/():（）\[\]　]", "")


def any_of(c: Column, parts: tuple) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def hint(c: Column) -> Column:
    """Category of a free category name."""
    u, out = F.upper(c), None
    for name, parts in HINTS:
        out = F.when(any_of(u, parts), name) if out is None else out.when(any_of(u, parts), name)
    return F.coalesce(out, F.lit("other"))


def canonical(name: Column, category: Column | None = None, unit: Column | None = None, number: Column | None = None) -> Column:
    """struct(property_key, category, sub_property, is_known). unit and number tell roughness from surface quality.

    The cleaned name is worked out once a row and bound, as the tests use it some seventy times."""
    category = F.lit(None).cast("string") if category is None else category
    unit = F.lit(None).cast("string") if unit is None else unit
    made = lambda p, c, s, known=True: F.struct(p.alias("property_key"), c.alias("category"), s.cast("string").alias("sub_property"), F.lit(known).alias("is_known"))
    names = F.create_map(*[F.lit(x) for e, s in ELEMENTS.items() for x in (e, s)])
    other = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")

    def tested(k: Column) -> Column:
        symbol = F.when(k.isin(SYMBOLS), k).otherwise(F.try_element_at(names, k))
        chain = F.when(symbol.isNotNull(), made(F.initcap(symbol), F.lit("chemical"), F.lit(None)))
        for start, has, without, whole, key, cat, sub in TESTS:
            test = any_of(k, has) & ~any_of(k, without) if without else any_of(k, has)
            if start:
                test = test | k.rlike(f"^({start})")
            if whole:
                test = test | k.isin(*whole)
            value = made(F.lit(key), F.lit(cat), F.lit(sub))
            if key == "surface_roughness":
                value = made(F.lit(key), F.lit(cat), F.when(F.contains(k, F.lit("RZ")), "Rz").otherwise("Ra"))
            if key == "surface_quality":
                rough = unit.isin(*ROUGHNESS_UNITS)
                if number is not None:
                    rough = rough | (number.isNotNull() & unit.isNotNull() & (F.trim(unit) != ""))
                chain = chain.when(test & F.coalesce(rough, F.lit(False)), made(F.lit("surface_roughness"), F.lit("surface"), F.lit("Ra")))
            chain = chain.when(test, value)
        return chain.otherwise(made(other, hint(category), F.lit(None), False))

    chain = F.get(F.transform(F.array(cleaned(name)), tested), F.lit(0))
    return F.when(name.isNull(), F.lit(None)).otherwise(chain)


def category_of(key: Column) -> Column:
    """Category of a canonical property key."""
    out = F.when(F.upper(key).isin(SYMBOLS), "chemical")
    for *_, name, cat, _ in TESTS:
        out = out.when(key == name, cat)
    return out.otherwise("other")
