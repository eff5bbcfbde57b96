"""Look-ups by name, by range and by place."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.functions.rounding import exact
from millcheck.functions.text import routing_key, standard_key, standards
from millcheck.operators.audit import small
from millcheck.operators.lineage import cut


def route_keys(slices: DataFrame) -> DataFrame:
    """key, standard_id, spec_key, pos: a row per name of a slice (spec_key, primary_grade, unified_code, its aliases).
    Of slices of a standard with one key, the first by pos has it."""
    names = F.concat(F.array("primary_grade", "unified_code", "spec_key"), F.coalesce("aliases", F.array().cast("array<string>")))
    x = slices.select("standard_id", "spec_key", "pos", F.explode(F.array_compact(names)).alias("name"))
    x = x.select("standard_id", "spec_key", "pos", routing_key(F.col("name")).alias("key")).where("key <> ''")
    return x.groupBy("standard_id", "key").agg(F.min_by("spec_key", "pos").alias("spec_key"))


def resolve_grades(certs: DataFrame, slices: DataFrame) -> DataFrame:
    """certs (standard_id, grade) with the spec_key of their slice: by the grade, else by what its brackets hold, else by
    the grade as it is; null and confidence 0.5 if none. A hit by the grade has confidence 1, else 0.98."""
    keys = route_keys(slices)
    raw = F.upper(F.regexp_replace("grade", r"[\s\-_]", ""))
    tries = F.array(routing_key(F.col("grade")), routing_key(F.regexp_extract("grade", "[(（]([^)）]*)[)）]", 1)), raw)
    asked = certs.select("standard_id", "grade").distinct()
    hits = asked.select("standard_id", "grade", F.posexplode(tries).alias("at", "key")).join(small(keys), ["standard_id", "key"]).groupBy("standard_id", "grade").agg(F.min_by("spec_key", "at").alias("spec_key"), F.min("at").alias("at"))
    out = certs.join(hits, ["standard_id", "grade"], "left")
    return out.withColumn("confidence", F.when(F.col("at") == 0, 1.0).when(F.col("at").isNotNull(), 0.98).otherwise(0.5)).drop("at")


def resolve_standards(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """asked (key_id, raw) with the catalogue's ids of all standards that raw names, null unless every one is found. A name is
    looked up among ids, then among the catalogue's aliases (an array, which may be left out), then both without its dots."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in catalogue.columns else F.array().cast("array<string>")
    named = catalogue.select("standard_id", F.posexplode(F.concat(F.array("standard_id"), aliases)).alias("pos", "name"))
    rank = F.struct((F.col("pos") > 0).cast("int").alias("r"), F.col("standard_id").alias("id"))
    known = named.select(standard_key(F.col("name")).alias("k"), rank.alias("hit")).groupBy("k").agg(F.min("hit").alias("hit"))
    parts = asked.select("key_id", F.posexplode(standards(F.col("raw"))).alias("at", "name"))
    key = standard_key(F.col("name"))
    tries = parts.select("key_id", "at", F.posexplode(F.array(key, F.regexp_replace(key, r"\.", ""))).alias("attempt", "k"))
    one = tries.join(small(known), "k", "left").groupBy("key_id", "at").agg(F.min_by("hit.id", F.when(F.col("hit").isNotNull(), F.struct("attempt", "hit.r"))).alias("standard_id"))
    g = one.groupBy("key_id").agg(F.count("*").alias("n"), F.count("standard_id").alias("n_found"), F.array_sort(F.collect_list(F.struct("at", "standard_id"))).alias("s"))
    ids = F.when(F.col("n") == F.col("n_found"), F.transform("s", lambda x: x["standard_id"]))
    return g.select("key_id", F.col("n").alias("n_named"), "n_found", ids.alias("standard_ids"))


#: Widths of steps are sorted into levels of bins, the finest of which is a 2^LEVELS-th of all sizes.
LEVELS = 16


def binned(x: Column, least: float, width: Column) -> Column:
    """The bin of a size at a level of bins of a width; what has no size or lies outside is in the outermost bins."""
    return F.greatest(F.lit(0), F.floor((F.coalesce(x, F.lit(least)) - least) / width)).cast("long")


def by_bins(parts: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts with level_ and bin_, a row for each level that steps have, and steps with theirs: a step is at the finest level
    of which it covers three bins at most, so a size meets at most a few steps that do not hold it, however many there are."""
    lo, hi = steps.agg(F.least(F.min("range_min"), F.min("range_max")), F.greatest(F.max("range_min"), F.max("range_max"))).first()
    lo, hi = (0.0, 1.0) if lo is None else (float(lo), float(hi) if hi > lo else float(lo) + 1.0)
    unit = (hi - lo) / 2**LEVELS
    width = lambda level: F.lit(unit) * F.pow(F.lit(2.0), level)
    wide = F.greatest((F.col("range_max") - F.col("range_min")) / unit, F.lit(1.0))
    level = F.when(F.col("range_min").isNull() | F.col("range_max").isNull(), LEVELS).otherwise(F.least(F.ceil(F.log2(wide)), F.lit(LEVELS))).cast("int")
    s = steps.withColumn("level_", level)
    top = F.floor(F.lit(hi - lo) / width(F.col("level_"))).cast("long")
    first = F.when(F.col("range_min").isNull(), 0).otherwise(binned(F.col("range_min"), lo, width(F.col("level_"))))
    last = F.when(F.col("range_max").isNull(), top).otherwise(binned(F.col("range_max"), lo, width(F.col("level_"))))
    s = s.where("range_min is null or range_max is null or range_min <= range_max").withColumn("bin_", F.explode(F.sequence(first, F.greatest(first, last))))
    used = F.array_sort(F.array_distinct(F.collect_list("level_")))  # LEVELS + 1 numbers at most
    levels = steps.select(level.alias("level_")).distinct().agg(used).first()[0]
    p = parts.withColumn("level_", F.explode(F.array(*map(F.lit, levels or [0]))))
    return p.withColumn("bin_", binned(F.least(F.col("nominal"), F.lit(hi)), lo, width(F.col("level_")))), s


def tolerance(parts: DataFrame, steps: DataFrame) -> DataFrame:
    """parts (part_id, property, delivery, process, nominal, diameter, value) with the first step whose range holds the
    nominal size (open below, closed above) and the verdict; sizes that no step holds pass within ten percent. Sizes and steps
    meet in bins."""
    p, s = by_bins(parts, steps)
    p, s = p.alias("p"), small(s).alias("s")
    limit = F.col("s.diameter_limit")
    on = (
        (F.col("p.level_") == F.col("s.level_"))
        & (F.col("p.bin_") == F.col("s.bin_"))
        & (F.col("p.property") == F.col("s.property"))
        & (F.col("p.delivery") == F.col("s.delivery"))
        & ((F.col("s.process") == "all") | (F.col("s.process") == F.col("p.process")))
        & (F.col("s.range_min").isNull() | (F.col("p.nominal") > F.col("s.range_min")))
        & (F.col("s.range_max").isNull() | (F.col("p.nominal") <= F.col("s.range_max")))
        & (limit.isNull() | F.col("p.diameter").isNull() | (F.when(F.contains("s.note", F.lit("<=")), F.col("p.diameter") <= limit).when(F.contains("s.note", F.lit(">")), F.col("p.diameter") > limit).otherwise(True)))
    )
    first = p.join(s, on).groupBy("p.part_id").agg(F.min_by(F.struct("s.pos", "s.plus", "s.plus_percent", "s.minus", "s.minus_percent"), "s.pos").alias("step"))
    x = parts.join(first, "part_id", "left")
    size = lambda v, pct: F.when(F.col(pct), F.col("nominal") * F.col(v) / 100).otherwise(F.col(v))
    hi = F.when(F.col("step").isNull(), F.col("nominal") * 1.1).otherwise(F.round(exact(F.col("nominal") + size("step.plus", "step.plus_percent")), 4).cast("double"))
    lo = F.when(F.col("step").isNull(), F.col("nominal") * 0.9).otherwise(F.round(exact(F.col("nominal") + size("step.minus", "step.minus_percent")), 4).cast("double"))
    x = x.withColumn("lo", lo).withColumn("hi", hi).withColumn("step_pos", F.col("step.pos")).drop("step")
    v, a, b = (exact(F.col(c)) for c in ("value", "lo", "hi"))
    off = F.col("step_pos").isNotNull()
    deviation = F.when(off & (v < a), a - v).when(off & (v > b), v - b).otherwise(0).cast("double")
    return x.withColumn("ok", ~off | ((v >= a) & (v <= b))).withColumn("deviation", deviation)


#: Fields of a document up to which each token is simply compared with each; a document with more is searched by grams.
FEW = 16
GRAM = 3


def grams_of(text: Column, size: Column) -> Column:
    """The distinct runs of so many characters in a text; none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """doc_id, s, l: texts of inner (doc_id, s) within texts of outer (doc_id, l) of the same document.

    outer is indexed by all its runs of up to GRAM characters. A text is looked up by the one of its own that the fewest others
    of its document have, GRAM characters long or all of it if it is shorter, and what that finds is compared; so the
    candidates follow the matches and not the product."""
    index = outer.select("doc_id", "l", F.explode(F.concat(*(grams_of(F.col("l"), F.lit(n)) for n in range(1, GRAM + 1)))).alias("gram"))
    held = index.groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    mine = inner.select("doc_id", "s", F.explode(grams_of(F.col("s"), F.least(F.length("s"), F.lit(GRAM)))).alias("gram"))
    rarest = mine.join(held, ["doc_id", "gram"], "left").groupBy("doc_id", "s").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.max(F.col("n").isNull().cast("int")).alias("lacks"))
    return rarest.where("lacks = 0").join(index, ["doc_id", "gram"]).where(F.contains("l", F.col("s"))).select("doc_id", "s", "l")


def pairs_by_grams(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, text, str: texts of fields and tokens that are equal, or one of which holds the other."""
    texts, strs = fields.select("doc_id", "text").distinct(), tokens.select("doc_id", "str").distinct()
    equal = texts.join(strs.withColumn("text", F.trim("str")), ["doc_id", "text"]).select("doc_id", "text", "str")
    longer = strs.where(F.length("str") >= 2)
    within = contained(longer.select("doc_id", F.col("str").alias("s")), texts.select("doc_id", F.col("text").alias("l"))).select("doc_id", F.col("l").alias("text"), F.col("s").alias("str"))
    around = contained(texts.select("doc_id", F.col("text").alias("s")), longer.select("doc_id", F.col("str").alias("l"))).select("doc_id", F.col("s").alias("text"), F.col("l").alias("str"))
    return equal.union(within).union(around).distinct()


def locate(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """The token that shows each field (doc_id, field_id, text, page): equal on its page, else one that holds it or that
    it holds (of two characters or more) there, else equal anywhere, else by holding anywhere; the first in order. Joins
    within a document only; tokens: doc_id, at, str, page, x, y, w, h."""
    f = fields.select("doc_id", "field_id", F.col("page").alias("f_page"), F.trim("text").alias("text")).where("text <> ''")
    place = F.struct("page", "x", "y", "w", "h", "at")
    many = f.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("doc_id")
    same, part = F.trim("str") == F.col("text"), (F.length("str") >= 2) & (F.contains("text", F.col("str")) | F.contains("str", F.col("text")))
    crowded = not many.isEmpty()
    few = f.join(many, "doc_id", "left_anti") if crowded else f
    # few fields for each document, so a token meets FEW of them at most
    found = tokens.select("doc_id", "str", place.alias("t")).join(small(few), "doc_id").where(same | part)
    if crowded:
        f = f.join(many, "doc_id", "left_semi")
        t = tokens.join(many, "doc_id", "left_semi").groupBy("doc_id", "str", "page").agg(F.min_by(place, "at").alias("t"))
        by_grams = f.join(pairs_by_grams(f, t), ["doc_id", "text"]).join(t.drop("page"), ["doc_id", "str"])
        found = found.unionByName(by_grams.select(*found.columns))
    here = F.col("t.page") == F.col("f_page")
    grade = F.when(same & here, 1).when(part & here, 2).when(same, 3).otherwise(4)
    hits = found.groupBy("doc_id", "field_id", "f_page").agg(F.min_by("t", F.struct(grade, F.col("t.at"))).alias("b"))
    clip = lambda c, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.round(c, 2)))
    return hits.select("doc_id", "field_id", F.col("b.at").alias("at"), F.col("b.page").alias("page"), clip(F.col("b.x"), 0, 100).alias("x"), clip(F.col("b.y"), 0, 100).alias("y"), clip(F.col("b.w") + 1.0, 2, 60).alias("w"), clip(F.col("b.h") + 0.5, 1.5, 10).alias("h"))


def degrade(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names (name_id, raw) that no rule knew, resolved by wording against the candidate rules (pos, property_key,
    display_name): roughness, then size, then grain, then a name of three characters or more that contains or is
    contained; the first candidate. Names are distinct texts and candidates a catalogue, so the join is of small sides."""
    n, c = names.alias("n"), small(candidates).alias("c")
    raw, key, shown = F.lower("n.raw"), F.lower("c.property_key"), F.lower("c.display_name")
    kind = lambda words, has: raw.rlike(words) & F.contains(key, F.lit(has))
    rough, size, grain = kind("粗糙度|roughness", "roughness"), kind("尺寸|外径|壁厚|dimension", "dimension"), kind("晶粒|grain", "grain")
    named = (F.length(raw) >= 3) & (F.length(shown) >= 3) & (F.contains(raw, shown) | F.contains(shown, raw))
    confidence = F.when(rough, 0.95).when(size, 0.92).when(grain, 0.95).when(named, 0.88)
    hit = n.join(c, rough | size | grain | named).groupBy("n.name_id").agg(F.min_by(F.struct("c.property_key", confidence.alias("confidence")), "c.pos").alias("m"))
    return names.join(hit, "name_id", "left").select("name_id", "raw", F.col("m.property_key").alias("property_key"), F.col("m.confidence").alias("confidence"))


def clause_tree(nodes: DataFrame, roots: str = "parent is null") -> DataFrame:
    """Nodes (clause_id, parent, title, text, pos) in depth-first order with depth and path. One join per level of the
    tree, however deep; each level is written out. Nodes without an id or any words are left out, but not what is below
    them. A step of a path is the position in ten digits, so paths sort in order. A node whose id stands above it already ends
    its branch: it and what is below it are left out there; an id in several places has its children under each."""
    step = F.lpad(F.col("pos").cast("string"), 10, "0")
    level = nodes.where(roots).select("*", F.lit(0).alias("depth"), step.alias("path"), F.array("clause_id").alias("above_"))
    out = level
    for depth in count(1):
        up = level.select(F.col("clause_id").alias("up_"), F.col("path").alias("path_"), F.col("above_"))
        below = nodes.join(up, nodes["parent"] == up["up_"]).where(F.col("clause_id").isNull() | ~F.array_contains("above_", F.col("clause_id")))
        level = cut(below.select(*nodes.columns, F.lit(depth).alias("depth"), F.concat_ws("/", "path_", step).alias("path"), F.array_append("above_", F.col("clause_id")).alias("above_")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    words = (F.coalesce(F.trim("title"), F.lit("")) != "") | (F.coalesce(F.trim("text"), F.lit("")) != "")
    return out.where(F.col("clause_id").isNotNull() & words).drop("above_")


def contains_any(columns: list[str], q: str) -> Column:
    """Whether a text is in any of the columns, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return out


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
