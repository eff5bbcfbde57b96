"""Queries of routing, overlay, ranges, rankings and clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millcheck.functions import programs, verdicts
from millcheck.functions.verdicts import EDDY_RANK
from millcheck.operators import lookup, overlay, rank
from millcheck.operators.audit import dealt, small
from millcheck.plans.mapping import table
from millcheck.queries import query


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices: each brand is a grade of the standard 'PART', its types are aliases."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").cast("int").alias("pos"))
    return p.select(F.lit("PART").alias("standard_id"), F.col("p_brand").alias("spec_key"), F.col("p_brand").alias("primary_grade"), F.regexp_replace("p_brand", "Brand#", "BR").alias("unified_code"), F.array(F.regexp_replace("p_brand", "Brand#", "B-")).alias("aliases"), "pos")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_brand END AS spec_key, CASE p_size % 4 WHEN 3 THEN 0.5 WHEN 2 THEN 0.98 ELSE 1.0 END::DOUBLE AS confidence FROM part""")
def q_grade_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_replace("p_brand", "Brand#", "")
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("brand #"), n, F.lit(" (hot)"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("b_"), n)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("what ("), F.lit("BR "), n, F.lit(")"))).otherwise(F.lit("nothing"))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.lit("PART").alias("standard_id"), said.alias("grade"))
    return lookup.resolve_grades(asked, brands(spark, sf_dir)).select("p_partkey", "spec_key", "confidence")


@query("""SELECT c_custkey AS key_id, 1 + (c_nationkey % 2) + (c_custkey % 5 = 0)::INT AS n_named, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_nationkey % 2 = 1 THEN 'GB/T 13296-2023|NB/T 47019.5' ELSE 'GB/T 13296-2023' END AS ids FROM customer""")
def q_all_or_nothing_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.createDataFrame([("GB/T 13296-2023",), ("NB/T 47019.5",)], "standard_id string")
    raw = F.concat(F.lit("GB/T13296_2023"), F.when(F.col("c_nationkey") % 2 == 1, "、NB/T 47019.5").otherwise(""), F.when(F.col("c_custkey") % 5 == 0, "; XX 1").otherwise(""))
    r = lookup.resolve_standards(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), raw.alias("raw")), catalogue)
    return r.select("key_id", F.col("n_named").cast("int").alias("n_named"), F.array_join("standard_ids", "|").alias("ids"))


STEPS = [(1, 0.0, 10.0, 10.0, True, -10.0, True), (2, 10.0, 20.0, 2.0, False, 0.0, False), (3, 15.0, 40.0, 12.5, True, -5.0, True)]


@query("""WITH s AS (SELECT * FROM (VALUES (1, 0, 10, 0.10, -0.10, 0, 0), (2, 10, 20, 0, 0, 2, 0), (3, 15, 40, 0.125, -0.05, 0, 0)) v(pos, a, b, up, dn, up_mm, dn_mm)), m AS (SELECT p_partkey, p_size, p_size + (p_retailprice % 7) - 3 AS value, min(pos) AS pos FROM part LEFT JOIN s ON p_size > a AND p_size <= b GROUP BY 1, 2, 3),
x AS (SELECT p_partkey, m.pos, value, coalesce(round(p_size + p_size * up + up_mm, 4), p_size * 1.1) AS hi, coalesce(round(p_size + p_size * dn + dn_mm, 4), p_size * 0.9) AS lo FROM m LEFT JOIN s ON s.pos = m.pos)
SELECT p_partkey, pos AS step_pos, round(lo, 4)::DOUBLE AS lo, round(hi, 4)::DOUBLE AS hi, pos IS NULL OR (round(value, 4) BETWEEN lo AND hi) AS ok FROM x""")
def q_range_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.createDataFrame([(p, "wall", "all", "min_wall", a, b, u, up, m, mp, None, None) for p, a, b, u, up, m, mp in STEPS], "pos int, property string, process string, delivery string, range_min double, range_max double, plus double, plus_percent boolean, minus double, minus_percent boolean, diameter_limit double, note string")
    size = F.col("p_size").cast("double")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.lit("wall").alias("property"), F.lit("min_wall").alias("delivery"), F.lit("cold_drawn").alias("process"), size.alias("nominal"), F.lit(None).cast("double").alias("diameter"), F.round(size + (F.col("p_retailprice") % 7) - 3, 4).alias("value"))
    t = lookup.tolerance(parts, steps)
    return t.select(F.col("part_id").alias("p_partkey"), "step_pos", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "ok")


#: Overlay: each brand is a property, each type a source; suppliers of the limits are part sizes and prices.
OVERLAY = """src AS (SELECT p_brand AS key, p_type AS standard_id, dense_rank() OVER (ORDER BY p_type) AS t, min(p_size)::DOUBLE AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN t = 1 THEN 'technical_agreement' WHEN t < 4 THEN 'industry_standard' ELSE 'national_standard' END AS category, CASE WHEN t = 1 THEN 1 WHEN t < 4 THEN 2 ELSE 4 END AS priority FROM src)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    # a row per distinct type, whose order is dense
    types = p.select("p_type").distinct().withColumn("t", F.row_number().over(Window.orderBy("p_type")))
    g = p.groupBy("p_brand", "p_type").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_retailprice").alias("hi")).join(small(types), "p_type")
    category = F.when(F.col("t") == 1, "technical_agreement").when(F.col("t") < 4, "industry_standard").otherwise("national_standard")
    return g.select(
        F.col("p_brand").alias("property_key"), F.lit(None).cast("string").alias("sub_property"), F.col("p_type").alias("standard_id"), category.alias("category"), F.when(F.col("t") == 1, 1).when(F.col("t") < 4, 2).otherwise(4).alias("priority"), F.col("t").alias("pos"),
        F.concat_ws(":", "p_brand", "p_type").alias("rule_id"), F.when(F.col("t") == 2, "CONDITIONAL").otherwise("OPTIONAL_AGREED").alias("level"), "lo", "hi", F.lit("mm").alias("unit"), (F.col("t") % 3).cast("int").alias("decimals"), F.lit("numeric_range").alias("rule_type"),
    )


@query(f"""WITH {OVERLAY}, f AS (SELECT key, arg_min(category, {{'p': priority, 't': t}}) AS first_category, arg_min(lo, {{'p': priority, 't': t}}) AS first_lo, arg_min(hi, {{'p': priority, 't': t}}) AS first_hi, arg_min(standard_id, {{'p': priority, 't': t}}) AS first_by, max(lo) AS max_lo, min(lo) AS min_lo, min(hi) AS min_hi, max(hi) AS max_hi,
 max(CASE WHEN t > 1 THEN lo END) AS base_lo, min(CASE WHEN t > 1 THEN hi END) AS base_hi, arg_min(standard_id, {{'x': -lo, 'p': priority, 't': t}}) AS lo_by, arg_min(standard_id, {{'x': hi, 'p': priority, 't': t}}) AS hi_by, count(*) AS n_sources, max(t % 3)::INT AS decimals, CASE WHEN bool_or(t = 2) THEN 'CONDITIONAL' ELSE 'OPTIONAL_AGREED' END AS level FROM s GROUP BY key),
g AS (SELECT *, first_category = 'technical_agreement' AND (coalesce(first_lo < base_lo, false) OR coalesce(first_hi > base_hi, false)) AS relaxed FROM f)
SELECT key, level, CASE WHEN relaxed THEN first_lo ELSE max_lo END AS lo, CASE WHEN relaxed THEN first_hi ELSE min_hi END AS hi, decimals, CASE WHEN relaxed THEN first_by WHEN max_lo <> min_lo THEN lo_by WHEN max_hi <> min_hi THEN hi_by ELSE first_by END AS governing, relaxed OR max_lo <> min_lo OR max_hi <> min_hi AS tightened, relaxed, n_sources FROM g""")
def q_overlay_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.envelope(sources(spark, sf_dir)).select("key", "level", "lo", "hi", "decimals", "governing", "tightened", "relaxed", "n_sources")


@query(f"""WITH {OVERLAY}, e AS (SELECT *, 'E' || (1 + t % 4) || 'H' AS level FROM s) SELECT key, min(level) AS best_level, arg_min(standard_id, {{'l': level, 'p': priority, 't': t}}) AS governing, count(*) AS n_sources FROM e GROUP BY key""")
def q_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).withColumn("eddy", F.concat(F.lit("E"), 1 + F.col("pos") % 4, F.lit("H")))
    return overlay.best_level(s, "eddy", EDDY_RANK).select("key", "best_level", "governing", "n_sources")


@query(f"""WITH {OVERLAY}, m AS (SELECT key AS code, 'e' || (t % 3) AS element, CASE WHEN t % 3 = 0 THEN '>=' ELSE '<=' END AS op, lo AS value, category FROM s), a AS (SELECT DISTINCT code, element FROM m WHERE category = 'technical_agreement'),
x AS (SELECT m.* FROM m WHERE code NOT IN (SELECT code FROM a) OR (code, element) IN (SELECT (code, element) FROM a)) SELECT code, element, op, CASE WHEN op = '>=' THEN max(value) ELSE min(value) END AS value, least(2, (SELECT count(DISTINCT element) FROM x y WHERE y.code = x.code)) AS min_pass FROM x GROUP BY 1, 2, 3""")
def q_group_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    m = s.select(F.col("property_key").alias("code"), "standard_id", "category", "priority", F.concat(F.lit("e"), F.col("pos") % 3).alias("element"), F.when(F.col("pos") % 3 == 0, ">=").otherwise("<=").alias("op"), F.col("lo").alias("value"), F.lit(2).alias("min_pass"))
    return overlay.pinned_groups(m)


@query(f"WITH {OVERLAY} SELECT key, CASE WHEN count(*) = 1 THEN 'copied' WHEN bool_and(t % 2 = 0) THEN 'envelope' WHEN bool_or(t = 3) THEN 'alternative' ELSE 'first' END AS overlay FROM s GROUP BY key")
def q_overlay_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).withColumn("rule_type", F.when(F.col("pos") % 2 == 0, "numeric_range").when(F.col("pos") == 3, "alternative_group").otherwise("qualitative_pass"))
    return overlay.kind_of_overlay(s)


#: Names asked for: each part is a certificate whose grade is its brand in one of six spellings and which declares one or two standards.
ASKED = "CASE p_partkey % 6 WHEN 0 THEN 'brand ' || n WHEN 1 THEN 'BR-' || n || 'X' WHEN 2 THEN 'B_' || n || ' (old)' WHEN 3 THEN 'zz' || p_size WHEN 4 THEN 'Brand#' || n || '-' || p_size || 'H' ELSE 'steel ' || p_size END"


@query(rf"""WITH p AS (SELECT *, substr(p_brand, 7) AS n FROM part), a AS (SELECT p_partkey AS cert_id, {ASKED} AS raw, CASE p_partkey % 4 WHEN 0 THEN ['S1', 'S2'] WHEN 1 THEN ['S1'] WHEN 2 THEN ['S2', 'S3'] ELSE ['S3', 'S9'] END AS ids FROM p),
s AS (SELECT 'S' || (1 + (pos % 3)) AS standard_id, grade, pos, k FROM (SELECT p_brand AS grade, min(p_partkey) AS pos, [upper(p_brand), 'BR' || substr(p_brand, 7), 'B' || substr(p_brand, 7)] AS k FROM part GROUP BY p_brand) UNION ALL
 SELECT 'S' || (1 + ((min(p_partkey) + 1) % 3)), p_brand, 1000000 + min(p_partkey), ['X' || substr(p_brand, 7), upper(p_brand)] FROM part GROUP BY p_brand),
d AS (SELECT DISTINCT raw, ids FROM a), f AS (SELECT raw, ids, standard_id, grade, pos, k FROM (SELECT raw, ids, unnest(ids) AS standard_id FROM d) JOIN s USING (standard_id)),
sh AS (SELECT raw, ids, grade, count(DISTINCT standard_id) >= len(ids) AND len(ids) > 1 AS shared FROM f GROUP BY 1, 2, 3),
w AS (SELECT raw, list_filter(regexp_split_to_array(regexp_replace(upper(raw), '[()\[\]]', ' ', 'g'), '[\s\-_/]+'), lambda x: x <> '') AS parts FROM (SELECT DISTINCT raw FROM d)),
tk AS (SELECT raw, list_distinct(list_concat(parts, list_transform(parts, lambda x: regexp_extract(x, '\d+')), list_transform(parts, lambda x: regexp_extract(x, '\d+[A-Z]+')))) AS tokens FROM w),
e AS (SELECT f.*, regexp_replace(upper(raw), '[\s\-_]', '', 'g') AS r, unnest(k) AS key, tokens FROM f JOIN tk USING (raw)),
m AS (SELECT *, contains(r, key) OR contains(key, r) AS held, len(list_filter(tokens, lambda t: length(t) >= 4 AND contains(key, t))) > 0 AS t4, len(list_filter(tokens, lambda t: length(t) >= 3 AND contains(key, t))) > 0 AS t3,
 list_sum([CASE WHEN i <= length(r) AND i <= length(key) AND substr(r, i, 1) = substr(key, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, 30)]) / greatest(length(r), length(key)) AS alike FROM e),
t AS (SELECT raw, ids, grade, pos, CASE WHEN bool_or(held) THEN 0.95 ELSE greatest(CASE WHEN bool_or(t4) THEN 0.9 WHEN bool_or(t3) THEN 0.8 ELSE 0.1 END, max(alike)) END::DOUBLE AS token FROM m GROUP BY 1, 2, 3, 4),
z AS (SELECT t.*, round(CASE WHEN shared THEN least(0.99, token + 0.05) ELSE token END, 6) AS score FROM t JOIN sh USING (raw, ids, grade)), g AS (SELECT raw, ids, grade, max(score) AS score, arg_min(pos, {{'s': -score, 'p': pos}}) AS pos FROM z GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY raw, ids ORDER BY score DESC, pos) AS rank_ FROM g)
SELECT cert_id, rank_::INT AS rank_, grade, score, greatest(50, least(99, floor(score * 100 + 0.5)))::BIGINT AS percent FROM a JOIN r USING (raw, ids) WHERE rank_ <= 3""")
def q_candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.substring("p_brand", 7, 10)
    one = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    standard = lambda shift: F.concat(F.lit("S"), 1 + (F.col("first") + shift) % 3)
    slices = one.select(F.concat(F.lit("a"), "p_brand").alias("slice_id"), standard(0).alias("standard_id"), F.col("p_brand").alias("grade"), F.array(F.col("p_brand"), F.concat(F.lit("BR"), n), F.concat(F.lit("B-"), n)).alias("names"), F.col("first").alias("pos"))
    slices = slices.union(one.select(F.concat(F.lit("b"), "p_brand"), standard(1), "p_brand", F.array(F.concat(F.lit("X"), n), F.col("p_brand")), 1000000 + F.col("first")))
    raw = F.expr(ASKED.replace(" n ", " substr(p_brand, 7) "))
    k = F.col("p_partkey") % 4
    ids = F.when(k == 0, F.array(F.lit("S1"), F.lit("S2"))).when(k == 1, F.array(F.lit("S1"), F.lit("UNKNOWN"))).when(k == 2, F.array(F.lit("S2"), F.lit("S3"), F.lit(" "))).otherwise(F.array(F.lit("S3"), F.lit("S9")))
    return rank.recommend(p.select(F.col("p_partkey").alias("cert_id"), raw.alias("raw"), ids.alias("standard_ids")), slices).select("cert_id", "rank_", "grade", "score", "percent")


@query("""WITH v AS (SELECT o_orderkey AS cert_id, ['TI', 'MO', 'C'][1 + i] AS e, ((o_custkey + i * 7) % 20) / 100 AS x FROM orders, (SELECT unnest(range(3)) AS i)), l(slice_id, e, lo, hi) AS (VALUES ('a', 'TI', 0.06, 0.10), ('a', 'C', NULL, 0.08), ('b', 'C', 0.02, 0.20), ('b', 'NB', 0.06, 1.0)),
p AS (SELECT cert_id, slice_id, v.e, CASE WHEN l.e IS NULL THEN CASE WHEN v.e IN ('TI', 'MO') AND x > 0.05 THEN 0.5 ELSE 0.9 END ELSE greatest(0, 1 - least(1, 2.5 * CASE WHEN x < lo THEN (lo - x) / greatest(0.01, lo) WHEN x > hi THEN (x - hi) / greatest(0.01, hi) ELSE 0 END)) END AS pts FROM v CROSS JOIN (VALUES ('a'), ('b')) s(slice_id) LEFT JOIN l USING (slice_id, e))
SELECT cert_id, slice_id, round(greatest(0, least(1, greatest(0, sum(pts) - CASE slice_id WHEN 'b' THEN 0.5 ELSE 0 END) / 3)), 6)::DOUBLE AS chem FROM p GROUP BY 1, 2""")
def q_candidate_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(i).alias("i")) for i, e in enumerate(("TI", "MO", "C"))))
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"), "o_custkey", F.explode(elements).alias("x"))
    v = v.select("cert_id", F.col("x.e").alias("element"), (((F.col("o_custkey") + F.col("x.i") * 7) % 20) / 100).alias("value"))
    limits = spark.createDataFrame([("a", "TI", 0.06, 0.10), ("a", "C", None, 0.08), ("b", "C", 0.02, 0.20), ("b", "NB", 0.06, 1.0)], "slice_id string, element string, lo double, hi double")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("slice_id"))
    return rank.chemistry_scores(v, limits, asked).select("cert_id", "slice_id", F.round("chem", 6).alias("chem"))


@query("""SELECT grade, code, CASE WHEN upper(code) = 'PART 12' OR upper(grade) = 'PART 12' THEN 100 WHEN replace(replace(upper(grade), ' ', ''), '_', '') = 'PART12' OR replace(upper(code), '-', '') = 'PART12' THEN 92 WHEN starts_with(upper(code), 'PART 12') THEN 90 WHEN starts_with(upper(grade), 'PART 12') THEN 85 WHEN contains(upper(code), 'PART 12') THEN 80 WHEN contains(upper(grade), 'PART 12') THEN 75
 WHEN contains(regexp_replace(upper(code), '[\\s\\-_/\\\\()]', '', 'g'), 'PART12') OR contains(regexp_replace(upper(grade), '[\\s\\-_/\\\\()]', '', 'g'), 'PART12') THEN 65 ELSE 0 END AS score
FROM (SELECT p_name || ' ' || p_partkey AS grade, 'part-' || p_partkey AS code FROM part) WHERE score > 0 ORDER BY score DESC, grade LIMIT 8""")
def q_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("grade"), F.concat(F.lit("part-"), "p_partkey").alias("code"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("shown"))
    return rank.fuzzy_search(pool, "part 12").select("grade", "code", "score")


@query("""WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS clause_id, r_name AS title, 0 AS depth, lpad(r_regionkey::VARCHAR, 10, '0') AS path FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 1, t.path || '/' || lpad(n_nationkey::VARCHAR, 10, '0') FROM nation JOIN t ON t.clause_id = 'R' || n_regionkey) SELECT clause_id, title, depth, path FROM t""")
def q_clause_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("clause_id"), none.alias("parent"), F.col("r_name").alias("title"), none.alias("text"), F.col("r_regionkey").alias("pos"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), "n_name", none, "n_nationkey")
    return lookup.clause_tree(r.union(n)).select("clause_id", "title", "depth", "path")


@query("""SELECT item_id, contains(lower(text), 'that') AS hit FROM benchmark WHERE contains(lower(text), 'that') OR contains(lower(text), 'ción')""")
def q_clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.where(lookup.contains_any(["text"], "THAT") | lookup.contains_any(["text"], "ción")).select("item_id", lookup.contains_any(["text"], "that").alias("hit"))


@query("""WITH f AS (SELECT doc_id, i AS field_id, ['the', 'de', 'thehe'][i] AS q FROM documents, (SELECT unnest([1, 2, 3]) AS i)), w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS str, generate_subscripts(string_split(text, ' '), 1) - 1 AS tok FROM documents),
m AS (SELECT f.doc_id, field_id, tok, (1 + (tok % 2))::INT AS page, CASE WHEN trim(str) = q AND tok % 2 = 0 THEN 1 WHEN length(str) >= 2 AND (contains(q, str) OR contains(str, q)) AND tok % 2 = 0 THEN 2 WHEN trim(str) = q THEN 3 WHEN length(str) >= 2 AND (contains(q, str) OR contains(str, q)) THEN 4 END AS g FROM f JOIN w USING (doc_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY g, tok) AS n FROM m WHERE g IS NOT NULL) SELECT doc_id, field_id, tok::INT AS token_at, page, least(100.0, tok * 1.5)::DOUBLE AS x FROM b WHERE n = 1""")
def q_bbox_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    fields = d.select("doc_id", F.posexplode(F.array(*map(F.lit, ("the", "de", "thehe")))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("field_id"), "text", F.lit(1).alias("page"))
    tokens = d.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "str")).select("doc_id", "at", "str", (1 + F.col("at") % 2).alias("page"), (F.col("at") * 1.5).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    return lookup.locate(fields, tokens).select("doc_id", "field_id", F.col("at").alias("token_at"), "page", "x")


@query("""SELECT name_id, raw, CASE WHEN contains(raw, 'economy') THEN 'p_two' WHEN contains(raw, 'standard') THEN 'p_three' END AS property_key, CASE WHEN contains(raw, 'economy') OR contains(raw, 'standard') THEN 0.88::DOUBLE END AS confidence FROM (SELECT row_number() OVER (ORDER BY lower(p_type))::INT AS name_id, lower(p_type) AS raw FROM (SELECT DISTINCT p_type FROM part))""")
def q_degrade_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.lower("p_type").alias("raw")).distinct().withColumn("name_id", F.row_number().over(Window.orderBy("raw")))
    candidates = spark.createDataFrame([(1, "surface_roughness", "ab"), (2, "p_two", "economy"), (3, "p_three", "standard")], "pos int, property_key string, display_name string")
    return lookup.degrade(names, candidates)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size::DOUBLE * (l_quantity + p_retailprice) - greatest(l_quantity, p_size::DOUBLE / 2) AS bound, l_extendedprice >= p_size::DOUBLE * (l_quantity + p_retailprice) - greatest(l_quantity, p_size::DOUBLE / 2) AS inside
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def q_formula_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of its own for each part, compiled where the parts are and worked out for each line."""
    size = F.col("p_size").cast("string")
    texts = F.concat(size, F.lit(" * (ctx.mechanical.quantity + S) - max(ctx.mechanical.quantity, "), size, F.lit(" / 2)"))
    # a small file of many parts is read by a task or two, which would compile them all
    parts = table(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", "p_retailprice", programs.compiled(texts).alias("steps"))
    # steps are many times the size of the file that they come from, by which a broadcast would be chosen
    x = dealt(table(spark, sf_dir, "lineitem"), "l_partkey").join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    value = programs.evaluate(F.col("steps"), lambda source, name: F.when(source == "record", F.col("l_quantity")).when(source == "dimension", F.col("p_retailprice")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("bound"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bound", (F.col("l_extendedprice") >= F.col("bound")).alias("inside"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders), q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS v, s, p FROM lineitem JOIN a ON o_orderkey = l_orderkey),
b AS (SELECT *, 3.0::DOUBLE + CASE WHEN s <> 'O' THEN 2 ELSE 0 END AS lo, 40.0::DOUBLE + CASE WHEN s = 'F' THEN 6 ELSE 0 END + CASE WHEN p <> '1-URGENT' THEN -4 ELSE 0 END AS hi FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lo, hi, CASE WHEN v < lo OR v > hi THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN v < lo THEN lo - v WHEN v > hi THEN v - hi ELSE 0 END::DOUBLE AS deviation FROM b""")
def q_bound_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits moved by what the certificate says, in the order in which the rule lists its offsets."""
    a = [("ctx.header.status == 'F'", None, 6.0), ("ctx.header.status != 'O'", 2.0, None), ("ctx.header.priority != '1-URGENT'", None, -4.0), ("ctx.header.status > 3", 50.0, 50.0), ("ctx.header.none == 'x'", 9.0, 9.0)]
    rule = spark.createDataFrame([(a,)], "a array<struct<when:string,min_offset:double,max_offset:double>>").select(programs.moved(F.col("a")).alias("moved"))
    header = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header")).crossJoin(F.broadcast(rule))
    o = o.select("o_orderkey", programs.move(F.lit(3.0), F.col("moved"), "min_offset", F.col("header")).alias("lo"), programs.move(F.lit(40.0), F.col("moved"), "max_offset", F.col("header")).alias("hi"))
    x = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    v = verdicts.numeric_range(F.col("l_quantity"), F.col("lo"), F.col("hi"), F.lit("MANDATORY"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lo", "hi", v["status"].alias("status"), v["deviation"].alias("deviation"))
