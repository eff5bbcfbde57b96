"""Queries of rule stores, files, ledgers, batches, presentation and corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.functions import formula, keys, text, units
from millcheck.operators import adapter, audit, ledger, overlay, presentation, review
from millcheck.operators.lineage import shared_dir
from millcheck.plans.mapping import table
from millcheck.queries import query
from millcheck.sources import rule_store
from millcheck.streaming import progressive


def nth(c: Column, *values: object) -> Column:
    """The value at a number, counted from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def stored(df: DataFrame, *by: str) -> str:
    """Texts as files in the shared folder, with folders by columns."""
    path = f"{shared_dir(df.sparkSession)}/store-{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.partitionBy(*by).text(path)
    return path


def standard() -> Column:
    """Five standards for parts."""
    return F.concat(F.lit("M"), F.col("p_partkey") % 5)


def rules_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per part, read from one file per standard."""
    p = table(spark, sf_dir, "part")
    k, price = F.col("p_size"), F.col("p_retailprice").cast("string")
    requirement = F.struct(nth(k, "<=", ">=", "between", "==").alias("operator"), F.when(k % 4 == 2, F.concat(F.lit("[1, "), price, F.lit("]"))).otherwise(price).alias("value"), F.when(k % 5 == 0, 1).alias("rounding_decimals"))
    selection = F.struct(nth(k, "chemical", "mechanical", None).alias("category"), nth(k, "chem.element.Ti", "mech.hardness.HV", "test.flattening").alias("data_element_id"))
    rule = F.struct(F.format_string("R%08d", "p_partkey").alias("rule_id"), nth(k, "MANDATORY", "OPTIONAL").alias("conformance_level"), selection.alias("selection"), requirement.alias("requirement"))
    files = p.groupBy(standard().alias("standard")).agg(F.to_json(F.array_sort(F.collect_list(rule), lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).otherwise(1))).alias("value"))
    return rule_store.atomic_rules(spark, f"{stored(files, 'standard')}/*/*.txt")


@query("""WITH r AS (SELECT *, printf('R%08d', p_partkey) AS rule_id, 'standard=M' || (p_partkey % 5) AS standard_id FROM part), n AS (SELECT *, (row_number() OVER (PARTITION BY standard_id ORDER BY rule_id) - 1)::INT AS pos FROM r)
SELECT standard_id, p_brand AS spec_key, rule_id, pos, ['<=', '>=', 'between', '=='][1 + p_size % 4] AS operator FROM n WHERE p_size % 2 = 0""")
def q_rule_store_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and grade index of files, joined; ids of the index that no rule has are dropped."""
    p = table(spark, sf_dir, "part").where("p_size % 2 = 0")
    ids = p.groupBy(standard().alias("standard"), "p_brand").agg(F.concat(F.collect_list(F.format_string("R%08d", "p_partkey")), F.array(F.lit("gone"))).alias("ids"))
    files = ids.groupBy("standard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "ids")))).alias("value"))
    index = rule_store.grade_index(spark, f"{stored(files, 'standard')}/*/*.txt")
    return rule_store.slices_of(rules_of_parts(spark, sf_dir), index).select("standard_id", "spec_key", "rule_id", "pos", F.col("requirement.operator").alias("operator"))


@query("""SELECT printf('R%08d', p_partkey) AS rule_id, CASE WHEN p_size % 4 = 3 THEN 'qualitative_enum' ELSE 'numeric_range' END AS rule_type, CASE p_size % 3 WHEN 0 THEN 'chemical' WHEN 1 THEN 'mechanical' ELSE 'other' END AS category, ['Ti', 'hardness', 'flattening_test'][1 + p_size % 3] AS property_key,
 CASE WHEN p_size % 3 = 1 THEN 'HV' END AS sub_property, CASE p_size % 2 WHEN 0 THEN 'MANDATORY' ELSE 'OPTIONAL_AGREED' END AS level, CASE p_size % 4 WHEN 1 THEN p_retailprice WHEN 2 THEN 1.0 END::DOUBLE AS lo, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 2 THEN p_retailprice END AS hi, CASE WHEN p_size % 5 = 0 THEN 1 END AS decimals FROM part""")
def q_evaluation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_store.evaluation_rules(rules_of_parts(spark, sf_dir)).select("rule_id", "rule_type", "category", "property_key", "sub_property", "level", "lo", "hi", "decimals")


@query("""WITH r AS (SELECT 'M' || (p_partkey % 5) AS standard_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'R' || p_size END AS rule_id, p_partkey FROM part)
SELECT standard_id, 'repeated id' AS problem, rule_id FROM r GROUP BY 1, rule_id HAVING count(*) > 1 UNION ALL SELECT standard_id, 'missing field', rule_id FROM r WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0""")
def q_rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    selection, requirement = F.struct(F.when(k % 7 != 0, "x").alias("data_element_id")), F.struct(F.lit("<=").alias("operator"))
    return rule_store.validate(table(spark, sf_dir, "part").select(standard().alias("standard_id"), F.when(k % 11 != 0, F.concat(F.lit("R"), "p_size")).alias("rule_id"), selection.alias("selection"), requirement.alias("requirement")))


@query("SELECT 'M' || (p_partkey % 5) AS standard_id, count(DISTINCT p_brand) AS n_slices, count(DISTINCT p_size) AS n_rules FROM part GROUP BY 1")
def q_standards_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_store.overview(table(spark, sf_dir, "part").select(standard().alias("standard_id"), F.col("p_brand").alias("spec_key"), F.col("p_size").alias("rule_id")))


@query("""SELECT 'N' || n_regionkey AS standard_id, n_name AS title, 'folder' AS origin FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
SELECT 'N' || n_regionkey, n_name, 'file' FROM nation WHERE n_nationkey % 5 > 1 AND 'N' || n_regionkey NOT IN (SELECT 'N' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey < 3) AND n_regionkey >= 0""".replace("n_nationkey % 3 = 0 UNION", "n_nationkey % 3 = 0 AND n_regionkey < 3 UNION"))
def q_modular_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_regionkey").alias("standard_id"), F.col("n_name").alias("title"), "n_nationkey", "n_regionkey")
    modular = n.where("n_nationkey % 3 = 0 and n_regionkey < 3").select("standard_id", "title", F.lit("folder").alias("origin"))
    file = F.concat(F.lit("rules/"), nth(F.col("n_nationkey"), "Alias_", "test_", "a", "b", "c"), "title", F.lit(".json"))
    return rule_store.modular_first(modular, n.select("standard_id", "title", F.lit("file").alias("origin"), file.alias("file")))


@query("SELECT DISTINCT 'standard=M' || (p_partkey % 5) AS standard_id, p_brand AS spec_key, CASE WHEN p_brand < 'Brand#3' THEN 'duplex' END AS structure_type, 'B-' || substr(p_brand, 7) AS alias FROM part")
def q_legacy_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("p_brand").alias("spec_key"), F.when(F.col("p_brand") < "Brand#3", "duplex").alias("structure_type"), F.array(F.regexp_replace("p_brand", "Brand#", "B-")).alias("aliases"), F.array(F.struct(F.lit(1).alias("a"))).alias("evaluation_rules"))
    files = table(spark, sf_dir, "part").groupBy(standard().alias("standard")).agg(F.to_json(F.collect_set(one)).alias("value"))
    return rule_store.legacy_slices(spark, f"{stored(files, 'standard')}/*/*.txt").select("standard_id", "spec_key", "structure_type", F.col("aliases")[0].alias("alias"))


@query("""SELECT s_suppkey AS row_id, s_name AS standard_id, CASE WHEN s_nationkey % 2 = 0 THEN 'title of ' || s_name END AS standard_name, CASE s_nationkey % 3 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'WITHDRAWN' ELSE 'CURRENT' END AS status FROM supplier""")
def q_standard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey")
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("standard_code"), F.when(k % 2 == 0, F.concat(F.lit("title of "), "s_name")).alias("title"), nth(k, "ACTIVE", "WITHDRAWN", None).alias("status"))
    return rule_store.standard_meta(raw).join(raw.select("s_suppkey", F.col("standard_code").alias("standard_id")), "standard_id").select(F.col("s_suppkey").alias("row_id"), "standard_id", "standard_name", "status")


@query("""SELECT 'R' || r_regionkey AS clause_id, NULL::VARCHAR AS parent, r_name AS title, 0 AS n_below FROM region WHERE FALSE UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 1 FROM nation UNION ALL SELECT 'N' || n_nationkey || 'a', 'N' || n_nationkey, 'deep', 2 FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL, r_name, 0 FROM region""")
def q_clause_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause trees of a file, a level at a time."""
    name = lambda p, c: F.concat(F.lit(p), c)
    deep = F.array(F.struct(F.concat(F.lit("N"), F.col("n_nationkey"), F.lit("a")).alias("clause_id"), F.lit("deep").alias("title"), F.array().cast("array<string>").alias("children")))
    below = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(name("N", F.col("n_nationkey")).alias("clause_id"), F.col("n_name").alias("title"), deep.alias("children"))).alias("children"))
    r = table(spark, sf_dir, "region").join(below, F.col("r_regionkey") == F.col("n_regionkey"), "left").agg(F.to_json(F.collect_list(F.struct(name("R", F.col("r_regionkey")).alias("clause_id"), F.col("r_name").alias("title"), "children"))).alias("value"))
    c = rule_store.clauses(spark, stored(r))
    depth = F.when(F.col("parent").isNull(), 0).when(F.startswith("parent", F.lit("R")), 1).otherwise(2)
    return c.select("clause_id", "parent", "title", depth.alias("n_below"))


@query("""SELECT o_orderkey AS session_id, CASE WHEN o_custkey % 2 = 0 THEN 'asset:/' || o_orderkey || '/0' ELSE 'text' END AS page, date_trunc('month', o_orderdate)::DATE::VARCHAR AS day, year(o_orderdate) = 1995 AS in_1995 FROM orders WHERE o_orderstatus <> 'P'""")
def q_ledger_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all orders is written by the first days of months, read whole and for one year; sessions are deleted."""
    o = table(spark, sf_dir, "orders").withColumn("saved_at", F.date_trunc("month", "o_orderdate"))
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    page = F.when(F.col("o_custkey") % 2 == 0, "data:image/png;base64,AAAA").otherwise("text")
    rule_store.write_ledger(o.select(F.col("o_orderkey").alias("session_id"), "saved_at", F.array(page).alias("pages")).repartition("saved_at"), path)
    left = rule_store.without_sessions(rule_store.read_ledger(spark, path), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("session_id")))
    year = rule_store.read_ledger(spark, path, ("1995-01-01", "1995-12-31")).select("session_id", F.lit(True).alias("in_1995"))
    return left.join(year, "session_id", "left").select("session_id", F.col("pages")[0].alias("page"), F.col("day").cast("string").alias("day"), F.coalesce("in_1995", F.lit(False)).alias("in_1995"))


@query("SELECT event_type AS tag, count(*) AS n, max(ts::TIMESTAMP)::VARCHAR AS last, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM events GROUP BY 1")
def q_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events written as JSON lines and read back."""
    e = table(spark, sf_dir, "events")
    lines = e.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("tag"), F.lit("m").alias("message"), F.col("value").alias("duration_ms"))).alias("value"))
    got = rule_store.logs(spark, stored(lines)).groupBy("tag").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double").alias("total"))
    shown = F.regexp_replace(F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return got.select("tag", "n", F.when(F.date_format("last", "SSSSSS") == "000000", F.date_format("last", "yyyy-MM-dd HH:mm:ss")).otherwise(shown).alias("last"), "total")


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size END AS a, CASE WHEN p_size % 3 < 2 THEN p_brand END AS b FROM part")
def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON, some in a code fence, some broken."""
    body = F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b")))
    said = F.when(F.col("p_size") % 3 == 0, body).when(F.col("p_size") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("sorry, "), body))
    return rule_store.answers(table(spark, sf_dir, "part").select("p_partkey", said.alias("said")), "said", "a int, b string").select("p_partkey", "parsed.a", "parsed.b")


@query("""WITH n AS (SELECT c_custkey::VARCHAR AS md5, 'v' || (c_nationkey % 2) AS v FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey::VARCHAR AS md5, 'v' || (c_nationkey % 4 // 2) AS v FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT md5, v, 'new' AS origin FROM n UNION ALL SELECT md5, v, 'old' FROM o WHERE (md5, v) NOT IN (SELECT (md5, v) FROM n)) SELECT c_custkey::VARCHAR AS md5, coalesce(v, '-') AS version, coalesce(origin, 'missing') AS origin FROM customer LEFT JOIN m ON m.md5 = c_custkey::VARCHAR""")
def q_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cache rows in place of old ones, and the files that neither has."""
    c = table(spark, sf_dir, "customer")
    row = lambda v, origin: (F.col("c_custkey").cast("string").alias("md5"), F.concat(F.lit("v"), v.cast("int")).alias("parserConfigVersion"), F.lit(origin).alias("origin"))
    new = c.where("c_custkey % 3 = 0").select(*row(F.col("c_nationkey") % 2, "new"))
    old = c.where("c_custkey % 2 = 0").select(*row(F.floor(F.col("c_nationkey") % 4 / 2), "old"))
    merged = rule_store.put_cache(new, old)
    missing = rule_store.missing_from_cache(c.select(F.col("c_custkey").cast("string").alias("md5")), merged).select("md5", F.lit("-").alias("parserConfigVersion"), F.lit("missing").alias("origin"))
    return merged.union(missing).withColumnRenamed("parserConfigVersion", "version")


@query("""SELECT c_custkey::VARCHAR AS md5 FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0""")
def q_valid_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached documents of one parser version that are complete."""
    k = F.col("c_custkey")
    some = F.array(F.struct(F.array(F.lit("c")).alias("chemical"), F.array().cast("array<string>").alias("tests")))
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("md5"), nth(F.col("c_nationkey"), "v2", "v1").alias("version"), nth(k, "L2", "L1", None).alias("level"), F.lit("DONE").alias("status"), F.when(k % 5 > 0, some).otherwise(F.slice(some, 1, 0)).alias("batches"))
    return ledger.valid_cache(c, "v2").select("md5")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'TP' || p_size WHEN 1 THEN '304L' WHEN 2 THEN '06Cr19Ni10' ELSE p_brand END AS grade FROM part""")
def q_grade_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades without the names of standards before them and brackets after them."""
    k = F.col("p_size")
    said = F.when(k % 4 == 0, F.concat(F.lit("ASTM A213 TP"), k)).when(k % 4 == 1, " 304L (hot rolled) ").when(k % 4 == 2, "GB/T 13296 06Cr19Ni10（S30408）").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.grade_text(said).alias("grade"))


@query("SELECT p_partkey, ['chemical', 'mechanical', 'other', 'chemical'][1 + p_size % 4] AS category, ['chemical', 'other', 'mechanical'][1 + p_size % 3] AS hinted, (p_retailprice + 0.0) AS percent FROM part")
def q_category_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of property keys, those that category names hint at, and percents."""
    k = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", keys.category_of(nth(k, "Ti", "tensile_strength", "nothing", "Mo")).alias("category"), keys.hint(nth(k, "Chemical composition", "odd", "mechanical tests")).alias("hinted"), units.to_percent(F.col("p_retailprice"), F.lit("%")).alias("percent"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'surface_roughness' ELSE 'surface_quality' END AS property_key, CASE WHEN p_size % 3 = 0 THEN 'Ra' END AS sub_property FROM part")
def q_roughness_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is called surface quality is roughness if its unit is one of lengths."""
    k = keys.canonical(F.lit("surface quality"), F.lit("surface"), nth(F.col("p_size"), "μm", None, ""))
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("k")).select("p_partkey", "k.property_key", "k.sub_property")


@query("""SELECT o_orderkey AS batch_id, CASE WHEN o_custkey % 2 = 0 THEN '0.' || o_custkey ELSE '0.08' END AS carbon, CASE WHEN o_custkey % 3 = 0 THEN '600' ELSE '520' END AS strength FROM orders""")
def q_edited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of batches that a reviewer changed."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderkey").alias("batch_id"), F.array(F.struct(F.lit("C").alias("element"), F.lit("0.08").alias("value"))).alias("chemical"), F.create_map(F.lit("tensile_rm"), F.lit("520")).alias("mechanical"))
    edits = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("batch_id"), F.lit("chem_c").alias("field"), F.concat(F.lit("0."), "o_custkey").alias("value"))
    edits = edits.union(o.where("o_custkey % 3 = 0").select("o_orderkey", F.lit("mech_tensile_rm"), F.lit("600")))
    return adapter.set_value(b, edits).select("batch_id", F.col("chemical")[0]["value"].alias("carbon"), F.col("mechanical")["tensile_rm"].alias("strength"))


@query("""WITH b AS (SELECT o_orderkey AS batch_id, o_custkey % 90 AS k FROM orders), r AS (SELECT batch_id, 1 AS o, 'chemical' AS category, 'C' AS property_key, NULL AS sub_property, (k / 1000)::DOUBLE AS value FROM b UNION ALL SELECT batch_id, 2, 'mechanical', 'tensile_strength', NULL, 500 + k FROM b UNION ALL
 SELECT batch_id, 5, 'mechanical', 'hardness', 'HV', 150 + k FROM b WHERE k % 2 = 0) SELECT batch_id, (row_number() OVER (PARTITION BY batch_id ORDER BY o) - 1)::INT AS pos, category, property_key, sub_property, value FROM r""")
def q_batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw batches, some with empty fields, as records."""
    k = F.col("o_custkey") % 90
    hard = F.when(k % 2 == 0, F.concat(F.lit("HV "), 150 + k)).otherwise(" ")
    chem = F.array(F.struct(F.lit("C").alias("element"), F.concat((k / 1000).cast("string"), F.lit(" %")).alias("value")), F.struct(F.lit("Mn").alias("element"), F.lit("").alias("value")))
    mech = F.create_map(F.lit("tensile_rm"), F.concat(500 + k, F.lit(" MPa")), F.lit("hardness"), hard)
    none = F.lit(None)
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), chem.alias("chemical"), mech.alias("mechanical"), none.cast("map<string,string>").alias("process"), none.cast("array<struct<name:string,value:string,unit:string,category:string>>").alias("extra"))
    return adapter.records(b).select("batch_id", "pos", "category", "property_key", "sub_property", "value")


@query("SELECT o_orderkey AS cert_id, o_orderstatus = 'F' AS is_f, o_orderstatus <> 'F' AS not_f, false AS unread FROM orders")
def q_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of limit adjustments: one equality on a text; what cannot be read does not hold."""
    of = lambda name: F.col("o_orderstatus") if name == "ctx.header.status" else None
    made = {"is_f": "ctx.header.status == 'F'", "not_f": "ctx.header.status != 'F'", "unread": "ctx.header.status >= 3"}
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"), *(formula.adjustment(t, of).alias(n) for n, t in made.items()))


@query("SELECT p_partkey FROM part WHERE (p_size % 3 > 0 OR p_size % 2 = 0) AND p_size % 5 <> 0 AND p_size % 7 <> 0")
def q_long_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no rule is likely to know: not empty, and no counts or weights."""
    k = F.col("p_size")
    recs = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, "重量 kg").otherwise(F.col("p_name")).alias("name"), (k % 3 == 0).alias("is_known"), F.when(k % 2 == 0, "other").otherwise("mechanical").alias("category"), F.when(k % 7 != 0, " x ").alias("raw"))
    return adapter.long_tail(recs.where(adapter.not_empty(F.lit(None).cast("double"), F.col("raw"), F.lit(None).cast("string")))).select("p_partkey")


@query("""SELECT DISTINCT p_brand AS spec_key, q, s AS structure FROM part, (VALUES ('', 'all'), ('B-1', 'all'), ('rand#2', 'duplex'), ('', 'austenitic')) v(q, s) WHERE (s = 'all' OR (s = 'duplex' AND p_brand >= 'Brand#2') OR (s = 'austenitic' AND p_brand < 'Brand#2')) AND (q = '' OR (q = 'B-1' AND starts_with(p_brand, 'Brand#1')) OR (q = 'rand#2' AND contains(p_brand, 'rand#2')))""")
def q_slice_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_brand") < "Brand#2", "austenitic").when(F.col("p_brand") < "Brand#4", "duplex").otherwise("austenitic_ferritic")
    none = F.lit(None).cast("string")
    slices = table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_key"), none.alias("primary_grade"), none.alias("unified_code"), none.alias("display_name"), F.array(F.regexp_replace("p_brand", "Brand#", "B-")).alias("aliases"), kind.alias("structure_type")).distinct()
    out = None
    for q, s in (("", "all"), ("B-1", "all"), ("rand#2", "duplex"), ("", "austenitic")):
        x = presentation.slice_filter(slices, f" {q} ", s).select("spec_key", F.lit(q).alias("q"), F.lit(s).alias("structure"))
        out = x if out is None else out.union(x)
    return out


@query("""WITH i AS (SELECT o_orderkey AS item_id, ['PASS', 'FAIL', 'MISSING'][1 + o_custkey % 3] AS status, ['chemical', 'ndt'][1 + o_custkey % 2] AS category FROM orders)
SELECT 'all' AS wanted, count(*) AS n FROM i UNION ALL SELECT 'fail_or_missing', count(*) FROM i WHERE status <> 'PASS' UNION ALL SELECT 'ndt', count(*) FROM i WHERE category = 'ndt'""")
def q_item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    items = table(spark, sf_dir, "orders").select(nth(k, "PASS", "FAIL", "MISSING").alias("status"), nth(k, "chemical", "ndt").alias("category"))
    counts = [presentation.item_filter(items, w).agg(F.count("*").alias("n")).select(F.lit(w).alias("wanted"), "n") for w in ("all", "fail_or_missing", "ndt")]
    return counts[0].union(counts[1]).union(counts[2])


@query("""SELECT l_orderkey AS cert_id, l_linenumber AS item, CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_partkey % 8 = 0 THEN 'degraded' ELSE 'resolved' END WHEN l_suppkey % 3 = 0 THEN 'corrected' END AS origin FROM lineitem""")
def q_item_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items come from: their resolution, else a reviewer's correction."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("p"), "l_linenumber", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey")
    items = li.select(F.col("l_orderkey").alias("cert_id"), F.col("l_linenumber").alias("item"), key.alias("property_key"))
    resolved = li.where("l_partkey % 4 = 0").select(F.col("l_orderkey").alias("cert_id"), key.alias("resolved_key"), (F.col("l_partkey") % 8 == 0).alias("is_degraded"), F.lit(1).alias("pos"))
    corrections = li.where("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("cert_id"), F.lit("said").alias("raw_name"), key.alias("target_key"))
    return presentation.origins(items, resolved, corrections).select("cert_id", "item", "origin")


@query("""SELECT o_orderkey AS cert_id, CASE o_custkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'shown' WHEN 2 THEN 'mapped ' || o_orderkey WHEN 3 THEN 'test ' || o_orderkey ELSE CASE o_orderkey % 2 WHEN 0 THEN '未识别非标排除项' ELSE '特约检验项目' END END AS shown FROM orders""")
def q_shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what no rule asked for: raw, shown, mapped by a reviewer, of the test with its result, or a text."""
    k, i = F.col("o_custkey") % 5, F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(i.alias("cert_id"), k.alias("k"))
    i = F.col("cert_id")
    key = F.when((F.col("k") == 4) & (i % 2 == 0), presentation.REJECTED).otherwise("some_key")
    un = o.select("cert_id", F.lit(1).alias("rec_id"), key.alias("property_key"), F.when(F.col("k") == 0, "raw").when(F.col("k") == 1, presentation.AGREED).alias("raw_name"), F.when(F.col("k") < 2, "shown").otherwise(" ").alias("display_name"), F.when(F.col("k") == 3, "7").alias("measured"))
    corrections = o.where("k = 2").select("cert_id", F.concat(F.lit("mapped "), i).alias("raw_name"), F.lit("some_key").alias("target_key"))
    tests = o.select("cert_id", F.concat(F.lit("test "), i).alias("name"), F.lit("7").alias("result"))
    return presentation.shown_names(un, corrections, tests).select("cert_id", "shown")


@query("""WITH i AS (SELECT l_orderkey AS cert_id, count(*) FILTER (l_linestatus = 'F') AS n_ok, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey AS cert_id, count(*) AS n_rejected FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS cert_id, coalesce(n, 0) + coalesce(n_rejected, 0) AS n_items, coalesce(n_rejected, 0) AS n_fail, CASE WHEN coalesce(n, 0) = 0 THEN 'MANUAL_REVIEW' WHEN n_rejected > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders LEFT JOIN i ON i.cert_id = o_orderkey LEFT JOIN x ON x.cert_id = o_orderkey""")
def q_rejected_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer rejected fails its certificate."""
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("cert_id"), F.concat(F.lit("r"), "l_linenumber").alias("rule_id"), F.col("l_linenumber").alias("pos"), F.lit("PASS").alias("status"), F.lit("MANDATORY").alias("level"), F.lit(None).cast("string").alias("group_id"))
    extras = li.select(F.col("l_orderkey").alias("cert_id"), F.lit("odd").alias("property_key"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "R").alias("is_rejected"))
    judged = items.unionByName(audit.rejected_rows(extras))
    return audit.summary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id")), judged).select("cert_id", "n_items", "n_fail", "verdict")


@query("""SELECT s_suppkey, ['technical_agreement', 'industry_standard', 'enterprise_standard', 'national_standard'][1 + s_nationkey % 4] AS category, 1 + s_nationkey % 4 AS priority FROM supplier""")
def q_standard_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = overlay.priority_of(nth(F.col("s_nationkey"), "TA-1", "NB/T 47019", "Q/ABC 1", "GB/T 1"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", p.alias("p")).select("s_suppkey", "p.category", "p.priority")


@query("""SELECT check_id, line, count(*) AS n FROM (SELECT p_name || ' ' || p_size AS line FROM part), (VALUES ('sevens', '7$'), ('small', '^small')) c(check_id, pattern) WHERE regexp_matches(line, pattern) GROUP BY 1, 2""")
def q_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that break a check."""
    path = stored(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("value")))
    checks = spark.createDataFrame([("sevens", "7$"), ("small", "^small")], "check_id string, pattern string")
    return rule_store.hygiene(spark, path, checks).groupBy("check_id", "line").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), t AS (SELECT *, user_id || '::' || event_type || CASE WHEN k % 2 = 0 THEN '::' || k ELSE '' END AS thread, CASE WHEN k % 10 = 0 THEN 'UNKNOWN_STANDARD' WHEN k % 7 = 0 THEN 'UNKNOWN_GRADE' WHEN k % 5 = 0 THEN 'LOW_CONFIDENCE' END AS gate FROM e)
SELECT thread, gate, CASE WHEN thread IN (SELECT thread FROM t WHERE k % 4 = 0) THEN 'resumed' ELSE 'waits' END AS state, count(*) AS n FROM t WHERE gate IS NOT NULL GROUP BY 1, 2, 3""")
def q_resumed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that gates stopped: those that a correction frees, and those that still wait."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    rows = progressive.event_rows(e.drop("k")).join(e.select("event_id", "k"), "event_id").withColumn("run_id", F.when(F.col("k") % 2 == 0, F.col("k").cast("string")))
    rows = rows.withColumn("thread", progressive.thread_key("session_id", "batch_id", "run_id")).withColumn("gate", progressive.gate())
    freed, waiting = progressive.resume(rows.where("gate is not null"), rows.where("k % 4 = 0").select("thread"))
    state = lambda df, s: df.select("thread", "gate", F.lit(s).alias("state"))
    return state(freed, "resumed").union(state(waiting, "waits")).groupBy("thread", "gate", "state").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey AS thread, l_linenumber || '_' || l_partkey AS property, l_quantity AS value, l_partkey % 3 = 0 AS has, l_partkey % 6 = 0 AS rejected FROM lineitem)
SELECT thread, CASE WHEN has THEN 'new' ELSE 'p' END || property AS property_key, CASE WHEN has AND NOT rejected THEN 1.5 ELSE value END::DOUBLE AS value, has AND rejected AS is_rejected FROM r""")
def q_corrected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the newest correction of each; rejected ones are marked."""
    li = table(spark, sf_dir, "lineitem")
    recs = li.select(F.col("l_orderkey").alias("thread"), F.concat(F.lit("p"), "l_linenumber", F.lit("_"), "l_partkey").alias("property_key"), F.col("l_quantity").cast("double").alias("value"))
    c = li.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("thread"), F.concat(F.lit("p"), "l_linenumber", F.lit("_"), "l_partkey").alias("property_key"), F.concat(F.lit("new"), "l_linenumber", F.lit("_"), "l_partkey").alias("new_key"), F.when(F.col("l_partkey") % 6 != 0, 1.5).alias("value"), (F.col("l_partkey") % 6 == 0).alias("rejected"), F.lit(2).alias("at"))
    old = c.withColumn("new_key", F.lit("old")).withColumn("at", F.lit(1))
    return progressive.corrected(recs, c.union(old)).select("thread", "property_key", "value", "is_rejected")


@query("""WITH f AS (SELECT n_nationkey, n_regionkey, n_name, 'ST_' || n_regionkey || CASE WHEN n_regionkey % 2 = 0 THEN '' ELSE ' x' END AS folder FROM nation)
SELECT s_suppkey AS key_id, folder, 'N' || n_nationkey AS clause_id, CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey END AS parent FROM supplier JOIN f ON n_regionkey = s_nationkey % 7 UNION ALL
SELECT s_suppkey, 'ST_' || (s_nationkey % 7), 'R' || (s_nationkey % 7), NULL FROM supplier WHERE s_nationkey % 7 IN (SELECT n_regionkey FROM nation WHERE n_regionkey % 2 = 0)""")
def q_clause_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of standards asked for by suppliers; a region's folder has a tree or a flat list of its nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.struct(F.concat(F.lit("N"), "n_nationkey").alias("clause_id"), F.col("n_name").alias("title")).alias("c"))
    lists = n.groupBy("r").agg(F.collect_list("c").alias("children"))
    tree = F.to_json(F.array(F.struct(F.concat(F.lit("R"), "r").alias("clause_id"), F.lit("all").alias("title"), "children")))
    odd = F.col("r") % 2 == 1
    files = lists.select(F.concat(F.lit("ST_"), "r", F.when(odd, " x").otherwise("")).alias("folder"), F.when(odd, "clauses.json").otherwise("clauses_tree.json").alias("file"), F.when(odd, F.to_json("children")).otherwise(tree).alias("value"))
    root = stored(files, "folder", "file")
    how = F.col("s_nationkey") % 7
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_id"), F.when(how % 2 == 0, F.concat(F.lit("ST/"), how)).otherwise(F.concat(F.lit("st-"), how, F.lit("X"))).alias("standard_id"))
    return rule_store.clauses_of(rule_store.clause_library(spark, root), asked).select("key_id", "folder", "clause_id", "parent")


@query("""SELECT o_orderkey AS cert_id, o_orderstatus AS verdict, l_linenumber AS pos, l_returnflag AS status, l_quantity AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def q_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines written as reports and read back."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cert_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("value"))
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    rule_store.write_reports(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cert_id"), F.col("o_orderstatus").alias("verdict")), items, path)
    kind = dict(items.dtypes)
    back = rule_store.read_reports(spark, path, f"cert_id long, verdict string, items array<struct<pos:{kind['pos']},status:string,value:double>>")
    return back.select("cert_id", "verdict", F.explode_outer("items").alias("i")).select("cert_id", "verdict", "i.pos", "i.status", "i.value")


@query("""SELECT c_custkey AS task_id, string_agg(x, ',' ORDER BY d, k, i) AS trace FROM (SELECT o_custkey AS c_custkey, o_orderdate AS d, o_orderkey AS k, unnest([0, 1]) AS i, unnest([o_orderstatus, o_orderpriority[1]]) AS x FROM orders) GROUP BY 1""")
def q_trace_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks, their orders as nodes that each hand on two notes."""
    node = F.struct("o_orderdate", "o_orderkey").alias("node_pos")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), node, F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("items"))
    return ledger.traces(s).select("task_id", F.array_join("trace", ",").alias("trace"))


@query("SELECT o_orderkey AS session_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders")
def q_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest_first(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("saved_at")), "saved_at").select("session_id", "position")


@query("""SELECT p_brand AS spec_key, CASE WHEN p_size % 6 = 0 AND p_partkey % 2 = 0 THEN 'other' WHEN p_size % 6 = 0 THEN 'chemical' WHEN p_size % 6 = 1 THEN 'mechanical' WHEN p_size % 6 IN (2, 3, 4) THEN 'process' ELSE 'other' END AS part, count(*) AS n_rules, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS rules FROM part GROUP BY 1, 2""")
def q_rule_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules of their brand, by the part of a slice that they are shown in."""
    category = nth(F.col("p_size"), "chemical", "mechanical", "process", "ndt", "corrosion", "metallographic")
    kind = F.when(F.col("p_partkey") % 2 == 0, "dynamic_expression").otherwise("numeric_range")
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_key"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("rule_id"), category.alias("category"), kind.alias("rule_type"))
    return review.rules_by_part(r).select("spec_key", "part", "n_rules", F.array_join("rule_ids", ",").alias("rules"))
