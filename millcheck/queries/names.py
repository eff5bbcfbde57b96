"""Queries of taught names, usual grades and standards by their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.operators import aliases, lookup, review
from millcheck.plans.mapping import table
from millcheck.queries import query
from millcheck.sources import payloads


@query("""WITH e AS (SELECT event_id, ts, 'NAME' || (user_id % 20) AS key, CASE event_type WHEN 'signup' THEN 'registered' WHEN 'click' THEN 'revoked' WHEN 'view' THEN 'restored' WHEN 'error' THEN 'deleted' ELSE 'registered' END AS status, 'p' || (event_id % 5) AS property FROM events),
l AS (SELECT *, count(*) FILTER (status = 'deleted') OVER w AS life, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS until FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, last_value(CASE WHEN status = 'registered' THEN property END IGNORE NULLS) OVER (PARTITION BY key, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS taught FROM l)
SELECT r.event_id, i.taught IS NOT NULL AS is_learned, coalesce(i.taught, 'name_' || (user_id % 30)) AS property_key, i.taught IS NOT NULL AS is_known
FROM events r LEFT JOIN i ON i.key = 'NAME' || (user_id % 30) AND i.status IN ('registered', 'restored') AND i.taught IS NOT NULL AND r.ts + INTERVAL 6 HOUR >= i.ts AND (i.until IS NULL OR r.ts + INTERVAL 6 HOUR < i.until)""")
def q_aliases_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of records read with what reviewers had taught by then: registered, revoked, restored and deleted all the time."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "revoked").when(F.col("event_type") == "view", "restored").when(F.col("event_type") == "error", "deleted").otherwise("registered")
    taught = e.select("event_id", F.col("ts").cast("timestamp").alias("event_at"), F.concat(F.lit("name "), F.col("user_id") % 20).alias("alias"), status.alias("status"), F.concat(F.lit("p"), F.col("event_id") % 5).alias("property_key"), F.lit("other").alias("category"))
    records = e.select("event_id", F.concat(F.lit("Name "), F.col("user_id") % 30).alias("raw"), (F.col("ts").cast("timestamp") + F.expr("interval 6 hours")).alias("at"))
    return aliases.property_as_of(records, aliases.intervals(taught), "raw", "at").select("event_id", "property.is_learned", "property.property_key", "property.is_known")


def grade_sql() -> str:
    names = ", ".join(f"('{n}', '{primary}', '{code}')" for primary, code, _, all_names in aliases.GRADES for n in all_names.split())
    return f"""WITH g AS (SELECT * FROM (VALUES {names}) v(name, primary_grade, code)), n AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS at FROM g), c AS (SELECT count(*) AS c FROM g),
p AS (SELECT p_partkey, p_size, (p_partkey * 7) % (c + 5) AS k FROM part, c) SELECT p_partkey, coalesce(primary_grade, 'steel ' || k) AS primary_grade, code, CASE WHEN name IS NULL THEN 0.5 ELSE 0.98 END::DOUBLE AS confidence FROM p LEFT JOIN n ON n.at = k"""


@query(grade_sql())
def q_usual_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades under all their usual names, as parts have them: with a standard before, brackets behind, marks inside, in any case."""
    names = sorted(n for *_, all_names in aliases.GRADES for n in all_names.split())
    k, n = (F.col("p_partkey") * 7) % (len(names) + 5), F.col("p_size")
    bare = F.coalesce(F.get(F.array(*map(F.lit, names)), k.cast("int")), F.concat(F.lit("steel "), k.cast("string")))
    known = k < len(names)
    marked = F.when(known & (n % 3 == 1), F.concat(F.substring(bare, 1, 2), F.lit("-"), F.lower(F.substring(bare, 3, 99)))).otherwise(bare)
    said = F.concat(F.when(n % 4 == 0, "ASTM A213/A213M ").when(n % 4 == 1, "GB/T 13296-2023: ").otherwise(""), marked, F.when(n % 5 == 0, " (UNS x)").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", aliases.usual_grade(said).alias("g")).select("p_partkey", "g.primary_grade", F.col("g.unified_code").alias("code"), "g.confidence")


@query("""WITH s AS (SELECT s_suppkey, 'ST/T ' || s_suppkey AS id, 'alias ' || (s_suppkey * 7) AS alias FROM supplier), a AS (SELECT c_custkey, 1 + c_nationkey AS k, c_custkey % 4 AS how FROM customer),
h AS (SELECT c_custkey, how, k, (SELECT min('ST/T ' || s_suppkey) FROM s WHERE 'STT' || s_suppkey = 'STT' || k) AS by_id, (SELECT min(id) FROM s WHERE replace(upper(alias), ' ', '') = 'ALIAS' || k) AS by_alias FROM a)
SELECT c_custkey AS key_id, CASE how WHEN 0 THEN by_id WHEN 1 THEN by_alias WHEN 2 THEN by_id END AS standard_id FROM h""")
def q_standard_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards asked for by id, by alias, with dots inside, and with one that is not there."""
    catalogue = table(spark, sf_dir, "supplier").select(F.concat(F.lit("ST/T "), "s_suppkey").alias("standard_id"), F.array(F.concat(F.lit("alias "), F.col("s_suppkey") * 7)).alias("aliases"))
    k, how = (F.col("c_nationkey") + 1).cast("string"), F.col("c_custkey") % 4
    raw = F.when(how == 0, F.concat(F.lit("st_t "), k)).when(how == 1, F.concat(F.lit("ALIAS-"), k)).when(how == 2, F.concat(F.lit("S.T/T."), k)).otherwise(F.concat(F.lit("ST/T "), k, F.lit("; nowhere")))
    return lookup.resolve_standards(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), raw.alias("raw")), catalogue).select("key_id", F.col("standard_ids")[0].alias("standard_id"))


@query("""WITH p AS (SELECT p_partkey AS payload_id, p_size, p_partkey % 4 AS how FROM part)
SELECT payload_id, 'tensile_strength' AS property_key, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE * 9.80665::DOUBLE ELSE p_size::DOUBLE END AS value, 'MPa' AS unit, NULL AS text, NULL AS level, CASE WHEN p_size % 2 = 0 THEN 'kgf/mm2' END AS from_unit FROM p
UNION ALL SELECT payload_id, 'C', p_size::DOUBLE / 8, '%', NULL, NULL, NULL FROM p
UNION ALL SELECT payload_id, 'ultrasonic_test', CASE WHEN p_size % 4 IN (0, 3) THEN 2 END::DOUBLE, NULL, CASE p_size % 4 WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT_TESTED' ELSE 'PASS' END, CASE p_size % 4 WHEN 0 THEN 'U2' WHEN 3 THEN 'E2H' END, NULL FROM p""")
def q_payload_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as payloads of four shapes: records in a list, plain or as objects with a value, and results by name, with or
    without a list of boxes beside."""
    n = F.col("p_size")
    unit, strength, carbon = F.when(n % 2 == 0, "kgf/mm2"), n.cast("string"), (n.cast("double") / 8).cast("decimal(10,3)").cast("string")
    said = F.when(n % 4 == 0, "PASS (U2 等级)").when(n % 4 == 1, "不合格").when(n % 4 == 2, "").otherwise("E2H")
    none = F.lit(None).cast("string")
    results = (("抗拉强度", strength, unit), ("C", carbon, none), ("UT", said, none))
    plain = F.array(*(F.struct(F.lit(name).alias("raw_property_name"), raw.alias("raw_value"), u.alias("raw_unit")) for name, raw, u in results))
    boxed = F.array(*(F.struct(F.struct(F.lit(name).alias("value"), F.array(F.lit(1), F.lit(2)).alias("box")).alias("raw_property_name"), F.struct(raw.alias("value")).alias("raw_value"), F.struct(u.alias("value")).alias("raw_unit")) for name, raw, u in results))
    by_name = F.struct(*(F.struct(raw.alias("value"), u.alias("unit")).alias(name) for name, raw, u in results))
    raw_by_name = F.struct(*(F.struct(raw.alias("raw_value"), u.alias("raw_unit"), F.array(F.lit(0)).alias("box")).alias(name) for name, raw, u in results))
    how = F.col("p_partkey") % 4
    body = F.when(how == 0, F.to_json(F.struct(plain.alias("test_records")))).when(how == 1, F.to_json(F.struct(boxed.alias("test_records")))).when(how == 2, F.to_json(F.struct(by_name.alias("test_records")))).otherwise(F.to_json(F.struct(raw_by_name.alias("test_records"))))
    return payloads.records(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), body.alias("body"))).select("payload_id", "property_key", "value", "unit", "text", "level", "from_unit")


@query("""WITH d AS (SELECT c_custkey AS seq, c_custkey // 3 AS g, (c_custkey % 2)::INT AS richness, CASE c_custkey % 3 WHEN 1 THEN c_name WHEN 2 THEN ' ' END AS note, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey END AS nation FROM customer)
SELECT max(n) AS seq, max(CASE WHEN n = 1 THEN 0 END) AS x, arg_max(note, richness * 1000000000 + s) FILTER (trim(note) <> '') AS note, arg_max(nation, richness * 1000000000 + s) FILTER (nation IS NOT NULL) AS nation, count(*) AS n_merged FROM (SELECT *, seq AS s, first_value(seq) OVER (PARTITION BY g ORDER BY richness DESC, seq DESC) AS n FROM d) GROUP BY g""".replace("max(CASE WHEN n = 1 THEN 0 END) AS x, ", ""))
def q_merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, three of which are one by a file name or a digest; what the richest lacks comes from the others."""
    k = F.col("c_custkey")
    third = F.floor(k / 3).cast("string")
    note = F.when(k % 3 == 1, F.col("c_name")).when(k % 3 == 2, " ")
    d = table(spark, sf_dir, "customer").select(
        k.alias("seq"), F.lit(None).cast("string").alias("doc_id"), F.when(k % 3 < 2, F.concat(F.lit("m"), third)).alias("md5"), F.when(k % 3 > 0, F.concat(F.lit("f"), third)).alias("filename"), (k % 2).cast("int").alias("richness"), note.alias("note"), F.when(k % 3 == 2, F.col("c_nationkey")).alias("nation")
    )
    return review.merged_documents(d).select("seq", "note", "nation", "n_merged")
