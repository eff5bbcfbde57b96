"""Queries of the scalar layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.functions import keys, rounding, text, units, verdicts
from millcheck.functions.formula import compile_formula
from millcheck.plans.mapping import table
from millcheck.queries import query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DEC = "cast(cast({} as varchar) as decimal(38,10))"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  cast(round_even({DEC.format('l_extendedprice')}, 1) as double) AS r1, cast(round_even({DEC.format('l_extendedprice')}, 0) as double) AS r0
FROM lineitem""")
def q_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*LINE, p, rounding.half_even(p, 1).alias("r1"), rounding.half_even(p, 0).alias("r0"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {DEC.format('l_discount')} <= 0.05 AS ok,
  cast({DEC.format('l_discount')} - 0.05 as double) AS deviation, l_quantity >= 10 AS enough, 10 - l_quantity AS short_by FROM lineitem""")
def q_limit_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, deviation = rounding.compare(F.col("l_discount"), F.lit(0.05), "<=")
    enough, short = rounding.compare(F.col("l_quantity"), F.lit(10.0), ">=")
    return table(spark, sf_dir, "lineitem").select(*LINE, ok.alias("ok"), deviation.alias("deviation"), enough.alias("enough"), short.alias("short_by"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS p, l_tax AS t, l_discount AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 5 * (q + 2) - greatest(q, 10) AS a, p / nullif(q - 1, 0) AS b, CASE WHEN d - 0.05::DOUBLE >= 0 THEN sqrt(d - 0.05::DOUBLE) END AS c FROM f""")
def q_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount"}
    made = lambda t: compile_formula(t, lambda n: F.col(column[n]))
    return table(spark, sf_dir, "lineitem").select(*LINE, made("5 * (q + 2) - max(q, 10)").alias("a"), made("p / (q - 1)").alias("b"), made("sqrt(d - 0.05)").alias("c"))


@query(r"""SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex(text, '[、,;，；\n]+'), lambda x: regexp_replace(x, '^[\s　\x{A0}]+|[\s　\x{A0}]+$', '', 'g')), lambda x: x <> ''),
 lambda x: regexp_replace(x, '^([A-Za-z]+(?:/[A-Za-z]+)?)[\s　\x{A0}]*([A-Za-z]?[0-9].*)$', '\1 \2')))) AS names, upper(regexp_replace(source, '[\s\-_/\\]', '', 'g')) AS source_key FROM documents""")
def q_parse_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_sort(text.standards(F.col("text"))).alias("names"), text.standard_key(F.col("source")).alias("source_key"))


@query("""SELECT p_partkey, upper(regexp_replace(p_brand, '[\\s\\-_/\\\\]', '', 'g')) AS brand_key, upper(regexp_replace(p_brand, '[\\s\\-_/\\\\]', '', 'g')) = 'BRAND#11' AS same FROM part""")
def q_std_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = text.same_standards(F.array("p_brand", "p_brand"), F.array(F.lit("brand_#11")))
    return table(spark, sf_dir, "part").select("p_partkey", text.standard_key(F.col("p_brand")).alias("brand_key"), same.alias("same"))


#: Like text.NUMBER for an engine without look-behind: the number is the last group.
NUMBER_SQL = "(^|[^A-Za-z0-9.+-])([-+]?[0-9]+(?:\\.[0-9]+)?)"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[:：=]\\s*[-+]?[0-9]')) AS n_segments, len(regexp_extract_all(text, '[:：=]\\s*[-+]?[0-9]')) >= 2 AS packaged,
 CASE WHEN len(regexp_extract_all(text, '[:：=]\\s*[-+]?[0-9]')) < 2 THEN try_cast(nullif(regexp_extract(text, '(?:^|[^A-Za-z0-9.])([-+]?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS double) END AS measured FROM documents""")
def q_measured_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.segments(t).cast("long").alias("n_segments"), text.packaged(t).alias("packaged"), text.measured(t).alias("measured"))


@query("""WITH h AS (SELECT p_partkey, list_transform(regexp_extract_all('HRB 8' || p_size || '; HV10 1' || p_size || '.5', ' ([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: cast(x as double)) AS v FROM part)
SELECT p_partkey, v AS numbers, floor(list_sum(v) / len(v) * 10 + 0.5) / 10 AS mean FROM h""")
def q_hardness_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("HRB 8"), F.col("p_size"), F.lit("; HV10 1"), F.col("p_size"), F.lit(".5"))
    return table(spark, sf_dir, "part").select("p_partkey", text.hardness_values(t).alias("numbers"), text.hardness_mean(t).alias("mean"))


@query("""SELECT p_partkey, round(p_retailprice * CASE p_size % 5 WHEN 0 THEN 9.80665 WHEN 1 THEN 0.006894757293168361 WHEN 2 THEN 6.894757293168361 ELSE 1 END, 6) AS mpa,
 round(p_size * CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 1000 WHEN 2 THEN 25.4 ELSE 1 END, 6)::DOUBLE AS mm FROM part""")
def q_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.element_at(F.array(*map(F.lit, ("kgf/mm2", "psi", "ksi", "MPa", None))), F.col("p_size") % 5 + 1)
    length = F.element_at(F.array(*map(F.lit, ("cm", "m", "inch", "mm"))), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(units.to_mpa(F.col("p_retailprice"), strength), 6).alias("mpa"), F.round(units.to_mm(F.col("p_size").cast("double"), length), 6).alias("mm"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<=' WHEN 1 THEN '>' END AS op, cast(p_size as double) / 4 AS number, 'MPa' AS unit FROM part""")
def q_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("p_size") % 3 == 0, "<= ").when(F.col("p_size") % 3 == 1, "> ").otherwise(""), (F.col("p_size") / 4).cast("decimal(8,2)").cast("string"), F.lit(" MPa"))
    return table(spark, sf_dir, "part").select("p_partkey", text.quantity(t).alias("q")).select("p_partkey", "q.op", "q.number", "q.unit")


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x0b\x{3000}\x{a0}]+|[\s\x0b\x{3000}\x{a0}]+$', '', 'g') AS t FROM documents UNION ALL SELECT -1 - p_partkey, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE coalesce(split_part(p_type, ' ', 1), '') END || CASE p_size % 5 WHEN 0 THEN '' ELSE ' E' || p_size % 6 || CASE p_size % 3 WHEN 0 THEN 'H' WHEN 1 THEN '法' ELSE '' END END FROM part),
d AS (SELECT doc_id, regexp_replace(t, '^[\s\x0b\x{3000}\x{a0}]+|[\s\x0b\x{3000}\x{a0}]+$', '', 'g') AS t FROM c), l AS (SELECT *, upper(regexp_extract(t, '(?:^|[\s\x0b\x{3000}\x{a0}(（,，])(E[1-4]H?|U[1-4]|METHOD_[A-E]|[A-E]法)(?:$|[\s\x0b\x{3000}\x{a0})）,，\x{4e00}-\x{9fa5}])', 1, 'i')) AS found FROM d)
SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '未做|未测|免做|免检') OR regexp_matches(t, '^[-/\\_]+$') OR upper(t) IN ('N/A', 'NA', 'NONE') THEN 'NOT_TESTED' WHEN upper(t) IN ('FAIL', 'NG', 'NO') OR regexp_matches(upper(t), '不合格|不符合|开裂|超标|有裂纹|超差|REJECT|CRACKS_FOUND') THEN 'FAIL' ELSE 'PASS' END AS result,
 CASE found WHEN '' THEN NULL WHEN 'E法' THEN 'Method_E' WHEN 'A法' THEN 'Method_A' ELSE found END AS level FROM l""")
def q_qualitative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of long texts, and of cells made of parts' types and sizes, some of them empty."""
    k, n = F.col("p_size") % 7, F.col("p_size")
    start = F.when(k == 0, "").when(k == 1, " ").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1)))
    mark = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(" E"), (n % 6).cast("string"), F.when(n % 3 == 0, "H").when(n % 3 == 1, "法").otherwise("")))
    cells = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.concat(start, mark).alias("text"))
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(cells).select("doc_id", text.result(t).alias("result"), text.level(t).alias("level"))


def key_sql(k: str) -> str:
    """The key cascade as SQL, from the same list."""
    arms = [f"WHEN {k} IN ({', '.join(repr(s) for s in keys.SYMBOLS)}) THEN upper(substr({k}, 1, 1)) || lower(substr({k}, 2))"]
    arms += [f"WHEN {k} = '{e}' THEN '{s[0] + s[1:].lower()}'" for e, s in keys.ELEMENTS.items()]
    for start, has, without, whole, name, _, _ in keys.TESTS:
        tests = [f"contains({k}, '{h}')" for h in has]
        test = f"({' OR '.join(tests)})" + "".join(f" AND NOT contains({k}, '{w}')" for w in without)
        if start:
            test = f"({test} OR regexp_matches({k}, '^({start})'))"
        if whole:
            test = f"({test} OR {k} IN ({', '.join(repr(w) for w in whole)}))"
        arms.append(f"WHEN {test} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE regexp_replace(lower(trim(name)), '[\\s\\-]+', '_', 'g') END"


@query(f"""WITH w AS (SELECT DISTINCT name FROM (SELECT unnest(string_split_regex(text, '[\\s.,]+')) AS name FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT event_type FROM events) WHERE name <> ''),
k AS (SELECT name, regexp_replace(upper(regexp_replace(name, '(?i)^(geo|proc|ndt|mech|metallo|chem)_', '')), '[\\s\\-_/():（）\\[\\]　]', '', 'g') AS k FROM w)
SELECT name, {key_sql('k')} AS property_key FROM k""")
def q_property_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[\s.,]+")).alias("name")).union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "events").select("event_type"))
    return names.where("name <> ''").distinct().select("name", keys.canonical(F.col("name"))["property_key"].alias("property_key"))


@query("""SELECT p_partkey, (p_size + 0.5)::DOUBLE AS outer_mm, CASE WHEN p_size % 2 = 0 THEN 2.0 END::DOUBLE AS wall_mm, CASE WHEN p_size % 2 = 0 THEN 6000.0 END::DOUBLE AS length_mm, CASE WHEN p_size % 4 = 0 THEN 'min_wall' END AS delivery FROM part""")
def q_dimension_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lit("Φ"), (F.col("p_size") + 0.5).cast("decimal(6,1)").cast("string"), F.when(F.col("p_size") % 2 == 0, "×2.0×6000mm").otherwise(""), F.when(F.col("p_size") % 4 == 0, " 最小壁厚").otherwise(""))
    d = table(spark, sf_dir, "part").select("p_partkey", text.dimensions(size).alias("d"))
    return d.select("p_partkey", F.col("d.outer").alias("outer_mm"), F.col("d.wall").alias("wall_mm"), F.col("d.length").alias("length_mm"), F.col("d.delivery").alias("delivery"))


@query("""SELECT o_orderkey, greatest(50, least(99, base + CASE WHEN boxes > 0 THEN floor(least(1.0, boxes / (n + 9)) * 25 + 0.5) ELSE floor(base / 75 * 25 + 0.5) END))::BIGINT AS confidence FROM (
 SELECT o_orderkey, n, boxes, 6 + CASE WHEN o_orderstatus <> 'P' THEN 8 ELSE 0 END + 8 + CASE WHEN o_totalprice > 50000 THEN 4 ELSE 0 END + 4 + least(3 * n, 25) + 6 + CASE WHEN o_custkey % 2 = 0 THEN 6 ELSE 0 END + 4 + CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 0 END AS base
 FROM (SELECT *, (o_orderkey % 12)::DOUBLE AS n, (o_custkey % 20)::DOUBLE AS boxes FROM orders))""")
def q_ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("n", (F.col("o_orderkey") % 12).cast("double")).withColumn("boxes", (F.col("o_custkey") % 20).cast("double"))
    yes = F.lit(True)
    header = {"certificate": yes, "batch": F.col("o_orderstatus") != "P", "grade": yes, "supplier": F.col("o_totalprice") > 50000, "standard": yes}
    c = verdicts.ocr_confidence(header, F.col("n"), {"tensile": yes, "yield": F.col("o_custkey") % 2 == 0, "elongation": yes}, F.col("o_custkey") % 3 == 0, F.col("n"), F.col("boxes"))
    return o.select("o_orderkey", c.alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN system = 'UNAUDITED' THEN 'PENDING_AUDIT' WHEN system = 'MANUAL_REVIEW' THEN 'PENDING_REVIEW' WHEN system = 'PASS' THEN CASE coalesce(human, '-') WHEN '-' THEN 'RELEASE' WHEN 'REJECT' THEN 'REJECTED_BY_HUMAN' ELSE 'RELEASE_VERIFIED' END
 WHEN human IN ('PASS', 'WAIVED') THEN 'CONCESSION_RELEASE' ELSE 'REJECTED_BY_SYSTEM' END AS disposition, (system = 'PASS' AND coalesce(human, '-') <> 'REJECT') OR (system = 'FAIL' AND coalesce(human, '-') IN ('PASS', 'WAIVED')) AS release FROM (
 SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'MANUAL_REVIEW' ELSE 'UNAUDITED' END AS system, CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'WAIVED' END AS human FROM orders)""")
def q_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 4 + 1).cast("int"))
    d = verdicts.disposition(pick("o_custkey", "PASS", "FAIL", "MANUAL_REVIEW", "UNAUDITED"), pick("o_orderkey", "PASS", "REJECT", "WAIVED", None))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.disposition", "d.release")


@query("""WITH v AS (SELECT l_orderkey, list(l_quantity) AS v FROM lineitem GROUP BY l_orderkey), c AS (SELECT l_orderkey, list_sort(list_transform(v, lambda x: {'d': least(x - 5, 45 - x), 'v': x}))[1].v AS pair, list_min(v) AS low FROM v)
SELECT l_orderkey, pair AS two_sided, least(pair - 5, 45 - pair) AS margin, low AS one_sided, low - 5 AS low_margin FROM c""")
def q_critical_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    both = verdicts.critical_value(F.col("v"), F.lit(5.0), F.lit(45.0))
    one = verdicts.critical_value(F.col("v"), F.lit(5.0), F.lit(None).cast("double"))
    return v.select("l_orderkey", both.alias("b"), one.alias("o")).select("l_orderkey", F.col("b.value").alias("two_sided"), F.col("b.margin").alias("margin"), F.col("o.value").alias("one_sided"), F.col("o.margin").alias("low_margin"))


@query("""SELECT page_id, md5(html) AS fingerprint, regexp_matches(lower(regexp_extract(url, '(\\.[^.]+)$', 1)), '^\\.(pdf|png|jpg|jpeg|bmp)$') AS admitted FROM pages""")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millcheck.operators.ledger import admitted

    return table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("fingerprint"), admitted(F.col("url")).alias("admitted"))
