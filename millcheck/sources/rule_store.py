"""Readers and writers: rule catalogues, clauses, batches, ledgers, logs and document caches.

All files are read by Spark with stated schemas, so any store that Spark reads will do. Open fields are kept as JSON
text or maps; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.functions.keys import SYMBOLS
from millcheck.functions.text import json_body, standard_key
from millcheck.operators.audit import small
from millcheck.operators.lineage import cut

ATOMIC = (
    "rule_id string, clause_ref string, conformance_level string, selection struct<category:string,data_element_id:string>, applicability array<struct<field:string,operator:string,value:string>>, "
    "requirement struct<operator:string,value:string,unit:string,formula:string,description:string,rounding_decimals:int>, group struct<id:string,op:string,semantic_code:string,name:string,min_pass:int>"
)
SLICE = "spec_key string, primary_grade string, unified_code string, structure_type string, display_name string, aliases array<string>, evaluation_rules string"
LOG = "timestamp string, level string, tag string, message string, duration_ms double, metadata string"
CACHE = "md5 string, filename string, fileSize long, parserConfigVersion string, model string, provider string, parsedAt string, cacheLevel string, sessionDocument string"


def json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def standard_of(path: Column) -> Column:
    """The folder that a rule file lies in names its standard; index and slice folders do not count."""
    return F.regexp_extract(path, r"/([^/]+)/(?:indices/|slices/)?[^/]+$", 1)


def atomic_rules(spark: SparkSession, path: str) -> DataFrame:
    """Atomic rules of files like <standard>/rules.json, with standard_id and pos, their order in the file."""
    text = spark.read.option("wholetext", True).text(path).select(standard_of(F.col("_metadata.file_path")).alias("standard_id"), F.from_json("value", f"array<struct<{ATOMIC.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>").alias("rules"))
    return text.select("standard_id", F.posexplode("rules").alias("pos", "rule")).select("standard_id", "pos", "rule.*")


def grade_index(spark: SparkSession, path: str) -> DataFrame:
    """standard_id, spec_key, rule_id of files that map a grade to its rules."""
    text = spark.read.option("wholetext", True).text(path).select(standard_of(F.col("_metadata.file_path")).alias("standard_id"), F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select("standard_id", F.explode("m").alias("spec_key", "ids")).select("standard_id", "spec_key", F.explode("ids").alias("rule_id"))


def slices_of(rules: DataFrame, index: DataFrame) -> DataFrame:
    """Rules by slice: ids of the index that no rule has are dropped."""
    return index.join(rules, ["standard_id", "rule_id"])


def legacy_slices(spark: SparkSession, path: str) -> DataFrame:
    """Slice files, one object each, with standard_id; the rules stay JSON text."""
    return spark.read.schema(SLICE).option("multiLine", True).json(path).withColumn("standard_id", standard_of(F.col("_metadata.file_path")))


def modular_first(modular: DataFrame, monolithic: DataFrame) -> DataFrame:
    """Both kinds of standards, where a standard in one file gives way to one in a folder; alias and test files are no
    standards."""
    file = F.lower(F.regexp_extract("file", r"([^/]+)$", 1))
    rest = monolithic.where(~F.contains(file, F.lit("alias")) & ~F.startswith(file, F.lit("test_"))).join(modular.select("standard_id").distinct(), "standard_id", "left_anti")
    return modular.unionByName(rest.drop("file"), allowMissingColumns=True)


def standard_meta(raw: DataFrame) -> DataFrame:
    """Standards with their older column names folded in."""
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    status = F.coalesce(c("status"), F.lit("CURRENT"))
    return raw.select(F.coalesce(c("standard_id"), c("standard_code")).alias("standard_id"), F.coalesce(c("standard_name"), c("title")).alias("standard_name"), F.when(status == "ACTIVE", "CURRENT").otherwise(status).alias("status"))


# Data elements and the properties they are.
ELEMENTS = {
    "mech.tensile_strength.Rm": "tensile_strength", "mech.yield_strength.Rp02": "yield_strength_rp02", "mech.elongation.A": "elongation_A", "mech.hardness.HBW": "hardness", "mech.hardness.HRB": "hardness", "mech.hardness.HV": "hardness",
    "test.flattening": "flattening_test", "test.flaring": "flaring_test", "test.bending": "bending_test", "test.hydrostatic": "hydraulic_test", "test.eddy_current": "eddy_current_test", "test.pressure_tightness": "pressure_tightness",
    "test.ultrasonic": "ultrasonic_test", "test.intergranular_corrosion": "intergranular_corrosion", "test.grain_size": "grain_size", "test.surface_quality": "surface_quality", "process.surface_roughness": "surface_roughness",
}
FIELDS = {"wall_thickness": "ctx.header.dimensions.wall_thickness_mm", "outer_diameter": "ctx.header.dimensions.outer_diameter_mm", "manufacturing_process": "ctx.header.manufacturing_process", "material_form": "ctx.header.material_form"}


def evaluation_rules(rules: DataFrame) -> DataFrame:
    """Atomic rules as rows that the audit plan reads (plans.audit.SCHEMA, and standard_id)."""
    element = F.coalesce("selection.data_element_id", "rule_id")
    known = F.create_map(*(F.lit(x) for kv in ELEMENTS.items() for x in kv))
    key = F.when(F.startswith(element, F.lit("chem.element.")), F.substring_index(element, ".", -1)).otherwise(F.coalesce(F.try_element_at(known, element), element))
    value, op = F.col("requirement.value"), F.col("requirement.operator")
    number = value.try_cast("double")
    pair = F.from_json(value, "array<double>")
    between = op == "between"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    industry = F.contains(text("standard_id"), F.lit("NB")) | F.contains("rule_id", F.lit("NB")) | F.contains(text("requirement.description"), F.lit("NB/T")) | F.contains(text("clause_ref"), F.lit("NB"))
    formula = F.regexp_replace("requirement.formula", r"chem\.element\.([A-Za-z0-9]+)", "ctx.chemical.$1")
    exempt = F.col("rule_id").endswith("_EXEMPT") | F.contains(text("requirement.description"), F.lit("豁免"))
    category = F.when(F.startswith(element, F.lit("chem.")) | F.upper(key).isin(SYMBOLS), "chemical").otherwise(F.coalesce("selection.category", F.lit("other")))
    kind = (
        F.when(element == "test.pressure_tightness", "alternative_group").when(exempt, "exemption").when(F.col("requirement.formula").isNotNull(), "dynamic_expression").when(op.isin("==", "in", "contains"), "qualitative_enum").otherwise("numeric_range")
    )
    field = lambda a: F.try_element_at(F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv)), F.substring_index(a["field"], ".", -1))
    literal = lambda a: F.when(F.contains(field(a), F.lit("dimensions")), a["value"]).otherwise(F.concat(F.lit("'"), a["value"], F.lit("'")))
    terms = F.filter(F.transform("applicability", lambda a: F.concat_ws(" ", F.when(field(a).isNotNull(), field(a)), F.when(field(a).isNotNull(), a["operator"]), F.when(field(a).isNotNull(), literal(a)))), lambda t: t != "")
    trigger = F.nullif(F.array_join(terms, " && "), F.lit(""))
    strength = industry & (category == "mechanical") & key.isin("tensile_strength", "yield_strength_rp02")
    none = F.lit(None).cast("double")
    option = lambda k, lvl: F.struct(F.lit(k).alias("key"), lvl.alias("required_level"), none.alias("lo"), none.alias("hi"), F.lit(None).cast("int").alias("decimals"))
    options = F.when(kind == "alternative_group", F.array(option("hydraulic_test", F.lit(None).cast("string")), option("eddy_current_test", F.when(industry, "E2H").otherwise("E3H"))))
    return rules.select(
        "standard_id", F.col("spec_key") if "spec_key" in rules.columns else F.lit(None).cast("string").alias("spec_key"), "rule_id", F.col("pos").cast("int").alias("pos"), kind.alias("rule_type"), category.alias("category"), key.alias("property_key"),
        F.when(F.startswith(element, F.lit("mech.hardness.")), F.substring_index(element, ".", -1)).alias("sub_property"), F.when(exempt, "EXEMPT").when(F.col("conformance_level") == "OPTIONAL", "OPTIONAL_AGREED").otherwise("MANDATORY").alias("level"), trigger.alias("trigger"),
        F.when(op.isin(">=", ">"), number).when(between, pair[0]).alias("lo"), F.when(op.isin("<=", "<"), number).when(between, pair[1]).when(F.col("requirement.formula").isNotNull(), number).alias("hi"),
        F.coalesce("requirement.rounding_decimals", F.when(strength, 0)).alias("decimals"), F.when(op == ">", False).otherwise(True).alias("lo_inclusive"), F.when(op == "<", False).otherwise(True).alias("hi_inclusive"),
        formula.alias("formula_lo"), F.lit(None).cast("string").alias("formula_hi"), F.when(op == "==", value).alias("required_level"), none.alias("least_level"), options.alias("options"),
        F.col("group.id").alias("group_id"), F.col("group.op").alias("group_op"), F.coalesce("group.min_pass", F.when(F.col("group.op") == "OR", 1)).alias("min_pass"),
    )


NODE = "clause_id:string,title:string,text:string,children:string"


def flattened(level: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (n, a struct of NODE, with parent, pos and the columns to keep) and all that is below them. Children are kept as JSON
    text a level at a time, each written out, until none has any."""
    out = None
    while True:
        rows = cut(level.select(*keep, "parent", "pos", "n.*"))
        if out is not None and rows.isEmpty():
            return out
        flat = rows.drop("children")
        out = flat if out is None else out.unionByName(flat)
        level = rows.where("children is not null and children <> '[]'").select(*keep, F.col("clause_id").alias("parent"), F.posexplode(F.from_json("children", f"array<struct<{NODE}>>")).alias("pos", "n"))


def clauses(spark: SparkSession, path: str) -> DataFrame:
    """Clause trees of files as nodes: clause_id, parent, title, text, pos."""
    return flattened(spark.read.option("wholetext", True).text(path).select(F.lit(None).cast("string").alias("parent"), F.posexplode(F.from_json("value", f"array<struct<{NODE}>>")).alias("pos", "n")))


def clause_library(spark: SparkSession, root: str) -> DataFrame:
    """folder and the clauses of each folder of standards: of its tree (clauses_tree.json), or where that is not there or cannot
    be read of its list (clauses.json)."""
    # a file, or a folder of that name as Spark writes one, in a folder that names its standard, plainly or as a partition
    part = lambda i: F.regexp_extract(F.try_url_decode(F.col("_metadata.file_path")), r"/(?:folder=)?([^/]+)/(?:file=)?(clauses_tree\.json|clauses\.json)(?:/[^/]*)?$", i)
    files = spark.read.option("wholetext", True).text(f"{root}/*/*clauses*.json").select(part(1).alias("folder"), part(2).alias("file"), "value")
    listed = F.from_json("value", f"array<struct<{NODE}>>")
    read = files.where(F.col("file").isin("clauses_tree.json", "clauses.json")).withColumn("nodes", listed).where("nodes is not null")
    used = read.groupBy("folder").agg(F.max_by(F.struct("file", "nodes"), (F.col("file") == "clauses_tree.json").cast("int")).alias("f"))
    tops = used.select("folder", F.lit(None).cast("string").alias("parent"), F.posexplode("f.nodes").alias("pos", "n"), F.col("f.file").alias("file"))
    deep = flattened(tops.where("file = 'clauses_tree.json'").drop("file"), ("folder",))
    return deep.unionByName(tops.where("file = 'clauses.json'").select("folder", "parent", "pos", "n.*").drop("children"))


def clauses_of(library: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key_id, standard_id) with the clauses of its standard: of the folder that has its name, else of the first by name
    that has its fingerprint; standards without clauses have no row."""
    folders = library.select("folder").distinct().withColumn("k_", standard_key(F.col("folder")))
    x = asked.select("key_id", "standard_id", standard_key(F.col("standard_id")).alias("k_"), F.regexp_replace("standard_id", r"[/\-]", "_").alias("direct_"))
    rank = F.struct((F.col("folder") != F.col("direct_")).cast("int"), "folder")
    best = x.join(small(folders), "k_").groupBy("key_id", "standard_id").agg(F.min_by("folder", rank).alias("folder"))
    return best.join(library, "folder")


def write_reports(certs: DataFrame, items: DataFrame, path: str) -> None:
    """Reports as JSON, one line per certificate: its columns and its items, in order (items: cert_id, pos, and more)."""
    each = items.groupBy("cert_id").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in items.columns if c not in ("cert_id", "pos"))))).alias("items"))
    certs.join(each, "cert_id", "left").select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports that write_reports wrote, by their schema."""
    return json(spark, path, schema, lines=True)


def answers(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Extractors' answers (JSON, perhaps in a code fence) parsed by a schema; what does not parse is all null."""
    return texts.withColumn("parsed", F.from_json(json_body(F.col(column)), schema, {"mode": "PERMISSIVE"}))


def write_ledger(sessions: DataFrame, path: str, pages: str = "pages") -> None:
    """Sessions as Parquet by day of saving. Embedded page images become pointers to session and page."""
    images = F.transform(pages, lambda p, i: F.when(F.startswith(p, F.lit("data:image")), F.concat_ws("/", F.lit("asset:"), F.col("session_id").cast("string"), i.cast("string"))).otherwise(p))
    sessions.withColumn(pages, images).withColumn("day", F.to_date("saved_at")).write.mode("append").partitionBy("day").parquet(path)


def read_ledger(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Sessions of a ledger, all or those saved from one day to another, of which only these days' files are read."""
    x = spark.read.parquet(path)
    return x.where(F.col("day").between(*days)) if days else x


def without_sessions(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """The ledger without the sessions of gone (session_id)."""
    return ledger.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log events of JSON lines, as a table or a stream, with ts."""
    reader = (spark.readStream if stream else spark.read).schema(LOG)
    return reader.json(path).withColumn("ts", F.try_to_timestamp("timestamp"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The parse cache: JSON objects, one per md5."""
    return json(spark, path, CACHE)


def put_cache(entries: DataFrame, old: DataFrame) -> DataFrame:
    """The cache with entries in place of older ones of the same md5 and version."""
    return entries.unionByName(old.join(entries.select("md5", "parserConfigVersion"), ["md5", "parserConfigVersion"], "left_anti"))


def missing_from_cache(files: DataFrame, valid: DataFrame) -> DataFrame:
    """Files whose content has no valid cache row."""
    return files.join(valid.select("md5").distinct(), "md5", "left_anti")


def overview(slices: DataFrame) -> DataFrame:
    """Slices and rules per standard."""
    return slices.groupBy("standard_id").agg(F.countDistinct("spec_key").alias("n_slices"), F.countDistinct("rule_id").alias("n_rules"))


def validate(rules: DataFrame) -> DataFrame:
    """What is wrong with a catalogue: standard_id, problem, rule_id."""
    repeated = rules.groupBy("standard_id", "rule_id").count().where("count > 1").select("standard_id", F.lit("repeated id").alias("problem"), "rule_id")
    bare = rules.where("rule_id is null or selection.data_element_id is null or requirement.operator is null").select("standard_id", F.lit("missing field").alias("problem"), "rule_id")
    return repeated.union(bare)


def hygiene(spark: SparkSession, path: str, checks: DataFrame) -> DataFrame:
    """Lines of text files that break a check (check_id, pattern): file, check_id, line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.join(small(checks), F.expr("line rlike pattern")).select("file", "check_id", "line")
