"""One query per corpus operator, over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millcheck.llm import bloom_lm, decontaminate, hamerly, html_extract, importance, line_dedup, mixing, quality_rules, secrets, simhash, substring_dedup, token_align, warc
from millcheck.llm.common import scratch, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    warc.write(pages, path)
    warc.export(spark, path, f"{path}/files")
    return warc.read_back(spark, f"{path}/files", pages.schema["page_id"].dataType.simpleString()).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.judged(table(spark, sf_dir, "documents"), "base-1", "web-3")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits", "only_rule", "n_only")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deletions(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamerly.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html), h AS (SELECT html, sha1(html) AS h FROM (SELECT DISTINCT html FROM p)),
b AS (SELECT html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // d) % 32 + 1, 1), '' ORDER BY i, d DESC) AS digest FROM (SELECT html, i, ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT AS v FROM h, (SELECT unnest(range(8)) AS i)), (SELECT unnest([32768, 1024, 32, 1]) AS d) GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified FROM p JOIN f USING (html) JOIN b USING (html)"""

OP3 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS ws FROM documents), w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)), c AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1), (SELECT unnest(range(3)) AS k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{{2022}}]')) AS bullets, count(*) FILTER (regexp_matches(line, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$')) AS cuts FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r), u AS (SELECT r, count(*) FILTER (w = upper(w) AND w <> lower(w)) AS n_upper, count(*) FILTER (regexp_matches(w, '\p{{L}}')) AS n_alpha, sum(length(w)) AS chars FROM w GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_upper, 0) AS n_upper_words, length(t) - length(replace(t, '!', '')) AS n_marks, coalesce(n_alpha, 0) AS n_alpha_words, coalesce(bullets, 0) AS n_bullet_lines, coalesce(cuts, 0) AS n_cut_lines FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN u USING (r)),
b AS (SELECT *, {' + '.join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(quality_rules.RULES))} AS bits FROM m)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & {quality_rules.mask('base-1')} <> 0 AS base_failed, bits & {quality_rules.mask('web-3')} = 0 AS kept, bits::BIGINT AS failure_bits,
CASE bits & {quality_rules.mask('web-3')} {' '.join(f"WHEN {quality_rules.BIT[n]} THEN '{n}'" for n in quality_rules.POLICIES['web-3'])} END AS only_rule,
CASE WHEN bit_count(bits & {quality_rules.mask('web-3')}) = 1 THEN count(*) OVER (PARTITION BY bits & {quality_rules.mask('web-3')}) END AS n_only FROM b"""

OP7 = rf"""WITH s AS (SELECT doc_id, source, len({WORDS.format('text')}) AS size, md5('{mixing.SEED} ' || coalesce(doc_id::VARCHAR, 'null') || ' ' || coalesce(md5(text), 'null')) AS o FROM documents), src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
n AS (SELECT *, {list(map(float, mixing.WEIGHTS))}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]::DOUBLE AS w, {mixing.CAP}::DOUBLE * source_size AS top FROM src),
l AS (SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, coalesce(least(top, level * w), top) AS target FROM (SELECT source, source_size, w, top, max(CASE WHEN level * w <= top THEN level END) OVER () AS level FROM l)),
b AS (SELECT greatest(least(floor(min(target) / {mixing.FINE}), {mixing.BLOCK}), 1)::BIGINT AS block FROM t WHERE target > 0),
q AS (SELECT source, count(*) AS blocks FROM (SELECT source, n, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, coalesce(source, chr(1114111))) AS r FROM (SELECT *, floor(sum(target) OVER () / block + 0.5) AS n, unnest(range(1, (target / block)::BIGINT + 1000)) AS k FROM t, b) WHERE target > 0) WHERE r <= n GROUP BY source),
d AS (SELECT s.*, source_size, target, coalesce(blocks, 0) AS blocks, ('0x' || substr(o, 1, 8))::BIGINT % greatest(ceil(source_size / {mixing.SHARD})::BIGINT, 1) AS shard FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON q.source IS NOT DISTINCT FROM s.source),
h AS (SELECT source, shard, sum(size) AS shard_size, max(blocks) AS blocks FROM d WHERE size > 0 GROUP BY 1, 2),
j AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard) AS r FROM (SELECT *, unnest(range(1, blocks + 1)) AS k FROM h) WHERE shard_size > 0) WHERE r <= blocks GROUP BY 1, 2),
c AS (SELECT h.source, h.shard, shard_size, block, coalesce(quota, 0) AS quota, ceil({mixing.CAP} * shard_size / block)::BIGINT AS most FROM h CROSS JOIN b LEFT JOIN j ON j.source IS NOT DISTINCT FROM h.source AND j.shard = h.shard),
e AS (SELECT *, sum(greatest(quota - most, 0)) OVER (PARTITION BY source) AS over, greatest(most - quota, 0) AS room, coalesce(sum(greatest(most - quota, 0)) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
z AS (SELECT source, shard, shard_size, least(block * (least(quota, most) + greatest(least(room, over - before), 0)), floor({mixing.CAP} * shard_size))::BIGINT AS words FROM e),
y AS (SELECT d.*, shard_size, words, sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d LEFT JOIN z ON z.source IS NOT DISTINCT FROM d.source AND z.shard = d.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (words // shard_size * size + greatest(least(words - words // shard_size * shard_size - before, size), 0)) END::BIGINT AS taken FROM y"""


NEAREST = "SELECT r, min([d, c]) AS near FROM (SELECT k.r, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{0} c) GROUP BY r"
MEANS = """SELECT o.c, coalesce(n.v, o.v) AS v FROM c{0} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT near[2] AS c, i, sum(x) AS s, count(*) AS n FROM a{0} JOIN (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k) USING (r) GROUP BY ALL) GROUP BY c) n USING (c)"""
OP11 = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {hamerly.LIMIT // 256})) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM k) ORDER BY h NULLS LAST, v LIMIT 40),
{", ".join(f"a{i} AS MATERIALIZED ({NEAREST.format(i)}), c{i + 1} AS MATERIALIZED ({MEANS.format(i)})" for i in range(5))}, a5 AS MATERIALIZED ({NEAREST.format(5)})
SELECT vec_id, near[2]::INT AS cluster, near[1] AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia, (sum(near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM a5 JOIN k USING (r) JOIN c5 ON c5.c = near[2]"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op3_quality_rules": OP3, "op7_mixing": OP7, "op11_centroids": OP11}
