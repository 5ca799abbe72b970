"""The corpus operators as queries over whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, line_dedup, mixing, quality, secrets, simhash, toxicity, unit_dedup, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_t(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_t(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_t(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_t(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_t(spark, sf_dir, "pages"))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.duplicate_units(_t(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "start", "n_chars", "n_words", "first_id AS first_doc_id", "first_start")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_t(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_toxicity, op3_line_dedup, op4_simhash, op5_secrets, op6_decontaminate, op7_warc, op8_unit_dedup, op9_html_text, op10_quality)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"""list_filter(string_split_regex(translate(lower(coalesce(text, '')), '.,;:!?"''()[]{}', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

ORACLE_SQL = {
    "op1_mix": f"""
WITH s AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS u FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s GROUP BY source),
step AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS r FROM src),
level AS (SELECT r, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM src) - coalesce(sum(cap) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM step),
lam AS (SELECT l FROM level WHERE l <= r ORDER BY r LIMIT 1),
tgt AS (SELECT source, source_size, least(cap, (SELECT l FROM lam) * weight) AS target FROM step),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tgt),
o AS (SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY u) AS upto FROM s)
SELECT o.doc_id, o.size, p.source_size, p.target,
  ((p.whole + CASE WHEN o.upto - o.size / 2.0 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source""",
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT a, b, c, min({'i': doc_id, 'p': pos}) AS f FROM w WHERE c IS NOT NULL GROUP BY a, b, c HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM (SELECT w.doc_id, w.pos FROM w JOIN r USING (a, b, c) WHERE w.doc_id <> r.f.i OR w.pos <> r.f.p) AS q, (SELECT unnest([0, 1, 2]) AS k) AS ks),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS t FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.doc_id IS NULL GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*)::INT AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, len(l.ls)::INT AS n_lines, coalesce(n.n, 0)::INT AS n_removed, coalesce(kept.t, '') AS text
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_decontaminate": f"""
WITH i0 AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
i AS (SELECT min(item_id) AS item_id, w, len(w) AS len, least(len(w), 5) AS k FROM i0 WHERE len(w) >= 1 GROUP BY w),
ig AS (SELECT item_id, len, k, q, array_to_string(w[q + 1 : q + k], ' ') AS g FROM i, unnest(range(len - k + 1)) AS t(q)),
ic AS (SELECT item_id, g, count(*) AS n FROM ig GROUP BY ALL),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
dg AS (SELECT doc_id, k, len(w) AS n, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM i) AS ks, unnest(range(greatest(len(w) - k + 1, 0))) AS t(p)),
win AS (SELECT DISTINCT doc_id, k, len, greatest(0, least(p - q, n - len)) AS start FROM dg JOIN ig USING (k, g)),
pair AS (SELECT doc_id, item_id, k, len, start FROM win JOIN i USING (k, len)),
wg AS (SELECT pair.doc_id, pair.item_id, pair.k, pair.len, pair.start, dg.g, count(*) AS n FROM pair JOIN dg ON dg.doc_id = pair.doc_id AND dg.k = pair.k AND dg.p >= pair.start AND dg.p <= pair.start + pair.len - pair.k GROUP BY ALL),
sim AS (SELECT wg.doc_id, wg.item_id, wg.k, wg.len, wg.start, sum(least(wg.n, coalesce(ic.n, 0))) AS shared, sum(wg.n) AS m FROM wg LEFT JOIN ic ON ic.item_id = wg.item_id AND ic.g = wg.g GROUP BY ALL),
v AS (SELECT doc_id, item_id, start, len, shared::DOUBLE / (m + len - k + 1 - shared)::DOUBLE AS s FROM sim)
SELECT doc_id, item_id, start::INT AS start, len::INT AS n_words, s AS similarity FROM v WHERE s >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) = 1""",
    "op7_warc": """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER p THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER p THEN min(page_id) OVER p END AS refers_to
FROM pages WINDOW p AS (PARTITION BY coalesce(html, ''))""",
    "op8_unit_dedup": r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?。！？\n]+[.!?。！？]*|[.!?。！？]+|\n') AS us FROM documents),
e AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS pos FROM l),
w AS (SELECT *, regexp_extract_all(lower(unit), '[^\x20\x09-\x0D]+') AS w FROM e),
o AS (SELECT doc_id, pos, w, length(unit)::BIGINT AS n_chars, len(w)::BIGINT AS n_words, (sum(length(unit)) OVER p - length(unit))::BIGINT AS start,
  (sum(len(w)) OVER p - len(w))::BIGINT AS word FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, array_to_string(w, ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM o WHERE n_words >= 4),
f AS (SELECT norm, min({'i': doc_id, 's': start}) AS f FROM k GROUP BY norm),
d AS (SELECT k.*, f.f.i AS first_doc_id, f.f.s AS first_start, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run
  FROM k JOIN f USING (norm) WHERE k.doc_id <> f.f.i OR k.start <> f.f.s)
SELECT doc_id, start, n_chars, n_words, first_doc_id, first_start FROM d
QUALIFY max(word + n_words) OVER (PARTITION BY doc_id, run) - min(word) OVER (PARTITION BY doc_id, run) >= 25""",
    "op10_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, p, {{'a': w[p], 'b': w[p + 1], 'c': w[p + 2]}} AS g FROM d, unnest(range(1, len(w) - 1)) AS t(p)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 60 * n_lines AND word_chars BETWEEN 2 * n_words AND 20 * n_words) AS kept FROM b""",
}
