"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegraph.llm import bpe, langid, minhash, mixing, pii, quality, rules, spotsigs, token_counts, toxicity
from filegraph.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, batch="8m")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.report(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(documents(spark, sf_dir))


# Those columns of the operators' results that SQL can express, each from a whole run of the operator.


def part_op6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def part_op7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def part_op8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def part_op10_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rules(spark, sf_dir).select("doc_id", *rules.COUNTS, "base_failed")


QUERIES = {f.__name__: f for f in (op1_pii, op2_minhash, op3_quality, op4_toxicity, op5_bpe, op6_spotsigs, op7_token_counts, op8_mixing, op9_langid, op10_rules, part_op6_edits, part_op7_bytes, part_op8_targets, part_op10_base)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL where it can say what the operator does; for the others the tests hold brute-force versions.
ORACLES: dict[str, str] = {
    "op2_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT md5(array_to_string(list_sort(s), '|')) AS u, min(doc_id) AS id, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM t),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT t.id, least(t.id, min(r.b)) AS component FROM t LEFT JOIN r ON r.a = t.id GROUP BY t.id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN t ON len(s.s) > 0 AND t.u = md5(array_to_string(list_sort(s.s), '|')) LEFT JOIN c ON c.id = t.id""",
    "part_op6_edits": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 4 AS q, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - q) || substring(nx, 1, q)) AS edited_sha256 FROM n""",
    "part_op7_bytes": "SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents",
    "part_op8_targets": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (SELECT *, coalesce(sum(source_size) OVER b, 0) * 3 AS capped, coalesce(sum(weight) OVER b, 0) AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM o WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(used) AS used FROM f WHERE weight * (total - capped) <= 3 * source_size * (weights - used)),
g AS (SELECT f.source, f.source_size, CASE WHEN l.used IS NULL OR f.used < l.used THEN 3.0 * f.source_size ELSE f.weight * (SELECT (x.total - x.capped) / (x.weights - x.used) FROM f x WHERE x.used = l.used)::DOUBLE END AS target FROM f, l)
SELECT d.doc_id, d.size, g.source_size, round(g.target::DOUBLE, 3) AS target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source""",
    "part_op10_base": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS x FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, range(5) z(j) GROUP BY doc_id),
n AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
q AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(q.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id""",
}
