"""The registered queries of this subpackage, over the whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import brown, crf, curves, infill, lines, passages, periods, pivotal, qgram, shards, simhash, suffixes, urls
from .common import binary_text


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.hilbert_shards(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(binary_text(F.col("text")), 256).alias("kept_sha256"))


def op3_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(_read(spark, sf_dir, "documents"))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.mix(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op6_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.neighbours(_read(spark, sf_dir, "embeddings"))


def op8_crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.languages(_read(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.drop_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_read(spark, sf_dir, "documents"), plant=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    each = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.shorter")).alias("period"),
        F.expr("(1000 * top.length) div -top.shorter").alias("exponent_milli"),
        F.sha2(binary_text(F.array_join(each, "")), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_fm_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.drop_passages(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = infill.fill_in_middle(_read(spark, sf_dir, "documents"))
    output = F.sha2(binary_text(F.col("output")), 256).alias("output_sha256")
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output, F.sha2(binary_text(infill.restored()), 256).alias("restored_sha256"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_hilbert_shards, op2_line_dedup, op3_brown_scores, op4_pivotal_mix, op5_url_filter, op6_qgram_leaks,
        op7_hilbert_neighbours, op8_crf_languages, op9_simhash_groups, op10_suffix_dedup, op11_periodic_runs,
        op12_fm_passages, op13_fill_in_middle,
    )
}

ORACLES = {
    "op2_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM docs
),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.last <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op13_fill_in_middle": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
         [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS draw FROM docs
),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS low,
         greatest(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= 90 THEN 'plain'
              WHEN draw[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:n], ''), '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
}
