"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tables
from tessera.llm.license import scan_sql
from tessera.llm.linedup import dedup_sql


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    (docs,) = tables(spark, sf_dir, "documents")
    return near_duplicates(docs, width=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s
), i AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i FROM e a JOIN e b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL HAVING true
), l AS (SELECT x, y FROM i WHERE 100 * i >= 85 * (nx + ny - i)
), r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    (docs,) = tables(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'text|' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
         / greatest(0.05, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')) AS DOUBLE) / greatest(1, length(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source
), fill AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () * 1.5 AS total,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM s
), lv AS (SELECT *, CAST((total - full_before) / left_w AS DOUBLE) AS lev FROM fill
), t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN lev * weight <= cap THEN lev END) OVER () * weight, cap)) AS target FROM lv
), k AS (
  SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
"""

def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.linedup import dedup_lines

    (docs,) = tables(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import fit_quality, score_quality

    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html import extract_main_text

    (pages,) = tables(spark, sf_dir, "pages")
    return extract_main_text(pages)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license import scan_licenses

    (docs,) = tables(spark, sf_dir, "documents")
    return scan_licenses(docs)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import find_passages

    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    items = F.array_join(F.transform("matches", lambda m: F.coalesce(m[0].cast("string"), F.lit("?"))), ",")
    return found.select("doc_id", "contaminated", F.size("matches").cast("long").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m[3])).alias("least_edits"))


def op3_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import nearest

    (vectors,) = tables(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import fit_forest, labelled_findings, scan_secrets

    (docs,) = tables(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_forest(labelled_findings(spark)), path=F.col("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_anisotropic_neighbours": op3_anisotropic_neighbours,
    "op4_line_dedup": op4_line_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mix_sources": op7_mix_sources,
    "op8_html_main_text": op8_html_main_text,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {"op1_minhash_near_dedup": OP1_SQL, "op4_line_dedup": dedup_sql(), "op7_mix_sources": OP7_SQL, "op9_license_scan": scan_sql()}
