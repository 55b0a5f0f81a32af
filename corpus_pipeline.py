"""Corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the
columns of ``documents``; the last returns the mix: the documents taken, with how
many words of each and how often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, tables
from tessera.llm.decontam import decontaminate
from tessera.llm.linedup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.quality import fit_quality, score_quality


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns put aside in ``row``, where no operator's columns clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None)).alias("row"))


def _back(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    given = {"doc_id": F.col("doc_id"), "text": F.col("text"), **changed}
    return out.select([given.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on this stage's own input."""
    (labels,) = tables(spark, sf_dir, "labels")
    return _back(score_quality(_aside(docs), fit_quality(docs, labels)).where("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; a document of which no word is left goes. ``n_chars``, if there is one, follows the text."""
    out = dedup_lines(_aside(docs))
    left = (F.col("n_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    size = {c.lower(): F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c)) for c in docs.columns if c.lower() == "n_chars"}
    return _back(out.where(left), docs, **size)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    copies = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    (benchmark,) = tables(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents taken, with ``copies`` (times) and ``taken`` (words)."""
    plan = mix(docs).where("taken > 0")
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", F.expr("CAST(taken DIV size AS BIGINT)").alias("copies"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A trained classifier and an edit distance against every passage are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    (docs,) = tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
