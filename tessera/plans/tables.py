"""Readers of the driver's tables, and their analogies to the library's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as features: 1-based closed intervals on supplier sequences."""
    (li,) = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("seqid"), F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_discount").alias("score"),
        F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"), (F.col("l_linenumber") % 3).cast("string").alias("phase"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("parent"),
        F.lit(None).cast("string").alias("gene_id"), F.lit(None).cast("string").alias("transcript_id"), F.concat(F.lit("Flag="), F.col("l_returnflag"), F.lit(";Line="), F.col("l_linenumber").cast("string")).alias("attributes"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_number"),
    )


#: The same in SQL.
INTERVALS = """(SELECT CAST(l_suppkey AS VARCHAR) AS seqid, l_linestatus AS source, l_returnflag AS type, l_partkey AS "start", l_partkey + CAST(l_quantity AS BIGINT) AS "end", l_discount AS score,
 CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, CAST(l_linenumber % 3 AS VARCHAR) AS phase, l_orderkey || '_' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS parent,
 'Flag=' || l_returnflag || ';Line=' || l_linenumber AS attributes, l_orderkey * 10 + l_linenumber AS line_number FROM lineitem)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a long metric store: the entity is a user, the identity the parity of the event, the metric its type."""
    (e,) = read(spark, sf_dir, "events")
    return e.select("user_id", (F.col("event_id") % 3).alias("identity"), F.col("event_type").alias("metric"), F.col("ts").alias("moment"), F.col("event_id").alias("seq"), F.col("value").cast("string").alias("text"), F.col("value").alias("num"))


METRICS = "(SELECT user_id, event_id % 3 AS identity, event_type AS metric, ts AS moment, event_id AS seq, value AS num FROM events)"
