"""N50-style statistics, medians and histograms by group.

Ranks and running sums are taken over the histogram of lengths, which has one row
per distinct length instead of one per record, so no group is sorted record by
record in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n)"""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def nx(df: DataFrame, keys: Sequence[str], length: str, fractions: Mapping[str, float], *, counts: str | None = None) -> DataFrame:
    """N and L values of each group: columns n<name> (long) and l<name> (long).

    N is the largest length such that records at least as long hold the fraction of
    all; L is how many records that takes. ``counts`` names a column with the number
    of records of a length. A group whose records are all empty has N 0 and L 1. Null
    lengths are left out, and so are groups without others.
    """
    by = [df[k] for k in keys]
    h = df.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).cast("long").alias("__len")).agg((F.sum(counts) if counts else F.count(F.lit(1))).cast("long").alias("__n"))
    down = Window.partitionBy(*keys).orderBy(F.col("__len").desc())
    every = Window.partitionBy(*keys)
    bases = F.col("__len") * F.col("__n")
    h = h.withColumn("__total", F.sum(bases).over(every)).withColumn("__cum", F.sum(bases).over(down)).withColumn("__before", F.sum("__n").over(down) - F.col("__n"))
    aggs: list[Column] = []
    for name, fraction in fractions.items():
        target = F.col("__total") * F.lit(float(fraction))
        enough = (F.col("__cum") >= target) & (F.col("__len") > 0)
        missing = target - (F.col("__cum") - bases)
        rank = F.col("__before") + F.greatest(F.lit(1).cast("long"), F.ceil(missing / F.col("__len")))
        aggs.append(F.coalesce(F.max(F.when(enough, F.col("__len"))), F.lit(0).cast("long")).alias(f"n{name}"))
        aggs.append(F.coalesce(F.min(F.when(enough, rank)), F.lit(1).cast("long")).alias(f"l{name}"))
    return h.groupBy(*keys).agg(*aggs)


def length_summary(df: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Count, total, least, greatest, mean and median length, 0 where there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(length).alias("records"), zero(F.sum(length)).alias("total_length"), zero(F.min(length)).alias("min_length"), zero(F.max(length)).alias("max_length"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"), median(F.col(length)).alias("median_length"),
    )


def median(value: Column) -> Column:
    """Aggregate: mean of the middle pair, 0.0 of nothing."""
    return F.coalesce(F.median(value), F.lit(0.0))


def median_of_counts(value: Column, count: Column) -> Column:
    """Aggregate: exact median of a histogram."""
    return F.coalesce(F.percentile(value, 0.5, count), F.lit(0.0))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value at place n div 2 of each sorted group: from the histogram, without collecting a group."""
    h = histogram(df.where(F.col(value).isNotNull()), keys, value)
    up = Window.partitionBy(*keys).orderBy(value)
    h = h.withColumn("__cum", F.sum("n").over(up)).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    return h.where(F.col("__cum") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min(value).alias(value))
