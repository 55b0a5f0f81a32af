"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Each document draws an exponential variable divided by its quality weight; sorted
within a source and prefix-summed, the keys give a weighted sample without
replacement up to any budget. Complete epochs come first: a source whose target is
1.3 times its size is taken once in full, and 0.3 of it by the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored

#: A source's key range is cut into at least so many parts, and more for more rows, so that no source is sorted in one task.
PARTS, PART_ROWS = 512, 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``target``.

    The sources, by code point with null last, take the weights in turn and share
    ``share`` times all words; a target stops at ``most`` times its source's size,
    and the excess goes to the others by weight. That fixed point is a water level
    L with target = least(most * size, L * weight): sources sorted by the level at
    which they fill up, running sums give L. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    with_w = sizes.withColumn("weight", F.element_at(ring, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    run = with_w.withColumn("cap", cap)
    run = run.withColumn("full", F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1))).withColumn("left_w", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    run = run.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce("full", F.lit(0.0))) / F.col("left_w"))
    # The level that holds is that of the first source which it doesn't fill up, and the largest of those that fill up no source of their own.
    run = run.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return run.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", quality: Column | None = None) -> DataFrame:
    """Mix ``docs`` (doc_id, text, source): words taken from each document.

    Returns one row per input row: doc_id, size (words; null text: 0), source,
    source_size, target (its source's), key, taken (words the mix takes, repeats
    counted). Every document is taken ``floor(target / source_size)`` times, and
    once more if the middle of its stretch of the key-sorted running sum lies below
    what is left, so a source misses its target by half a document at most.
    Documents are whole: taken is a multiple of size.

    ``quality`` is a positive weight (null or not positive: 1); by default the
    share of letters among a text's characters, at least 0.05. Draws depend on
    ``seed`` and doc_id only, so reruns agree; ties go to the smaller doc_id, then
    the smaller size. Null doc_ids draw by their text, a null source is a
    source of its own, empty texts take nothing, other columns are not read, and
    an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if quality is None:
        quality = F.greatest(F.lit(0.05), F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) / F.greatest(F.lit(1), F.length(text)))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text|"), F.md5(text.cast("binary")))))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.when(quality > 0, quality.cast("double")).otherwise(F.lit(1.0))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (-F.log(draw) / weight).alias("key")), "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # exp(-key) is in (0, 1), and monotone: its parts are ranges of the key.
    parts = max(PARTS, rows.count() // PART_ROWS)
    part = F.least(F.lit(parts - 1), F.floor((1 - F.exp(-F.col("key"))) * parts)).cast("int")
    rows = rows.withColumn("part", part)
    before = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = before.select("source", "part", (F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).alias("before"))
    start = before.join(targets, before["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = rows.withColumn("inside", inside).alias("r").join(start.alias("s"), F.expr("r.source <=> s.source AND r.part = s.part"))
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    left = F.col("target") - epochs * F.col("source_size")
    more = F.when((F.col("before") + F.col("inside") + F.col("size") / 2.0) < left, 1).otherwise(0)
    return at.select("doc_id", "size", "r.source", "source_size", "target", "key", (F.col("size") * (epochs + more)).cast("long").alias("taken"))
