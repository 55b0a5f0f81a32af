"""Intervals: binned densities, depth of coverage, length checks and extraction windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(df: DataFrame, keys: Sequence[str], start: str, end: str, size: int) -> DataFrame:
    """Count, least start, greatest end and density of the intervals by the bin of their 1-based start."""
    place = F.floor((F.col(start) - 1) / size).cast("long")
    out = df.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("min_start"), F.max(end).alias("max_end"))
    return out.withColumn("density", F.col("n") / F.lit(float(size)))


def depth_segments(blocks: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Segments of constant depth >= 1 of half-open blocks: (keys, seg_start, seg_end, depth).

    Block ends are +1 and -1 events, summed where they meet before the running sum,
    so the sweep sorts distinct positions, not blocks.
    """
    live = blocks.where(F.col(start) < F.col(end))
    events = live.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy(*keys, F.col("e.pos").alias("seg_start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("seg_start")
    swept = events.withColumn("depth", F.sum("d").over(w)).withColumn("seg_end", F.lead("seg_start").over(w))
    return swept.where("depth > 0").select(*keys, "seg_start", "seg_end", "depth")


def breadth(segments: DataFrame, keys: Sequence[str], depths: Sequence[int] = (1, 10, 30)) -> DataFrame:
    """Bases covered at least so deep, and all aligned bases."""
    size = F.col("seg_end") - F.col("seg_start")
    return segments.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("depth") >= d, size)), F.lit(0)).alias(f"bases_ge_{d}") for d in depths], F.sum(size * F.col("depth")).alias("aligned_bases"))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Union of closed intervals that overlap or lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return fresh.groupBy(*keys, "__id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__id")


def beyond_length(features: DataFrame, lengths: DataFrame, *, seqid: str = "seqid", end: str = "end", length: str = "length") -> DataFrame:
    """One row: features on unknown sequences, and features that end beyond theirs."""
    joined = features.join(lengths.select(F.col(seqid).alias("__s"), F.col(length).alias("__l")), F.col(seqid) == F.col("__s"), "left")
    return joined.agg(F.count_if(F.col("__l").isNull()).alias("seqid_mismatch_count"), F.count_if(F.coalesce(F.col(end) > F.col("__l"), F.lit(False))).alias("end_beyond_sequence_count"))


def window(sequence: Column, start: Column, end: Column, flank: int = 0) -> Column:
    """Struct of the 1-based closed window with flanks clamped to the sequence: w_start, w_end, w_text."""
    lo, hi = F.greatest(F.lit(1), start - flank), F.least(F.length(sequence), end + flank)
    return F.struct(lo.alias("w_start"), hi.alias("w_end"), F.substring(sequence, lo, F.greatest(F.lit(0), hi - lo + 1)).alias("w_text"))


def extract_regions(regions: DataFrame, sequences: DataFrame, *, flank: int = 5, min_length: int = 0, best: Sequence[Column] | None = None) -> DataFrame:
    """Regions (seqid, start, end, ...) cut from sequences (seqid, sequence), each with a status.

    Statuses: MISSING_SEQUENCE, INVALID_COORDINATES, TOO_SHORT, NOT_BEST (if an order
    is given, all but the first good region of a sequence), SELECTED.
    """
    r = regions.join(sequences.select("seqid", "sequence"), "seqid", "left")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("start") > F.length("sequence"))
    status = F.when(F.col("sequence").isNull(), "MISSING_SEQUENCE").when(bad, "INVALID_COORDINATES").when(F.col("end") - F.col("start") + 1 < min_length, "TOO_SHORT")
    r = r.withColumn("status", status)
    if best:
        w = Window.partitionBy("seqid").orderBy(F.col("status").isNotNull(), *best)
        r = r.withColumn("status", F.when(F.col("status").isNull() & (F.row_number().over(w) > 1), "NOT_BEST").otherwise(F.col("status")))
    r = r.withColumn("status", F.coalesce("status", F.lit("SELECTED")))
    cut = window(F.col("sequence"), F.col("start"), F.col("end"), flank)
    return r.withColumn("w", F.when(F.col("status") == "SELECTED", cut)).select("*", "w.*").drop("w", "sequence")
