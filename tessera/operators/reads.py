"""Metrics of aligned reads by SAM flag bits, and their depth of coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import percent
from tessera.operators.intervals import breadth, depth_segments

# SAM flag bits.
BITS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(BITS[name])) != 0


def flag_counts(df: DataFrame, keys: Sequence[str], flag: str, names: Sequence[str] = tuple(BITS)) -> DataFrame:
    """Rows with each flag bit, one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("alignment_count"), *[F.count_if(has(F.col(flag), n)).alias(f"{n}_count") for n in names])


def cigar_ops(cigar: Column) -> Column:
    """Array of (length, op) of a CIGAR text; ``*`` has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda t: F.struct(F.regexp_extract(t, "^[0-9]+", 0).cast("long").alias("n"), F.right(t, F.lit(1)).alias("op")))


def cigar_bases(cigar: Column, ops: str) -> Column:
    """Summed length of the given operations."""
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(*ops), x["n"]).otherwise(0))


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """Half-open reference blocks of the aligned bases of each read: (rname, block_start, block_end)."""
    step = F.aggregate(
        cigar_ops(F.col("cigar")),
        F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("b")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("at"),
            F.when(x["op"].isin(*"M=X"), F.concat(a["b"], F.array(F.struct(a["at"].alias("s"), (a["at"] + x["n"]).alias("e"))))).otherwise(a["b"]).alias("b"),
        ),
    )
    return reads.select("rname", F.explode(step["b"]).alias("k")).select("rname", F.col("k.s").alias("block_start"), F.col("k.e").alias("block_end"))


def read_metrics(reads: DataFrame) -> DataFrame:
    """One row of metrics of (flag, rname, pos, mapq, cigar, seq, tlen, mate, nm).

    Primary means neither secondary nor supplementary. Insert sizes are those of
    proper first reads with a positive template length; variance is that of the
    population. The error rate is null without edits recorded.
    """
    f = F.col("flag")
    is_ = lambda n: has(f, n)
    mapped, primary = ~is_("unmapped"), ~is_("secondary") & ~is_("supplementary")
    pm = mapped & primary
    insert = F.when(is_("paired") & is_("proper") & is_("read1") & (F.col("tlen") > 0), F.col("tlen"))
    other = is_("paired") & mapped & ~is_("mate_unmapped") & primary & (F.col("mate") != F.col("rname"))
    c = F.count_if
    aligned, clipped, query = cigar_bases(F.col("cigar"), "M=X"), cigar_bases(F.col("cigar"), "S"), cigar_bases(F.col("cigar"), "MIS=X")
    one = reads.agg(
        F.count(F.lit(1)).alias("alignment_count"), *[c(is_(n)).alias(f"{n}_count") for n in ("qc_fail", "secondary", "supplementary", "duplicate", "paired", "read1", "read2", "unmapped")], c(mapped).alias("mapped_count"), c(pm).alias("primary_mapped_count"), c(is_("proper") & is_("paired")).alias("proper_pair_count"),
        c(is_("paired") & mapped & is_("mate_unmapped")).alias("singleton_count"), c(other).alias("mate_other_reference_count"), c(other & (F.col("mapq") >= 5)).alias("mate_other_reference_mapq5_count"), c(pm & (F.col("mapq") >= 30)).alias("mapq_ge30_count"), c(mapped & ~is_("reverse")).alias("forward_count"),
        F.coalesce(F.avg(F.when(pm, F.col("mapq"))), F.lit(0.0)).alias("mean_mapq"), F.count(insert).alias("insert_size_count"), F.avg(insert).alias("insert_size_mean"), F.stddev_pop(insert).alias("insert_size_std"), F.median(insert).alias("insert_size_median"), F.min(insert).alias("insert_size_min"), F.max(insert).alias("insert_size_max"),
        F.coalesce(F.sum(F.when(mapped, aligned)), F.lit(0)).alias("aligned_query_bases"), F.coalesce(F.sum(F.when(mapped, clipped)), F.lit(0)).alias("soft_clipped_bases"), F.coalesce(F.sum(F.when(mapped, query)), F.lit(0)).alias("mapped_query_bases"), F.sum(F.when(mapped, F.col("nm"))).alias("edits"),
    )
    return one.select(
        "*", percent(F.col("mapped_count"), F.col("alignment_count")).alias("mapped_percent"), percent(F.col("primary_mapped_count"), F.col("alignment_count")).alias("primary_mapped_percent"), percent(F.col("duplicate_count"), F.col("alignment_count")).alias("duplicate_percent"),
        percent(F.col("proper_pair_count"), F.col("paired_count")).alias("proper_pair_percent"), percent(F.col("singleton_count"), F.col("paired_count")).alias("singleton_percent"), percent(F.col("forward_count"), F.col("mapped_count")).alias("forward_strand_percent"),
        percent(F.col("soft_clipped_bases"), F.col("mapped_query_bases")).alias("soft_clip_percent"), percent(F.col("mapq_ge30_count"), F.col("primary_mapped_count")).alias("mapq_ge30_percent"), F.try_divide(F.col("edits").cast("double"), F.col("aligned_query_bases").cast("double")).alias("error_rate"),
    )


def coverage_metrics(reads: DataFrame, references: Mapping[str, int]) -> DataFrame:
    """Mean depth, breadth and bases with depth of at least 10 and 30 over all references; unmapped, secondary and failed reads don't count."""
    f = F.col("flag")
    used = reads.where(~has(f, "unmapped") & ~has(f, "secondary") & ~has(f, "qc_fail"))
    total = sum(references.values())
    got = breadth(depth_segments(aligned_blocks(used), ["rname"], "block_start", "block_end"), ["rname"]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bases_ge_1", "bases_ge_10", "bases_ge_30", "aligned_bases")])
    size = F.lit(total)
    return got.select("*", F.coalesce(F.try_divide(F.col("aligned_bases").cast("double"), size.cast("double")), F.lit(0.0)).alias("mean_depth"), *[percent(F.col(f"bases_ge_{d}"), size).alias(f"breadth_ge_{d}_percent") for d in (1, 10, 30)])
