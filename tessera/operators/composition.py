"""Sequence statistics: assemblies, reads and proteins, each one aggregation over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import circular, count_of, percent
from tessera.operators.nstats import median, nx


def _joined(keys: Sequence[str], left: DataFrame, *others: DataFrame) -> DataFrame:
    """Results of one group each, side by side; null-safe on the keys."""
    for k, right in enumerate(others):
        names = {c: f"__{k}_{c}" for c in keys}
        test = F.lit(True)
        for c in keys:
            test &= F.col(c).eqNullSafe(F.col(names[c]))
        left = left.join(right.withColumnsRenamed(names), test, "left").drop(*names.values())
    return left


def assembly_stats(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Twenty assembly metrics of (header, seqid, sequence) records by group.

    Bases are upper-cased. Percentages of N, ambiguous letters and gaps are of all
    characters, GC of A, C, G and T. Only ``-`` is a gap. N90 compares the running
    sum with 0.9 times the total in doubles.
    """
    s = F.upper("sequence")
    r = records.select(*keys, "header", "seqid", F.length("sequence").cast("long").alias("len"), *[count_of(s, c).alias(n) for n, c in (("gc", "GC"), ("at", "AT"), ("n", "N"), ("amb", "RYSWKMBDHV"), ("gap", "-"))], F.regexp_count("sequence", F.lit("-+")).alias("gaps"), circular(F.col("header")).alias("circ"))
    total = F.coalesce(F.sum("len"), F.lit(0))
    stats = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sequence_count"), total.alias("total_length"), F.coalesce(F.min("len"), F.lit(0)).alias("min_sequence_length"), F.coalesce(F.max("len"), F.lit(0)).alias("max_sequence_length"),
        F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean_sequence_length"), median(F.col("len")).alias("median_sequence_length"), percent(F.sum("gc"), F.sum(F.col("gc") + F.col("at"))).alias("gc_percent"), percent(F.sum("n"), total).alias("n_percent"),
        percent(F.sum("amb"), total).alias("ambiguous_base_percent"), F.coalesce(F.sum(F.col("len") - F.col("gc") - F.col("at") - F.col("n") - F.col("amb") - F.col("gap")), F.lit(0)).alias("invalid_base_count"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gap_count"),
        percent(F.sum("gap"), total).alias("gap_percent"), F.count_if(F.col("len") == 0).alias("empty_sequence_count"), (F.count("seqid") - F.count_distinct("seqid")).alias("duplicate_sequence_id_count"), (F.count("header") - F.count_distinct("header")).alias("duplicate_header_count"),
        F.count_if("circ").alias("circular_sequence_count"),
    )
    n = nx(r, keys, "len", {"50": 0.5, "90": 0.9}).withColumnsRenamed({"n50": "contig_n50", "l50": "contig_l50", "n90": "contig_n90", "l90": "contig_l90"})
    return _joined(keys, stats, n).fillna(0, ["contig_n50", "contig_l50", "contig_n90", "contig_l90"])


def sequence_lengths(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summed length of each seqid."""
    return records.groupBy(*keys, "seqid").agg(F.sum(F.length("sequence")).cast("long").alias("length"))


def quality_encoding(least: Column, offset: str | int = 33) -> Column:
    """Name of the quality encoding: as given, 33 or 64, or for ``auto`` 33, ambiguous where no quality lies below 64.

    An explicit 64 below which a quality lies is an error on reading; without any quality, too.
    """
    if str(offset) == "33":
        return F.lit("sanger_phred33")
    if str(offset) == "64":
        return F.when(F.coalesce(least, F.lit(0)) < 64, F.raise_error(F.lit("quality below the offset 64")).cast("string")).otherwise("illumina_phred64")
    if offset != "auto":
        raise ValueError("the offset must be 33, 64 or auto")
    return F.when(least >= 64, "ambiguous_assumed_phred33").otherwise("sanger_phred33")


def read_stats(reads: DataFrame, keys: Sequence[str] = (), *, order: str = "record_no", sample: int = 1_000_000, offset: str | int = 33) -> DataFrame:
    """Read metrics of (record_no, sequence, quality) by group.

    ``order`` is a read's number in its group, from 0. Duplicates and over-represented
    sequences (strictly more than 1 % of the sample) are those of the first ``sample``
    reads, compared as they are; long ones by their SHA-256, so no long text is a key.
    """
    base = 64 if str(offset) == "64" else 33
    at_least = lambda q: F.regexp_count("quality", F.lit(f"[\\x{base + q:02x}-\\x7e]"))
    codes = F.transform(F.split("quality", ""), lambda c: F.ascii(c))
    s = F.upper("sequence")
    r = reads.select(*keys, order, "sequence", F.length("sequence").cast("long").alias("len"), at_least(20).alias("q20"), at_least(30).alias("q30"), count_of(s, "GC").alias("gc"), count_of(s, "ACGT").alias("acgt"), F.when(F.length("quality") > 0, F.array_min(codes)).alias("low"))
    bases = F.coalesce(F.sum("len"), F.lit(0))
    least = F.min("low")
    stats = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("read_count"), bases.alias("total_bases"), F.coalesce(F.min("len"), F.lit(0)).alias("read_length_min"), F.coalesce(F.max("len"), F.lit(0)).alias("read_length_max"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("read_length_mean"),
        percent(F.sum("q20"), bases).alias("q20_percent"), percent(F.sum("q30"), bases).alias("q30_percent"), percent(F.sum("gc"), F.sum("acgt")).alias("gc_percent"), quality_encoding(least, offset).alias("quality_encoding"),
    )
    n = nx(r, keys, "len", {"50": 0.5}).withColumnsRenamed({"n50": "read_length_n50", "l50": "read_length_l50"})
    key = F.when(F.length("sequence") <= 64, F.col("sequence")).otherwise(F.sha2("sequence", 256))
    first = r.where(F.col(order) < sample).withColumn("sequence", key)
    same = first.groupBy(*keys, "sequence").agg(F.count(F.lit(1)).alias("k"))
    seen = same.groupBy(*keys).agg(F.sum("k").alias("sampled"), F.count(F.lit(1)).alias("kinds"), F.max("k").alias("most"))
    often = _joined(keys, same, seen.select(*keys, "sampled")).groupBy(*keys).agg(F.count_if(F.col("k") > F.col("sampled") * 0.01).alias("overrepresented_sequence_count"))
    seen = seen.select(*keys, F.col("sampled").alias("duplicate_sampled_read_count"), percent(F.col("sampled") - F.col("kinds"), F.col("sampled")).alias("duplicate_percent"))
    out = _joined(keys, stats, n, seen, often)
    return out.withColumn("duplicate_is_sampled", F.col("read_count") > F.col("duplicate_sampled_read_count")).withColumn("duplicate_sampling_strategy", F.lit("first_n"))


def protein_stats(records: DataFrame, keys: Sequence[str] = (), cds_count: Column | None = None) -> DataFrame:
    """Protein metrics of (seqid, sequence) by group; a final ``*`` is no internal stop, empty sequences skip start and stop checks."""
    s = F.upper("sequence")
    full = F.length("sequence") > 0
    stops = F.greatest(count_of(s, "*") - F.when(s.endswith("*"), 1).otherwise(0), F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("protein_count"), (F.count("seqid") - F.count_distinct("seqid")).alias("protein_duplicate_id_count"), F.count_if(~full).alias("protein_empty_count"), percent(F.sum(count_of(s, "X")), F.sum(F.length("sequence"))).alias("protein_x_percent"),
        F.coalesce(F.sum(stops), F.lit(0)).alias("protein_internal_stop_count"), F.count_if(full & ~s.startswith("M")).alias("protein_missing_start_count"), F.count_if(full & ~s.endswith("*")).alias("protein_missing_stop_count"),
    ]
    if cds_count is not None:
        aggs.append((F.count(F.lit(1)) == F.first(cds_count)).cast("int").alias("cds_protein_count_match"))
    return records.groupBy(*keys).agg(*aggs)
