"""Quality of multiple alignments: rows, columns and a summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.nstats import upper_median

_GAPS = "-."


def check_equal(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The records, or an error on reading them if a group's lengths differ."""
    n = F.length("sequence")
    names = {c: f"__{c}" for c in keys}
    sizes = records.groupBy(*keys).agg((F.min(n) != F.max(n)).alias("__unequal")).withColumnsRenamed(names)
    test = F.lit(True)
    for c in keys:
        test &= F.col(c).eqNullSafe(F.col(names[c]))
    both = records.join(sizes, test)
    checked = F.when(F.col("__unequal"), F.raise_error(F.lit("unequal lengths")).cast("string"))
    return both.withColumn("sequence", checked.otherwise(F.col("sequence"))).select(*records.columns)


def alignment_rows(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each row's length, sites that are no gap, coverage and gap fraction."""
    n = F.length("sequence").cast("long")
    sites = F.length(F.translate("sequence", _GAPS, "")).cast("long")
    share = F.coalesce(F.try_divide(sites.cast("double"), n.cast("double")), F.lit(0.0))
    return records.select(*keys, "record_no", "seqid", n.alias("alignment_length"), sites.alias("non_gap_sites"), share.alias("coverage"), F.when(n > 0, 1 - share).otherwise(0.0).alias("gap_fraction"))


def alignment_columns(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each column's occupancy, distinct residues, consensus (ties: the first row's residue) and its share of residues.

    Rows x columns cells are pre-aggregated by (column, residue) map-side, so what is
    shuffled is columns x alphabet.
    """
    rows = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    cells = records.select(*keys, "record_no", F.posexplode(F.split("sequence", "")).alias("p", "residue"))
    gap = F.col("residue").isin(*_GAPS)
    counts = cells.where(F.col("residue") != "").groupBy(*keys, "p", "residue").agg(F.count(F.lit(1)).alias("n"), F.min("record_no").alias("first"))
    out = counts.groupBy(*keys, "p").agg(
        F.coalesce(F.sum(F.when(~gap, F.col("n"))), F.lit(0)).alias("residues"), F.count_if(~gap).alias("distinct_residues"), F.min_by(F.when(~gap, F.struct("residue", "n")), F.when(~gap, F.struct((-F.col("n")).alias("k"), "first"))).alias("best")
    )
    out = out.join(rows, list(keys)) if keys else out.crossJoin(rows)
    return out.select(
        *keys, (F.col("p") + 1).cast("long").alias("column_1based"), (F.col("residues") / F.col("__rows")).alias("occupancy"), "distinct_residues", F.coalesce("best.residue", F.lit("-")).alias("consensus"),
        F.coalesce(F.try_divide(F.col("best.n").cast("double"), F.col("residues").cast("double")), F.lit(0.0)).alias("consensus_fraction"),
    )


def alignment_summary(rows: DataFrame, columns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sequences, length, mean and upper-median coverage (of values rounded to six places), columns with occupancy of at least 0.9 and 0.7."""
    rounded = rows.withColumn("coverage", F.round("coverage", 6))
    a = rounded.groupBy(*keys).agg(F.count(F.lit(1)).alias("sequences"), F.max("alignment_length").alias("alignment_length"), F.avg("coverage").alias("mean_coverage"))
    m = upper_median(rounded, keys, "coverage").withColumnRenamed("coverage", "median_coverage")
    c = columns.groupBy(*keys).agg(*[F.count_if(F.round("occupancy", 6) >= v).alias(f"columns_occupancy_ge_{str(v).replace('.', '_')}") for v in (0.9, 0.7)])
    if keys:
        return a.join(m, list(keys)).join(c, list(keys))
    return a.crossJoin(m).crossJoin(c)
