"""Latest rows, effective decisions, ranks and pivots of the long metric store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics of a file's integrity, for which the worst over identities counts, not the newest.
INTEGRITY = ("file_exists", "sha256_match", "parseable", "paired_read_count_match")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank; the filter becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def current(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Current rows of an append-only log: those with the largest sequence number of their key, found by aggregation alone."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def effective(automatic: Column, curated: Column) -> Column:
    """A curated decision overrides the automatic one."""
    return F.coalesce(curated, automatic)


def latest_metrics(
    df: DataFrame, *, entity: Sequence[str], identity: str, metric: str, at: str, sequence: str, text: str, numeric: str, integrity: Sequence[str] = INTEGRITY,
) -> DataFrame:
    """Latest value of each metric of an entity.

    First the newest row of each (identity, metric), then the newest of these over
    identities; for integrity metrics the least number over identities.
    """
    order = [F.col(at).desc_nulls_last(), F.col(sequence).desc()]
    per_identity = latest(df, [*entity, identity, metric], order)
    worst = F.min(F.col(numeric)).over(Window.partitionBy(*entity, metric))
    out = per_identity.withColumn("__worst", worst)
    out = latest(out, [*entity, metric], order)
    number = F.when(F.col(metric).isin(*integrity), F.col("__worst")).otherwise(F.col(numeric))
    return out.withColumn(numeric, number).select(*entity, metric, text, numeric, at, sequence)


def wide(df: DataFrame, keys: Sequence[str], metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long metrics as columns; the names are given, so no pass over the data looks for them."""
    return df.groupBy(*keys).pivot(metric, list(names)).agg(F.first(value, ignorenulls=True))


def file_state(df: DataFrame, keys: Sequence[str], metric: str, order: Sequence[Column], failed: Column) -> DataFrame:
    """Roll-up of a file's newest metrics: FAILED if one says so, else COMPLETE. Files without metrics have no row and are pending."""
    newest = latest(df, [*keys, metric], order)
    return newest.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(failed, F.lit(False))), "FAILED").otherwise("COMPLETE").alias("state"))


def entity_state(df: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Any FAILED file: FAILED; else any PENDING: RUNNING; else COMPLETE."""
    return df.groupBy(*keys).agg(F.when(F.bool_or(F.col(state) == "FAILED"), "FAILED").when(F.bool_or(F.col(state) == "PENDING"), "RUNNING").otherwise("COMPLETE").alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of both; of equal keys the new one, and of several new ones the first in ``order``."""
    fresh = latest(new, keys, order) if order else new
    return old.join(fresh, list(keys), "left_anti").unionByName(fresh)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; of equal keys the old one."""
    return old.unionByName(new.join(old, list(keys), "left_anti").dropDuplicates(list(keys)))


def latest_completed(jobs: DataFrame, keys: Sequence[str], *, sequence: str = "job_id", status: str = "status") -> DataFrame:
    """The newest completed job of each key."""
    return current(jobs.where(F.col(status) == "completed"), keys, sequence)


def max_change(changes: DataFrame, keys: Sequence[str], sequence: str = "change_id") -> DataFrame:
    return changes.groupBy(*keys).agg(F.coalesce(F.max(sequence), F.lit(0)).alias(sequence))


def next_number(ids: Column, prefix: str) -> Column:
    """Largest numeric suffix of ids with a prefix, as an aggregate."""
    return F.coalesce(F.max(F.regexp_extract(ids, f"^{prefix}([0-9]+)$", 1).try_cast("long")), F.lit(0).cast("long"))
