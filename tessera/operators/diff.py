"""Differences between tables: import previews, set equality, conflicts, replay-safe appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_preview(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, action, changed): insert, update or unchanged for each new row; ``changed`` names the columns that differ.

    Only the columns supplied count; a null clears the value. Rows that only the old
    table has are not listed.
    """
    a = old.select(F.col(key).alias("__k"), F.lit(True).alias("__had"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = new.join(a, F.col(key) == F.col("__k"), "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    action = F.when(F.col("__had").isNull(), "insert").when(F.size(changed) > 0, "update").otherwise("unchanged")
    return both.select(key, action.alias("action"), F.when(action == "update", F.array_join(changed, ",")).otherwise(F.lit("")).alias("changed"))


def apply_import(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], on_conflict: str = "error") -> DataFrame:
    """The table after an import: existing keys are an error, skipped or updated."""
    if on_conflict not in ("error", "skip", "update"):
        raise ValueError(on_conflict)
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = old.join(n, F.col(key) == F.col("__k"), "full")
    had, has = F.col(key).isNotNull(), F.col("__k").isNotNull()
    out = []
    for c in old.columns:
        if c == key:
            keep = F.coalesce(key, "__k")
            if on_conflict == "error":
                keep = F.when(had & has, F.raise_error(F.concat(F.lit("exists: "), F.col(key).cast("string"))).cast(old.schema[key].dataType)).otherwise(keep)
            out.append(keep.alias(c))
        elif c in columns:
            new_value = (~had) | has if on_conflict == "update" else ~had
            out.append(F.when(new_value, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often; empty differences both ways."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a).isEmpty()


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how many more times ``a`` has them than ``b`` (negative: fewer); equal ones are left out. One aggregation instead of two set differences."""
    cols = a.columns
    both = a.withColumn("__d", F.lit(1)).unionByName(b.select(*cols).withColumn("__d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("__d").alias("difference")).where("difference <> 0")


def conflicts(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys with more than one content; nulls are contents too."""
    value = F.struct(*content)
    return rows.groupBy(*keys).agg(F.count_distinct(F.to_json(value, {"ignoreNullFields": "false"})).alias("contents")).where("contents > 1")


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def append_once(ledger: DataFrame, events: DataFrame, key: str, content: str) -> DataFrame:
    """Events to append: known ids with the same content are dropped, with another content an error on reading; repeated ones count once."""
    fresh = events.dropDuplicates([key, content])
    known = ledger.select(F.col(key).alias("__k"), F.col(content).alias("__c"))
    both = fresh.join(known, F.col(key) == F.col("__k"), "left")
    clash = F.col("__c").isNotNull() & (F.col("__c") != F.col(content))
    out = both.withColumn(key, F.when(clash, F.raise_error(F.concat(F.lit("conflict: "), F.col(key).cast("string"))).cast(events.schema[key].dataType)).otherwise(F.col(key)))
    return out.where(F.col("__k").isNull() | clash).select(*events.columns)


