"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has that remainder (null id: no)."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % modulus) == remainder, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, *, modulus: int, remainder: int, rows: int, longest: int, seed: int = 11) -> tuple[DataFrame, int, int]:
    """(doc_id, text, y): at most ``rows`` documents of each class outside the held-out fold; and how many labels it holds that are 1, and in all.

    Chosen by a hash of the id among the labelled documents that ``docs`` holds, so
    reruns agree; texts of more than ``longest`` characters are not sampled, so whoever
    fits on it gets at most 2 * rows * longest characters. Null labels, ids and texts are
    not sampled, and a repeated id once.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]
    # Which documents can be had is settled on their ids alone; only the chosen texts are read after that.
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    there = ids.join(usable.select("doc_id"), "doc_id", "left_semi")
    chosen = there.where("y = 1").orderBy(*order).limit(rows).unionByName(there.where("y = 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids, so they may go to all tasks.
    found = usable.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    ones, every = ids.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    return found.select("doc_id", "text", "y"), ones, every


def warn_of_missing(label: str, classes: int, ones: int, every: int, longest: int) -> None:
    """Report labels of which no document can be sampled, as the model of a fit's caller is constant then; ``classes`` is how many the sample has."""
    if every and classes < min(2, (ones > 0) + (ones < every)):
        warnings.warn(f"no labelled text of one of the classes of {label} is there and has at most {longest} characters", UserWarning, stacklevel=3)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, modulus: int, remainder: int, rows: int, longest: int, seed: int = 11) -> tuple[list[str], list[int], float]:
    """Texts and labels of :func:`sample_rows` on the driver, and the share of label 1 outside the held-out fold; a class without any is reported by a warning."""
    found, ones, every = sample_rows(docs, labels, label, modulus=modulus, remainder=remainder, rows=rows, longest=longest, seed=seed)
    got = found.orderBy("doc_id").collect()
    warn_of_missing(label, len({r["y"] for r in got}), ones, every, longest)
    return [r["text"] for r in got], [r["y"] for r in got], (ones + 1) / (every + 2)
