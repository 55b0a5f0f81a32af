"""Numbered lines of text files, plain or gzip-compressed.

LF, CRLF and lone CR all end a line; a last line needs no end. Files are read line by
line by the text source: plain ones in splits by many tasks, compressed ones, which
can't be split, as a stream in one, so neither a file nor its text is ever one value.
A line is at most 2 GB. A line's number is its place in its split plus the lines of the
splits before; counting them reads the files a second time, without their texts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no from 1, line) of each file."""
    # Numbers of one task go up by one from line to line, and a split is read by one task.
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block")) - F.col("lines")
    splits = splits.select("path", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def from_rows(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The same from a table of whole texts."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
    lines = df.where(F.length(text) > 0).select(F.col(path).alias("path"), F.posexplode(F.split(body, "\n")).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def cuts(lines: DataFrame, spans: int = 512) -> list[tuple[str, int]]:
    """Places (path, line_no) that part the lines, in their order, into ``spans`` of about equal size; none for few lines.

    As for the ranges of a sort, keys with the smallest hashes, 16 a span, say where
    to cut. They decide how even spans are, not which lines are read.
    """
    most = 16 * spans
    keys = lines.where("path IS NOT NULL AND line_no IS NOT NULL").select("path", "line_no").orderBy(F.xxhash64("path", "line_no")).limit(most)
    # The aggregate lets a task merge what the others found; collected at once, the driver would get as many keys from each.
    keys = keys.agg(F.collect_list(F.struct("path", "line_no")).alias("keys")).first()["keys"]
    return sorted(set(sorted((k["path"], k["line_no"]) for k in keys)[16::16])) if len(keys) == most else []


def spanned(lines: DataFrame, places: Sequence[tuple[str, int]]) -> DataFrame:
    """Lines with ``span``: how many of the sorted places are at or before the line."""
    out = lines.withColumn("span", F.lit(0))
    if not places:
        return out
    # One literal each, which the optimiser makes an array once; thousands of literals would take it seconds.
    paths, numbers = (F.from_json(F.lit(json.dumps(v)), kind) for v, kind in zip(zip(*places), ("array<string>", "array<long>")))
    step = 1 << (len(places).bit_length() - 1)
    while step:
        # Beyond the last place it is null, and not passed.
        path, number = F.get(paths, F.col("span") + (step - 1)), F.get(numbers, F.col("span") + (step - 1))
        passed = (F.col("path") > path) | ((F.col("path") == path) & (F.col("line_no") >= number))
        out = out.withColumn("span", F.when(passed, F.col("span") + step).otherwise(F.col("span")))
        step >>= 1
    return out


def carried(lines: DataFrame, places: Sequence[tuple[str, int]], marks: Sequence[Column]) -> DataFrame:
    """Lines with ``span`` and ``copy``: a span that starts inside a file gets copies of the latest line before it of each mark.

    So what marks set is known in each span by itself: a window over (path, span)
    in the order of line_no gives what one over the path does. The driver holds
    places and the numbers of the lines to copy, a few for each place.
    """
    out = spanned(lines, places).withColumn("copy", F.lit(False))
    if not places:
        return out
    latest = out.where(F.col("path").isin(sorted({p for p, _ in places}))).groupBy("path", "span").agg(*[F.max(F.when(m, F.col("line_no"))) for m in marks])
    found, state, wanted = {}, {}, set()
    for path, span, *at in latest.collect():
        found.setdefault(span, []).append((path, at))
    for span, (path, _) in enumerate(places, 1):
        for p, at in found.get(span - 1, ()):
            state[p] = [old if new is None else new for old, new in zip(state.get(p, at), at)]
        wanted |= {(path, n, span) for n in state.get(path, ()) if n is not None}
    if not wanted:
        return out
    # At most one row for each place and mark; their numbers alone reach the scan.
    copies = lines.where(F.col("line_no").isin(sorted({n for _, n, _ in wanted})))
    wanted = F.broadcast(lines.sparkSession.createDataFrame(sorted(wanted), "path string, line_no long, span int"))
    return out.unionByName(copies.join(wanted, ["path", "line_no"]).withColumn("copy", F.lit(True)))
