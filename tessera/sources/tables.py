"""Typed tables from TSV, CSV, XLSX and JSON files; schemas are always given, never inferred."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def tsv(lines: DataFrame, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Rows of TSV files from numbered lines, with the given columns taken by name from each file's header.

    Blank and ``#`` lines and a byte-order mark are skipped, quotes are plain text; one
    empty header at the end is allowed. A missing required column and a ragged row
    are errors on reading.
    """
    body = lines.withColumn("line", F.regexp_replace("line", "^﻿", "")).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    first = body.groupBy("path").agg(F.min_by("line", "line_no").alias("h"), F.min("line_no").alias("h_no"))
    head = F.transform(F.split("h", "\t"), lambda c: F.trim(c))
    rows = body.join(first, "path").where("line_no > h_no").withColumn("h", head).withColumn("f", F.split("line", "\t"))
    n = F.size("h") - F.when(F.element_at("h", -1) == "", 1).otherwise(0)
    lacks = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: ~F.array_contains("h", c)) if required else F.array().cast("array<string>")
    bad = F.when(F.size(lacks) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacks, ","))).when((F.size("f") != F.size("h")) & (F.size("f") != n), "ragged row")
    where = F.concat(bad, F.lit(" at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    cell = lambda c: F.get("f", F.array_position("h", F.lit(c)).cast("int") - 1)
    checked = F.when(bad.isNotNull(), F.raise_error(where).cast("string")).otherwise(F.col("path"))
    return rows.select(checked.alias("path"), "line_no", *[F.when(F.array_contains("h", c), cell(c)).alias(c) for c in columns])


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header; columns are checked against the header, not taken by place."""
    return spark.read.csv(path, schema=_texts(columns), header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"')


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Built-in number formats that are dates.
_DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def _sheet(data: bytes) -> list[list[str | None]]:
    from datetime import datetime, timedelta

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            for xf in styles.find(f"{_NS}cellXfs") if styles.find(f"{_NS}cellXfs") is not None else []:
                k = int(xf.get("numFmtId", "0"))
                dates.append(k in _DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "").lower()))))
        pr = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
        epoch = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        out = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    style = int(c.get("s", "0"))
                    if kind == "s":
                        cells[at] = shared[int(v.text)]
                    elif kind == "b":
                        cells[at] = "true" if v.text == "1" else "false"
                    elif kind == "n" and style < len(dates) and dates[style]:
                        moment = epoch + timedelta(days=float(v.text))
                        cells[at] = moment.date().isoformat() if float(v.text) == int(float(v.text)) else moment.isoformat(timespec="seconds")
                    else:
                        cells[at] = v.text
            if any((x or "").strip() for x in cells.values()):
                out.append([cells.get(i) for i in range(max(cells) + 1)])
    return out


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook as texts: its first row names the columns, blank rows are dropped, dates are ISO texts.

    A workbook is one small file of at most a million rows, so it is read in one task.
    """
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = _sheet(bytes(data))
    names = [(c or "").strip() for c in rows[0]] if rows else []
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]], _texts(names))


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV or XLSX by suffix."""
    return xlsx(spark, path).select(*columns) if path.lower().endswith(".xlsx") else csv(spark, path, columns)


def assignments(rows: DataFrame, unit: str = "unit", seqid: str = "seqid") -> DataFrame:
    """(unit, seqids, repeated): sorted sequence ids of each unit, and how many exact repeats were dropped."""
    clean = rows.select(F.trim(unit).alias("unit"), F.element_at(F.split(F.trim(seqid), r"\s+"), 1).alias("seqid")).where("unit <> '' AND seqid <> ''")
    return clean.groupBy("unit").agg(F.sort_array(F.collect_set("seqid")).alias("seqids"), (F.count(F.lit(1)) - F.count_distinct("seqid")).alias("repeated"))
