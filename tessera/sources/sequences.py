"""FASTA and FASTQ records from numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import first_token


def _fail(test: Column, why: str, value: Column) -> Column:
    where = F.concat(F.lit(why + " at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    return F.when(test, F.raise_error(where).cast("string")).otherwise(value)


#: Lines of a file that are numbered together.
PART = 100_000


def _decodable(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", _fail(~F.is_valid_utf8("line"), "not UTF-8", F.col("line")))


def fasta_records(lines: DataFrame) -> DataFrame:
    """(path, record_no from 0, header, seqid, sequence).

    Blank lines are skipped. An empty header, sequence before a header, non-ASCII
    sequence and bytes that are no UTF-8 are errors on reading, with file and line.
    Headers are counted in parts of PART lines, so a file is not one task's.
    """
    body = _decodable(lines).withColumn("line", F.regexp_replace("line", r"\s+$", "")).where("line <> ''").withColumn("part", F.floor(F.col("line_no") / PART))
    head = F.col("line").startswith(">")
    w = Window.partitionBy("path", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = body.groupBy("path", "part").agg(F.count_if(head).alias("own"))
    heads = heads.select("path", "part", (F.sum("own").over(Window.partitionBy("path").orderBy("part")) - F.col("own")).alias("earlier"))
    numbered = body.withColumn("inside", F.sum(F.when(head, 1).otherwise(0)).over(w)).join(heads, ["path", "part"]).withColumn("record_no", F.col("earlier") + F.col("inside") - 1)
    text = _fail(~head & (F.col("record_no") < 0), "sequence before a header", F.col("line"))
    text = _fail(~head & ~F.col("line").rlike(r"^[\x00-\x7f]*$"), "sequence is not ASCII", text)
    text = _fail(head & (F.trim(F.substring("line", 2, 1 << 30)) == ""), "empty header", text)
    out = numbered.withColumn("t", text).groupBy("path", "record_no").agg(
        F.max(F.when(F.col("t").startswith(">"), F.trim(F.substring("t", 2, 1 << 30)))).alias("header"), F.sort_array(F.collect_list(F.when(~F.col("t").startswith(">"), F.struct("line_no", "t")))).alias("parts")
    )
    sequence = F.array_join(F.transform("parts", lambda p: F.regexp_replace(p["t"], r"\s+", "")), "")
    return out.select("path", F.col("record_no").cast("long").alias("record_no"), "header", first_token(F.col("header")).alias("seqid"), sequence.alias("sequence"))


def fasta(lines: DataFrame) -> DataFrame:
    return fasta_records(lines).select("path", "seqid", "sequence")


def fastq_records(lines: DataFrame) -> DataFrame:
    """(path, record_no from 0, header, seqid, sequence, quality); four strict lines each.

    ``@`` and ``+`` starts, equal lengths and quality bytes 33 to 126 are checked; a
    truncated or blank record and bytes that are no UTF-8 are errors on reading.
    """
    four = _decodable(lines).withColumn("record_no", F.floor((F.col("line_no") - 1) / 4).cast("long")).withColumn("k", ((F.col("line_no") - 1) % 4).cast("int"))
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    r = four.groupBy("path", "record_no").agg(part(0).alias("h"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality"), F.min("line_no").alias("line_no"))
    bad = F.when(F.col("h").isNull() | F.col("sequence").isNull() | F.col("plus").isNull() | F.col("quality").isNull(), "truncated record").when(F.trim("h") == "", "blank record")
    bad = bad.when(~F.col("h").startswith("@"), "header without @").when(~F.col("plus").startswith("+"), "separator without +").when(F.length("sequence") != F.length("quality"), "lengths differ")
    bad = bad.when(~F.col("quality").rlike(r"^[\x21-\x7e]*$"), "quality out of range")
    where = F.concat(bad, F.lit(" at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    header = F.when(bad.isNotNull(), F.raise_error(where).cast("string")).otherwise(F.substring("h", 2, 1 << 30))
    return r.select("path", "record_no", header.alias("header"), first_token(F.substring("h", 2, 1 << 30)).alias("seqid"), "sequence", "quality")


def record_count(records: DataFrame) -> DataFrame:
    return records.groupBy("path").agg(F.count("header").alias("records"))
