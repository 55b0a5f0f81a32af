"""GFF3 and GTF feature tables from numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import percent_decode

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_id", "seqid", "source", "type")]
    + [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("strand", "phase", "id", "parent", "gene_id", "transcript_id", "attributes")]
    + [T.StructField("line_number", T.LongType())]
)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _decoded(value: Column) -> Column:
    return F.when(F.instr(value, "%") > 0, percent_decode(value)).otherwise(value)


def _pairs(text: Column, dialect: str) -> Column:
    """Array of (k, v) of an attribute column, in order; keys are decoded, GFF3 values not yet."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: (p != "") & (p != "."))
    eq = lambda p: F.instr(p, "=")

    def pair(p: Column) -> Column:
        at = eq(p)
        plain = F.struct(F.trim(F.substring(p, F.lit(1), at - 1)).alias("k"), F.trim(F.substring(p, at + 1, F.length(p))).alias("v"))
        if dialect == "gff3":
            return F.struct(_decoded(plain["k"]).alias("k"), plain["v"].alias("v"))
        quoted = F.struct(F.regexp_extract(p, r'^(\S+)\s+"?([^"]*)"?$', 1).alias("k"), F.regexp_extract(p, r'^(\S+)\s+"?([^"]*)"?$', 2).alias("v"))
        spaced = p.rlike(r'^[^\s=]+\s')
        return F.struct(F.when(spaced, quoted["k"]).otherwise(plain["k"]).alias("k"), F.when(spaced, quoted["v"]).otherwise(F.trim(F.translate(plain["v"], '"', ""))).alias("v"))

    usable = F.filter(parts, lambda p: (eq(p) > 1) | p.rlike(r"^\S+\s")) if dialect == "gtf" else F.filter(parts, lambda p: eq(p) > 0)
    return F.transform(usable, pair)


def attribute_map(text: Column, dialect: str = "gff3") -> Column:
    """Map of an attribute column; of a repeated key the last value; ``.`` and empty texts give an empty map.

    GFF3 ``key=value`` is percent-decoded. GTF ``key "value"`` is not; ``key=value`` is
    taken there as well.
    """
    value = _decoded if dialect == "gff3" else lambda v: v
    # map_from_entries rejects repeated keys, so only each key's last entry goes in.
    last = lambda ps: F.filter(ps, lambda x, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda y: y["k"] == x["k"]))
    return _bound(_pairs(text, dialect), lambda ps: F.map_from_entries(F.transform(last(ps), lambda x: F.struct(x["k"], value(x["v"])))))


def attributes(text: Column, names: Sequence[str], dialect: str = "gff3") -> Column:
    """Struct with the last value of each name (null: none, or empty), without a map of all others."""
    value = _decoded if dialect == "gff3" else lambda v: v
    pick = lambda ps, n: F.nullif(value(F.try_element_at(F.filter(ps, lambda p: p["k"] == n), F.lit(-1))["v"]), F.lit("")).alias(n)
    return _bound(_pairs(text, dialect), lambda ps: F.struct(*[pick(ps, n) for n in names]))


def feature_lines(lines: DataFrame) -> DataFrame:
    """Lines before the exact line ``##FASTA``, without comments and blank ones."""
    stop = lines.where("line = '##FASTA'").groupBy("path").agg(F.min("line_no").alias("__stop"))
    kept = lines.join(stop, "path", "left").where("__stop IS NULL OR line_no < __stop").drop("__stop")
    return kept.where(~F.col("line").startswith("#") & (F.trim("line") != ""))


def parse_features(lines: DataFrame, dialect: str = "gff3", *, strict: bool = True) -> DataFrame:
    """Typed feature rows. With ``strict`` a malformed row is an error on reading that names the line; otherwise its coordinates are null."""
    f = F.split("line", "\t")
    at = lambda k: F.get(f, F.lit(k))
    clean = lambda c: F.when(c.isin("", "."), None).otherwise(c)
    start, end = at(3).try_cast("long"), at(4).try_cast("long")
    bad = F.when(F.size(f) != 9, "not nine columns").when(start.isNull() | end.isNull(), "coordinates are no integers").when(start < 1, "start is below 1").when(end < start, "end is before start").when((at(5) != ".") & at(5).try_cast("double").isNull(), "score is no number")
    names = attributes(at(8), ("ID", "Parent", "gene_id", "transcript_id"), dialect)
    rows = feature_lines(lines)
    if strict:
        where = F.concat(bad, F.lit(" at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
        kind = F.when(bad.isNotNull(), F.raise_error(where).cast("string")).otherwise(clean(at(2)))
    else:
        rows, kind = rows.where(F.size(f) == 9), clean(at(2))
    rows = rows.withColumn("__a", names)
    value = lambda k: F.col("__a")[k]
    if dialect == "gff3":
        ident, parent, gene, transcript = value("ID"), value("Parent"), value("gene_id"), value("transcript_id")
    else:
        gene, transcript = value("gene_id"), value("transcript_id")
        tx = kind.isin("transcript", "mRNA")
        ident = F.when(kind == "gene", gene).when(tx, transcript)
        parent = F.when(kind == "gene", None).when(tx, gene).otherwise(transcript)
    out = rows.select(
        F.col("path").alias("file_id"), clean(at(0)).alias("seqid"), clean(at(1)).alias("source"), kind.alias("type"), start.alias("start"), end.alias("end"), F.nullif(at(5), F.lit(".")).try_cast("double").alias("score"), clean(at(6)).alias("strand"), clean(at(7)).alias("phase"),
        ident.alias("id"), parent.alias("parent"), gene.alias("gene_id"), transcript.alias("transcript_id"), F.nullif(at(8), F.lit("")).alias("attributes"), F.col("line_no").alias("line_number"),
    )
    return out


def write_index(features: DataFrame, path: str, *, partitions: int | None = None) -> None:
    """Feature index: ranges of (seqid, start), so row-group statistics prune region queries; ``file_id`` is a partition column."""
    ranged = features.repartitionByRange(partitions, "file_id", "seqid", "start") if partitions else features.repartitionByRange("file_id", "seqid", "start")
    ranged.sortWithinPartitions("file_id", "seqid", "start", "line_number").write.mode("overwrite").partitionBy("file_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def ensure_index(spark: SparkSession, path: str, identity: str, build) -> DataFrame:
    """The index at ``path`` if it was built for this identity, else ``build()`` written anew; the marker is written last."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_identity-{identity}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        write_index(build(), path)
        fs.create(hadoop, True).close()
    return read_index(spark, path)
