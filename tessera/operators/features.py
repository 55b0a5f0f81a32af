"""Queries over feature tables (GFF3, GTF): statistics, structure checks, BED rows, longest transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import percent

COMPACT = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "id", "parent", "gene_id", "transcript_id"]
FULL = [*COMPACT, "attributes", "line_number"]


def feature_rows(features: DataFrame, *, limit: int = 0, attributes: bool = False, ties: Sequence[Column] = ()) -> DataFrame:
    """Rows in file order, compact or with attributes. ``ties`` order rows of the same line number; without them a limit takes any of these."""
    out = features.orderBy(*(["file_id"] if "file_id" in features.columns else []), "line_number", *ties)
    return (out.limit(limit) if limit else out).select(*(FULL if attributes else COMPACT))


def feature_stats(features: DataFrame, *, type_col: str = "type", source_col: str = "source", seqid_col: str = "seqid", start: str = "start", end: str = "end") -> dict[str, DataFrame]:
    """Counts by type, by source, and by sequence with least start and greatest end; sorted."""
    count = F.count(F.lit(1)).alias("n")
    return {
        "type": features.groupBy(type_col).agg(count).orderBy(F.col(type_col).asc_nulls_first()),
        "source": features.groupBy(source_col).agg(count).orderBy(F.col(source_col).asc_nulls_first()),
        "seqid": features.groupBy(seqid_col).agg(count, F.min(start).alias("min_start"), F.max(end).alias("max_end")).orderBy(F.col(seqid_col).asc_nulls_first()),
    }


def structure_stats(features: DataFrame, keys: Sequence[str] = (), lengths: DataFrame | None = None) -> DataFrame:
    """Structural metrics of parsed rows by group.

    ``features`` has type, seqid, start, end (null where they are no integers),
    phase, id, parent (``,``-separated). Rows with bad coordinates count as
    coordinate errors, and once more if they end beyond their sequence. CDS figures
    come from rows with parseable coordinates.
    """
    f = features
    ok = F.col("start").isNotNull() & F.col("end").isNotNull()
    bad = ~ok | (F.col("start") < 1) | (F.col("end") < F.col("start"))
    if lengths is not None:
        f = f.join(lengths.select(F.col("seqid").alias("__s"), F.col("length").alias("__l")), F.col("seqid") == F.col("__s"), "left")
        beyond, unknown = ok & F.coalesce(F.col("end") > F.col("__l"), F.lit(False)), ok & F.col("__l").isNull()
    else:
        beyond = unknown = F.lit(False)
    cds = ok & (F.col("type") == "CDS")
    size = F.col("end") - F.col("start") + 1
    of = lambda *t: F.count_if(F.col("type").isin(*t))
    stats = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("feature_count"), of("gene").alias("gene_count"), of("mRNA", "transcript").alias("mrna_count"), F.count_if(cds).alias("cds_count"), of("exon").alias("exon_count"), F.count_distinct("type").alias("feature_type_count"), F.count_distinct("seqid").alias("seqid_count"),
        F.count_if(unknown).alias("seqid_mismatch_count"), F.count_if(beyond).alias("end_beyond_sequence_count"), (F.count_if(bad) + F.count_if(beyond)).alias("coordinate_error_count"), F.count_if(F.col("id").isNull()).alias("missing_id_count"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_id_count"), percent(F.count_if(cds & (size % 3 == 0)), F.count_if(cds)).alias("cds_length_multiple3_percent"), percent(F.count_if(cds & (F.col("phase") == "0")), F.count_if(cds)).alias("cds_phase0_percent"),
        F.count_if(cds & (size % 3 != 0)).alias("cds_not_multiple3_count"),
    )
    named = features.where("id IS NOT NULL").select(*keys, F.col("id").alias("__p")).distinct()
    refs = features.where("parent IS NOT NULL").select(*keys, F.explode(F.split("parent", ",")).alias("__p")).where("__p <> ''")
    dangling = refs.join(named, [*keys, "__p"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_parent_count"))
    out = stats.join(dangling, list(keys), "left") if keys else stats.crossJoin(dangling)
    return out.fillna(0, ["missing_parent_count"])


def bed_row(name: Column) -> list[Column]:
    """BED6 of a feature: 0-based start, score 0 and strand ``.`` where there is none."""
    return [F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("chrom_start"), F.col("end").alias("chrom_end"), name.alias("name"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), F.coalesce("strand", F.lit(".")).alias("strand")]


def bed_rows(features: DataFrame, *, limit: int = 0) -> DataFrame:
    """BED rows in file order, named by id or else type."""
    out = features.orderBy("line_number")
    return (out.limit(limit) if limit else out).select(*bed_row(F.coalesce("id", "type")))


def sorted_bed(rows: DataFrame) -> DataFrame:
    return rows.orderBy("chrom", "chrom_start", "chrom_end", "name")


def heaviest_child(children: DataFrame, parts: DataFrame | None, *, child: str, group: str, part_parent: str = "parent", weight: Column, order: Column | None = None) -> DataFrame:
    """For each group the child with the largest summed weight of its parts (0 without parts; ties: smaller id).

    Without ``parts`` the weight is the child's own. Returns child's columns and weight.
    """
    if parts is None:
        weighed = children.withColumn("weight", weight)
    else:
        sums = parts.where(F.col(part_parent).isNotNull() & (F.col(part_parent).cast("string") != "")).groupBy(F.col(part_parent).alias("__p")).agg(F.sum(weight).alias("weight"))
        weighed = children.join(sums, F.col(child) == F.col("__p"), "left").drop("__p").withColumn("weight", F.coalesce("weight", F.lit(0)))
    w = Window.partitionBy(group).orderBy(F.col("weight").desc(), F.col(child) if order is None else order)
    return weighed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def longest_transcripts(features: DataFrame, dialect: str, *, measure: str = "CDS") -> DataFrame:
    """One BED row per gene, named by its longest transcript: by summed CDS length or by span.

    Sources without transcripts rank single CDS rows under their gene instead. The
    first row of a gene id counts.
    """
    key = "id" if dialect == "gff3" else "gene_id"
    genes = features.where(F.col("type") == "gene").withColumn("__g", F.coalesce(*([F.col("id"), F.col("gene_id")] if dialect == "gff3" else [F.col("gene_id"), F.col("id")]))).where("__g IS NOT NULL")
    w = Window.partitionBy("__g").orderBy("line_number")
    genes = genes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("__g", *[F.col(c).alias(f"g_{c}") for c in ("seqid", "start", "end", "score", "strand")])
    ref = F.col("parent") if key == "id" else F.coalesce("gene_id", "parent")
    transcripts = features.where(F.col("type").isin("mRNA", "transcript")).withColumn("__ref", ref).where("id IS NOT NULL AND __ref IS NOT NULL")
    size = F.col("end") - F.col("start") + 1
    cds = features.where(F.col("type") == "CDS")
    name = F.col("id") if dialect == "gff3" else F.coalesce("transcript_id", "id")
    single = cds.withColumn("__ref", F.col("parent") if dialect == "gff3" else F.col("gene_id")).withColumn("__name", name).where("__ref IS NOT NULL AND __name IS NOT NULL")
    # Only where there is no transcript at all do single CDS rows stand in; told when the rows are read.
    some = transcripts.agg(F.count(F.lit(1)).alias("__n"))
    single = heaviest_child(single, None, child="__name", group="__ref", weight=size).where("weight > 0").crossJoin(some).where("__n = 0").select("__ref", "__name")
    best = heaviest_child(transcripts, cds if measure == "CDS" else None, child="id", group="__ref", weight=size).select("__ref", F.col("id").alias("__name")).unionByName(single)
    joined = best.join(genes, F.col("__ref") == F.col("__g"))
    flat = joined.select(*[F.col(f"g_{c}").alias(c) for c in ("seqid", "start", "end", "score", "strand")], "__name")
    return sorted_bed(flat.select(*bed_row(F.col("__name"))))
