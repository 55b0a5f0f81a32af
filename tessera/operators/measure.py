"""Measurements as rows of the long metric store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import metric_value
from tessera.operators import composition, features
from tessera.operators.latest import wide
from tessera.operators.rules import evaluate
from tessera.sources import features as feature_source
from tessera.sources import sequences

# Units by the end of a metric's name; others are counts.
UNITS = (("_percent", "percent"), ("_length", "bp"), ("_n50", "bp"), ("_n90", "bp"), ("_bases", "bp"), ("_mean", "bp"), ("_min", "bp"), ("_max", "bp"))
# The metrics that a sequence file which is no assembly keeps.
SEQUENCE_METRICS = ("sequence_count", "total_length", "empty_sequence_count", "duplicate_sequence_id_count")


def unit(name: str) -> str:
    return next((u for end, u in UNITS if name.endswith(end)), "count")


def long_metrics(stats: DataFrame, keys: Sequence[str], stage: str, names: Sequence[str] | None = None, constants: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, qc_stage, metric_name, metric_value, metric_numeric, metric_unit) of wide statistics; null metrics are dropped."""
    columns = {c: F.col(c) for c in (names or [c for c in stats.columns if c not in keys])} | dict(constants or {})
    kinds = dict(stats.dtypes)
    kind = lambda c: {"boolean": "boolean", "string": "string"}.get(kinds.get(c, "double"), "number")
    items = F.array(*[F.struct(F.lit(c).alias("n"), metric_value(v, kind(c)).alias("v"), F.lit(unit(c)).alias("u")) for c, v in columns.items()])
    rows = stats.select(*keys, F.explode(items).alias("m"))
    out = rows.select(*keys, F.lit(stage).alias("qc_stage"), F.col("m.n").alias("metric_name"), "m.v.metric_value", "m.v.metric_numeric", F.col("m.u").alias("metric_unit"))
    return out.where("metric_value IS NOT NULL")


def measure(lines: DataFrame, file_format: str, *, role: str = "assembly", sample: int = 1_000_000, offset: str | int = 33, lengths: DataFrame | None = None) -> DataFrame:
    """Metrics of all files of one format in one job: fasta, fastq, gff3 or protein."""
    if file_format == "fasta":
        stats = composition.assembly_stats(sequences.fasta_records(lines), ["path"])
        return long_metrics(stats, ["path"], role, None if role == "assembly" else SEQUENCE_METRICS, {"parseable": F.lit(1.0)})
    if file_format == "fastq":
        return long_metrics(composition.read_stats(sequences.fastq_records(lines), ["path"], sample=sample, offset=offset), ["path"], "reads", None, {"parseable": F.lit(1.0)})
    if file_format == "gff3":
        rows = feature_source.parse_features(lines, strict=False).withColumnRenamed("file_id", "path")
        return long_metrics(features.structure_stats(rows, ["path"], lengths), ["path"], "annotation", None, {"parseable": F.lit(1.0)})
    if file_format == "protein":
        return long_metrics(composition.protein_stats(sequences.fasta_records(lines), ["path"]), ["path"], "annotation", None, {"parseable": F.lit(1.0)})
    raise ValueError(f"unknown format {file_format}")


def run(lines: DataFrame, file_format: str, profile: Mapping, names: Sequence[str], **kind) -> DataFrame:
    """Measure all files of one format and judge each by a profile, in one plan: (path, metrics by name, decision, reason_codes)."""
    found = wide(measure(lines, file_format, **kind), ["path"], "metric_name", "metric_value", names)
    return evaluate(found, profile, {n: F.col(n) for n in names})


def paired_counts(files: DataFrame, counts: DataFrame, *, entity: Sequence[str] = ("entity_type", "entity_id"), roles: tuple[str, str] = ("reads_1", "reads_2")) -> DataFrame:
    """(entity, paired_read_count_match): 1 if both mates' files have as many reads, for entities that have both."""
    n = files.where(F.col("file_role").isin(*roles)).join(counts.select("file_id", "records"), "file_id")
    both = n.groupBy(*entity).agg(*[F.max(F.when(F.col("file_role") == r, F.col("records"))).alias(f"__{k}") for k, r in enumerate(roles)])
    return both.where("__0 IS NOT NULL AND __1 IS NOT NULL").select(*entity, (F.col("__0") == F.col("__1")).cast("int").alias("paired_read_count_match"))
