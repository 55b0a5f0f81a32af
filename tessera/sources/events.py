"""Event and metric payloads: JSON lines and TSV imports with ownership checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "schema_version string, event_id string, type string, metric string, artifact string"
METRIC_COLUMNS = ["entity_type", "entity_id", "qc_stage", "metric_name", "metric_value", "tool", "tool_version", "parameter_set"]


def events(lines: DataFrame) -> DataFrame:
    """(event_id, type, payload, content): events with the hash of their whole text; a line that is no event is an error on reading."""
    j = F.from_json("line", EVENT_SCHEMA)
    rows = lines.where(F.trim("line") != "").select("path", "line_no", j.alias("j"), F.sha2("line", 256).alias("content"))
    bad = F.col("j.event_id").isNull() | F.col("j.type").isNull()
    where = F.concat(F.lit("not an event at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    return rows.select(F.when(bad, F.raise_error(where).cast("string")).otherwise(F.col("j.event_id")).alias("event_id"), F.col("j.type").alias("type"), F.coalesce("j.metric", "j.artifact").alias("payload"), "content")


def owned_metrics(metrics: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics whose entity exists, the rest)."""
    keys = ["entity_type", "entity_id"]
    known = owners.select(*keys).distinct()
    return metrics.join(known, keys, "left_semi"), metrics.join(known, keys, "left_anti")
