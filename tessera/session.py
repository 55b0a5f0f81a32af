"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic and UTC are part of the operators' semantics; adaptive execution splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
