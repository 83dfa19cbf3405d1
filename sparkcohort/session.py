"""Session factory for local runs; on a cluster the caller passes its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "sparkcohort", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with adaptive execution on and times in UTC, for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
