"""One place for the session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "pixelframe", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches: UTC, AQE on, few shuffle partitions.

    On a cluster the session comes from spark-submit; only the time zone (UTC) must then be kept.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
