"""Session defaults. On a cluster the submitted configuration wins; this only fills what is unset."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "tessera", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: few shuffle partitions, UTC, AQE on."""
    merged = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
