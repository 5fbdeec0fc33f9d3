"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that follow from the plans themselves, not from a machine.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans hold thousands of column nodes; recording a call site for each slows their making.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pivots over groups, measures and stages have more than the default of 100 columns.
    "spark.sql.codegen.maxFields": "600",
}


def local_session(cores: int | str = 8, memory: str = "12g", name: str = "expogrid") -> SparkSession:
    """Single-JVM session for tests and the local bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
