"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins from measured sizes, split hot join partitions, merge tiny ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Streaming state on disk, so it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "forecourt", local_cores: int | None = None) -> SparkSession:
    """Session with the settings above; ``local_cores`` is for tests and the bench only.

    On a cluster the master, memory and shuffle partition count come from spark-submit.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if local_cores:
        builder = (
            builder.master(f"local[{local_cores}]")
            .config("spark.sql.shuffle.partitions", str(local_cores))
            .config("spark.driver.memory", "8g")
        )
    return builder.getOrCreate()
