"""A session tuned for this library; a cluster's own settings win."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session on one machine, for tests and benchmarks; tables between stages go to a new folder of its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("inkstone").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="inkstone-"))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
