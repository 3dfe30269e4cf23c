"""Tables written between the stages of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset on one machine, a folder of our own.

    On a cluster the setting is needed: in a folder of its own each executor would keep its part of a table to itself.
    """
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="inkstone-")
    return _own[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """Run df once, write it as Parquet into the shared folder and return the written table.

    Cuts the lineage: a lost executor costs only a later stage, and a table used twice is made once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstone-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables that written() made in this application."""
    jvm, context = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkstone-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
