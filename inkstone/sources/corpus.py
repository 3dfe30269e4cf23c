"""Sources: corpus tables, slices, JSON documents with a default, and recreation files."""

from __future__ import annotations

import glob
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkstone.functions import text as T

TEST_CONFIG = "cross_topic_1"
REFERENCE_CONFIGS = ("cross_genre_2", "cross_genre_3", "cross_genre_4")
SPLITS = ("train", "validation", "test")
RECREATION = "rec_id long, article_id string, source_article_id string, author string, title string, body string, model_slug string, model_alias string"


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt out to all of them; a larger one as it stands.

    Filters and unused columns still go to the scan. Texts take far more time than their shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def load_config(spark: SparkSession, folder: str, config: str) -> DataFrame:
    """A configuration kept as `folder/config/split.parquet`, with its name and its splits' as columns; only splits that are there are read.

    FileNotFoundError if there are none.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for split in SPLITS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{config}/{split}.parquet")
        if path.getFileSystem(conf).exists(path):
            parts.append(spark.read.parquet(path.toString()).withColumn("config", F.lit(config)).withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"{folder}/{config} has no splits")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def articles(df: DataFrame, authors: list[str] | None = None, configs: tuple | None = None) -> DataFrame:
    """One row an article_id: author (by key), text, config, split, article_id, topic, lang.

    Redelivered rows are one article: the least row by author, text, config, split, topic and lang is it. Blank texts and authors that can't be named
    are left out; authors restricts to a set of names, configs to slices.
    """
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    clean = df.select(
        "article_id", T.name_key("author").alias("author"), F.trim(T.text_of(df, "text")).alias("text"), F.trim("config").alias("config"),
        F.lower(F.trim("split")).alias("split"), T.first_filled(F.lower(F.trim(has("topic")))).alias("topic"), T.first_filled(F.lower(F.trim(has("lang")))).alias("lang"),
    )
    clean = clean.where(F.col("article_id").isNotNull() & F.col("author").isNotNull() & F.col("text").rlike(T.INK))
    if configs is not None:
        clean = clean.where(F.col("config").isin(*configs))
    if authors is not None:
        clean = clean.where(F.col("author").isin(*authors))
    cols = ("author", "text", "config", "split", "topic", "lang")
    row = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in cols))  # nulls come first in every engine
    one = clean.groupBy("article_id").agg(F.min(row).alias("r"))
    return one.select("article_id", *(F.when(F.col(f"r.{c}") != "", F.col(f"r.{c}")).alias(c) for c in cols))


def built_id(config, split, author, row) -> Column:
    """`config/split/author/row`, the key of an article."""
    return F.concat_ws("/", config, split, author, row)


def numbered_ids(df: DataFrame) -> DataFrame:
    """df with article_id filled and built: whether it had to be, for a null, empty or 0 key.

    A built key ends in the row's place from 0 among those of its config, split and author, in the order of a hash of
    the text. Only rows without a key are numbered; rows of the same text share a place.
    """
    has = F.coalesce(~F.trim("article_id").isin("", "0"), F.lit(False))
    place = ["config", "split", "author"]
    rest = df.where(~has).withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    numbers = rest.select(*place, "h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("h")) - 1)
    numbers = numbers.select("_n", *(F.col(c).alias(f"_{c}") for c in (*place, "h")))
    key = built_id("config", "split", "author", F.col("_n").cast("string"))
    both = rest.join(numbers, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*place, "h")])
    built = both.select(*(F.col(c) if c != "article_id" else key.alias(c) for c in df.columns), F.lit(True).alias("built"))
    return df.where(has).withColumn("built", F.lit(False)).unionByName(built)


def test_slice(spark: SparkSession, folder: str) -> DataFrame:
    return articles(table(spark, folder, "essays"), configs=(TEST_CONFIG,))


def reference_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The reference configurations, united. An article that recurs under another one has another key and stays; redelivered rows are one."""
    return articles(table(spark, folder, "reference_corpus"), configs=REFERENCE_CONFIGS)


def load_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document (one object or a list), or an empty table of the schema if there is none."""
    if not glob.glob(path) and "://" not in path:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)


def find_recreations(folder: str) -> str | None:
    """The first recreation file of a folder by name."""
    found = sorted(glob.glob(os.path.join(folder, "*.json"))) if os.path.isdir(folder) else []
    return found[0] if found else None
