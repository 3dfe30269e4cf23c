"""Sinks: reports as JSON, CSV and Markdown, and pair tables."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return None if isinstance(x, float) and math.isnan(x) else x


def save_json(spark, path: str, value: object, sort_keys: bool = False) -> None:
    """Write a small report so that a reader sees the old or the new one, never a part. NaN becomes null.

    The path is any that Spark's file systems know: the text goes beside it and is renamed onto it there.
    """
    save_text(spark, path, json.dumps(_plain(value), ensure_ascii=False, indent=2, allow_nan=False, sort_keys=sort_keys))


def save_text(spark, path: str, text: str) -> None:
    """Write a small text as a whole, as save_json does."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path if "://" in path else "file://" + os.path.abspath(path))
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.part")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    files = target.getFileSystem(conf)
    try:
        out = files.create(part, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, target, overwrite)
    finally:
        files.delete(part, False)


def load_json(spark, path: str, default: object = None) -> object:
    """What save_json wrote, or the default if there is nothing."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path if "://" in path else "file://" + os.path.abspath(path))
    if not target.getFileSystem(conf).exists(target):
        return default
    return json.loads("\n".join(r.value for r in spark.read.text(target.toString(), wholetext=True).collect()))  # one document


def fixed(x, places: int = 6, nan: str = "") -> Column:
    """A number with fixed places; null as '', NaN as nan."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull(), "").when(F.isnan(c), nan).otherwise(F.format_string(f"%.{places}f", c.cast("double")))


def write_csv(df: DataFrame, path: str, places: dict[str, int], nan: str = "nan") -> None:
    """CSV with fixed places for the named number columns, in the rows' order."""
    df.select(*(fixed(F.col(f"`{c}`"), places[c], nan).alias(c) if c in places else F.col(f"`{c}`") for c in df.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark, path: str, schema: str) -> DataFrame:
    """A folder of Parquet, or an empty table of the schema if there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_pairs(df: DataFrame, path: str, rows: int | None = None) -> None:
    """A pair table as Parquet; fails if it hasn't the expected rows."""
    df.write.mode("overwrite").parquet(path)
    if rows is not None and (n := df.sparkSession.read.parquet(path).count()) != rows:
        raise ValueError(f"{path} has {n} rows instead of {rows}")


def read_pairs(spark, path: str, rows: int | None = None) -> DataFrame:
    """A pair table as write_pairs left it; fails if it hasn't the expected rows, as when it was made of other texts."""
    df = spark.read.parquet(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows instead of {rows}")
    return df


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of aggregated tables, each with at most so many rows, and how many were left out."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()  # a report's table
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
        out += ["", f"Only the first {most} rows are shown." if len(rows) > most else "", ""]
    return "\n".join(out)
