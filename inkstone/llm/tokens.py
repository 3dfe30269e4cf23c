"""Problems 5 and 8: token budgets and the encoding of a whole corpus under a public byte-level BPE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import _bpe

#: Rows encoded into one Arrow batch, which bounds a worker's output.
ROWS = 500


def _encoded(batches, path: str):
    enc = _bpe.encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = [enc.ids(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = _bpe.DEFAULT_FILE) -> DataFrame:
    """(key, ids): each row's token ids without special tokens; [] for an empty or null text. Rows and null keys are kept."""
    kind = df.schema[key].dataType.simpleString()
    path = _bpe.ship(df.sparkSession, path)
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(lambda it: _encoded(it, path), f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def _counted(batches, path: str):
    enc = _bpe.encoder(path)
    for batch in batches:
        n = pa.array([enc.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n"])


def count(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = _bpe.DEFAULT_FILE, keep: list[str] = ()) -> DataFrame:
    """(key, keep..., n_tokens) of each row; 0 for an empty or null text. Rows and null keys are kept.

    A word is merged once by a worker, by the linked list and queue of _bpe.count_by_queue, and weighted by its
    frequency in the text. One narrow stage: only numbers and the kept columns go on.
    """
    names = [f"c{i}" for i in range(len(keep) + 1)]
    path = _bpe.ship(df.sparkSession, path)
    cols = df.select(*(F.col(c).alias(n) for c, n in zip([key, *keep], names)), F.col(text).alias("t"))
    out = cols.mapInArrow(lambda it: _counted(it, path), ", ".join(f"{n} {t}" for n, t in cols.dtypes[:-1]) + ", n long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, [key, *keep])), F.col("n").alias("n_tokens"))


def once(sized: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a key, the least by its other columns; each row without a key is a record of its own."""
    rest = [c for c in sized.columns if c != key]
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = sized.select(F.col(key).alias("k"), own.alias("own"), F.struct(*rest).alias("r")).groupBy("k", "own").agg(F.min("r").alias("r"))
    return rows.select(F.col("k").alias(key), "r.*")


def budget(sized: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, records, tokens) of sized records (groups, n_tokens), null being a group of its own."""
    return sized.groupBy(*groups).agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))


def totals(sized: DataFrame, groups: list[str]) -> DataFrame:
    """(level, groups, records, tokens): the budget rolled up to all, to each group alone and to every set of groups.

    level names the columns that a row is of, joined by `+`, or is `all`; the other columns are null. An empty table
    has no records and no tokens in all.
    """
    level = F.concat_ws("+", *(F.when(F.grouping(g) == 0, g) for g in groups))
    cube = budget(sized, groups).cube(*groups).agg(level.alias("level"), F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "tokens")]
    return cube.select(F.when(F.col("level") == "", "all").otherwise(F.col("level")).alias("level"), *groups, *zero)
