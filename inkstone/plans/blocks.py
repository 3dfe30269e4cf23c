"""Arrays that tasks write into the shared folder and others read: a row is written once, however many tiles it is a side of."""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession

from inkstone.plans.lineage import shared_dir

#: Tasks for a core, at most, among which tiles are dealt by their size.
WAVES, LEAST_TASKS = 4, 24


def folder(spark: SparkSession, label: str) -> str:
    """The address of a new folder beside the tables of written(), as pyarrow takes it; forget() deletes it too."""
    jvm, context = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkstone-{context.applicationId}/{label}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if uri.startswith("file:"):
        return "file:///" + uri[5:].lstrip("/")
    return "s3" + uri[3:] if uri.startswith("s3a:") else uri


@lru_cache(8)
def _system(where: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(where)


def save(where: str, arrays) -> str:
    """Write arrays under a name of their own; a task that is run again leaves a file that nobody reads."""
    system, root = _system(where)
    system.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{root}/{name}") as f:
        f.write(arrays if isinstance(arrays, (bytes, memoryview)) else pickle.dumps(arrays, 5))
    return name


def load(where: str, name: str):
    system, root = _system(where)
    with system.open_input_file(f"{root}/{name}") as f:
        return pickle.loads(f.read_buffer())


def pieces(where: str, name: str, places: list[tuple[int, int]]) -> list[bytes]:
    """Bytes of a file, of each (offset, length)."""
    system, root = _system(where)
    with system.open_input_file(f"{root}/{name}") as f:
        return [f.read_at(length, offset) for offset, length in places]


def delete(where: str, names: list[str]) -> None:
    system, root = _system(where)
    for name in names:
        system.delete_file(f"{root}/{name}")


def dealt(costs: list[tuple[int, tuple]], spark: SparkSession) -> list[list[tuple]]:
    """Work (cost, what) in groups of about equal cost, a group for a task."""
    many = min(len(costs), max(LEAST_TASKS, WAVES * spark.sparkContext.defaultParallelism))
    groups, loads = [[] for _ in range(many)], [0] * many
    heap = [(0, k) for k in range(many)]
    for cost, what in sorted(costs, reverse=True):
        load_, k = heapq.heappop(heap)
        groups[k].append(what)
        loads[k] = load_ + cost
        heapq.heappush(heap, (loads[k], k))
    return [sorted(g) for g in groups]


def over(spark: SparkSession, groups: list[list], work: Callable[[list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work(group) yields, each group in a task of its own."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from work(groups[k])

    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(run, schema)


@dataclass
class Made:
    """Rows that a task makes of texts (id, doc, author) as it packs them; make turns batches with value as last column into ones with idx and val."""

    texts: DataFrame
    value: Column
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Blocks:
    """Blocks of rows in a folder: their names, rows and distinct authors (hashes)."""

    spark: SparkSession
    where: str
    names: list[str]
    sizes: list[int]
    authors: list[bytes]

    def tiles(self) -> list[list[tuple[int, int]]]:
        n = self.sizes
        return dealt([(n[i] * n[j] // (1 + (i == j)), (i, j)) for i in range(len(n)) for j in range(i, len(n))], self.spark)

    def reader(self) -> Callable[[int], dict]:
        """A function for tasks that gives a block, the last few of which it keeps."""
        where, names = self.where, self.names

        def read(k: int, kept: dict = {}) -> dict:  # noqa: B006
            key = (where, k)
            if key not in kept:
                while len(kept) > 1:
                    kept.pop(next(iter(kept)))
                kept[key] = load(where, names[k])
            return kept[key]

        return read
