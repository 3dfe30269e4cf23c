"""Generated texts: a pluggable provider of answers, offline by default, that skips what is there already."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: prompt -> answer; None or an exception is tried again.
Provider = Callable[[str], str | None]
TRIES, FIRST_WAIT = 6, 1.0


def stub(prompt: str) -> str:
    """The prompt's last block, as an answer that needs no network."""
    return prompt.rsplit("\n\n", 1)[-1]


def ask(provider: Provider, prompt: str, tries: int = TRIES, wait: float = FIRST_WAIT) -> str | None:
    """The provider's answer; waits twice as long after each failure, and gives null after the last."""
    for k in range(tries):
        try:
            if (answer := provider(prompt)) is not None:
                if not isinstance(answer, str):
                    raise TypeError(f"an answer must be text, not {type(answer).__name__}")  # a fault of the provider, which no retry mends
                return answer
        except (OSError, RuntimeError):
            pass
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    return None


def assignment_prompt(author, title, words) -> Column:
    return F.concat(F.lit("Describe in two sentences, without its text, the essay "), F.concat(F.lit('"'), F.coalesce(title, F.lit("untitled")), F.lit('"')), F.lit(" by "), author, F.lit(", of about "), words.cast("string"), F.lit(" words."))


def recreation_prompt(assignment, context) -> Column:
    """The assignment after the author's other essays, or after a sentence that says there are none."""
    return F.concat(F.when(F.coalesce(F.length(context), F.lit(0)) > 0, context).otherwise(F.lit("(No other essays are at hand.)")), F.lit("\n\n"), assignment)


def answers(prompts: DataFrame, have: DataFrame | None, key: str, provider: Provider = stub, overwrite: bool = False, wait: float = FIRST_WAIT) -> DataFrame:
    """(key, body): an answer to each prompt (key, prompt); those that have lists are skipped unless they are to be overwritten."""
    todo = prompts.where(F.col(key).isNotNull() & F.col("prompt").isNotNull())
    if have is not None and not overwrite:
        todo = todo.join(have.where("body is not null").select(key).distinct(), key, "left_anti")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ask(provider, p, wait=wait) for p in b.column(1).to_pylist()], pa.string())], [key, "body"])

    return todo.select(F.col(key).cast("string").alias(key), "prompt").mapInArrow(each, f"{key} string, body string")
