"""Problem 6: evaluation texts leaking into training text, by a Wu-Manber search (see passages.py).

The bucket of a pattern's hash is a distributed join, so neither the patterns nor the corpus have to fit anywhere.
Every place that it leaves is confirmed on the words themselves, allowing for a tenth of changed words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import passages
from inkstone.llm._align import common_runs, holds_passage
from inkstone.plans.lineage import written

WORDS = 40
#: Words for each change.
PER = 10
#: A passage that holds no shorter one within its own limit has 40 to 49, 50, 60 or 70 words (see passages.py).
LONGEST = 70


def _confirm(batches, words: int, per: int, longest: int):
    q_texts, c_texts, run = passages.Texts(), passages.Texts(), passages.PATTERN
    for batch in batches:
        q_ids, c_ids = (batch.column(i).to_pylist() for i in (0, 1))
        good = []
        for i, (q, c, places) in enumerate(zip(q_ids, c_ids, batch.column(4).to_pylist())):
            x, y = q_texts.of(q, batch.column(2)[i]), c_texts.of(c, batch.column(3)[i])
            at = sorted((p["q_pos"], p["c_pos"]) for p in places if min(p["q_pos"], p["c_pos"]) >= 0)
            found = holds_passage(x, y, at, words, per, longest, run)
            if not found and len(at) < len(places):  # a run that one of them repeats
                found = holds_passage(x, y, common_runs(x, y, run), words, per, longest, run)
            good.append(found)
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def leaks(tests: DataFrame, corpus: DataFrame, test_key: str = "article_id", corpus_key: str = "article_id", text: str = "text") -> DataFrame:
    """(corpus_key, test_key) of every stored text that holds at least WORDS consecutive words of a test text.

    Case, punctuation, accents, markup and white space are ignored; at most a tenth of the words may be changed.
    A passage ends in words that are equal (two after a change), as a change at its end can't be told from the end of a shorter quotation.
    Rows with a null key or text hold and leak nothing; repeated rows count once; empty tables give no row.
    """
    q, c = passages.texts(tests, test_key, text), passages.texts(corpus, corpus_key, text)
    one, stored = written(passages.unique(q), "p6-tests"), passages.unique(c)
    places = passages.candidates(one, stored).groupBy("q", "c").agg(F.collect_set(F.struct("q_pos", "c_pos")).alias("places"))  # at most REPEATS squared for each run
    places = written(places, "p6-places")
    pairs = passages.paired(places, one, stored).select("q", "c", "q_text", "c_text", "places")
    found = written(pairs.mapInArrow(lambda it: _confirm(it, WORDS, PER, LONGEST), "q long, c long"), "p6-found")
    return passages.keys_of(passages.keys_of(found, "q", q, "test_key"), "c", c, "corpus_key").select("corpus_key", "test_key").distinct()
