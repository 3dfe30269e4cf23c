"""Problem 3: splitting oversized items at natural boundaries, by range-maximum queries over boundary strengths.

Each place between two units (words or tokens) has a strength: the end of a paragraph, of a sentence, of a line, of a
clause, or none. A piece begins OVERLAP units before the end of the last one, and ends at the strongest place between
half the limit and the limit, the rightmost on ties. A sparse table answers each query from two entries.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESSAY_LIMIT, ESSAY_OVERLAP = 1200, 60
CHUNK_LIMIT, CHUNK_OVERLAP = 400, 40

CUTS = ("none", "clause", "line", "sentence", "paragraph")
WORDS = r"filter(split({0}, '[ \t\r\n]+'), w -> w <> '')"

_WORD = re.compile(r"[^ \t\r\n]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:</\w+>)*$")
_CLAUSE = re.compile(r"[,;:—–][\"'”’»)\]]*$")
_CLOSING = frozenset("\"'”’»)]")


class RangeMax:
    """Rightmost maximum of any `width` consecutive strengths: the one level of a sparse table that this width needs."""

    def __init__(self, strength: np.ndarray, width: int):
        level = strength.astype(np.int64) * len(strength) + np.arange(len(strength))  # on ties the right one is larger
        self.n, self.width, self.step = len(strength), width, 1
        while 2 * self.step <= width:
            level = np.maximum(level[: -self.step], level[self.step :])
            self.step *= 2
        self.level = level

    def at(self, left: int) -> int:
        return int(max(self.level[left], self.level[left + self.width - self.step]) % self.n)


def cuts(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit, end, strength of the cut) of each piece; strength[i] is that of the place after unit i."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    n, first, out = len(strength), 0, []
    if n > limit:
        least = max(limit // 2, overlap + 1)
        index = RangeMax(strength, limit - least + 1)
        while n - first > limit:
            cut = index.at(first + least - 1)
            out.append((first, cut + 1, int(strength[cut])))
            first = cut + 1 - overlap
    out.append((first, n, len(CUTS) - 1))
    return out


def word_strengths(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(begin, end) of each word of a text, and the strength of the place after it."""
    at = [m.span() for m in _WORD.finditer(text)]
    strength = np.zeros(len(at), np.int8)
    for i, (b, e) in enumerate(at):
        lines = text.count("\n", e, at[i + 1][0]) if i + 1 < len(at) else 2
        word = text[b:e]
        strength[i] = 4 if lines > 1 or word.endswith("</p>") else 3 if _SENTENCE.search(word) else 2 if lines else 1 if _CLAUSE.search(word) else 0
    return at, strength


def token_strengths(tokens: list) -> np.ndarray:
    """Strength of the place after each token; closing quotes and brackets belong to the sentence before them."""
    strength, ended = np.zeros(len(tokens), np.int8), 0
    for i, t in enumerate(tokens):
        t = t or ""
        ended = ended if ended and t and t in _CLOSING else 3 if t and t[-1] in ".!?…" else 1 if t in {",", ";", ":", "—", "–"} else 0
        strength[i] = ended
        if ended and i and strength[i - 1] == ended and t in _CLOSING:
            strength[i - 1] = 0
    return strength


_COLUMNS = "item_table string, item_id string, piece int, first_unit int, n_units int, cut string, text string, tokens array<string>"


def _piece_rows(batches, table: str, limit: int, overlap: int):
    for batch in batches:
        rows = []
        for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if table == "essays":
                at, strength = word_strengths(item)
            else:
                at, strength = None, token_strengths(item)
            for k, (b, e, s) in enumerate(cuts(strength, limit, overlap)):
                text = item[at[b][0] : at[e - 1][1]] if at else None
                rows.append((table, key, k, b, e - b, CUTS[s], text, None if at else item[b:e]))
        if rows:
            cols = list(zip(*rows))
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in _COLUMNS.split(", ")])


def essay_pieces(essays: DataFrame, limit: int = ESSAY_LIMIT, overlap: int = ESSAY_OVERLAP, key: str = "article_id", text: str = "text") -> DataFrame:
    """Pieces of the texts of more than limit words; rows of one key are one item, null keys and texts none.

    Only oversized texts leave the JVM. A piece's text is the stretch of the original from its first to its last word.
    """
    size = F.size(F.expr(WORDS.format("text")))
    long = essays.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where((F.length("text") > limit) & (size > limit))
    return long.dropDuplicates(["key"]).mapInArrow(lambda it: _piece_rows(it, "essays", limit, overlap), _COLUMNS)


def chunk_pieces(chunks: DataFrame, limit: int = CHUNK_LIMIT, overlap: int = CHUNK_OVERLAP, key: str = "chunk_id", tokens: str = "tokens") -> DataFrame:
    """Pieces of the token lists of more than limit elements, null elements included; as essay_pieces."""
    long = chunks.where(F.col(key).isNotNull() & (F.size(tokens) > limit)).select(F.col(key).cast("string").alias("key"), F.col(tokens).alias("tokens"))
    return long.dropDuplicates(["key"]).mapInArrow(lambda it: _piece_rows(it, "chunk", limit, overlap), _COLUMNS)
