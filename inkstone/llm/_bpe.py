"""Byte-level BPE over a public rank file: two merge engines and a cache of whole words.

A text is first split by a fixed pattern into pieces, within which byte pairs merge by rank. Pieces never cross from
a character into a space that follows it, so a word and the one space before it can be encoded apart from the rest,
and each different word is encoded once per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections import Counter
from itertools import chain

import regex
from pyspark import SparkFiles

#: Fixed value: the pattern that belongs to the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FILE = os.path.join(os.environ.get("INKSTONE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Different words that a worker remembers; beyond it the memory is emptied, never the work.
CACHE_WORDS = 200_000

_PIECE = regex.compile(PATTERN)
_ODD_SPACE = re.compile(r"\s | \s|^\s|\s$")
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_NONE = 1 << 62


def ship(spark, path: str) -> str:
    """Send a rank file along with the job, so that workers need no copy of their own; the driver has it."""
    spark.sparkContext.addFile(path)
    return path


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file at this path, or of the file of its name that ship() sent to this worker."""
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge_by_tree(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece. A segment tree over its bytes holds the least pair rank, the leftmost on ties.

    A leaf is a live symbol's start and the rank of the pair that it makes with the next live symbol. A merge changes
    three leaves, so a piece of n bytes takes O(n log n).
    """
    n = len(piece)
    if n == 1 or piece in ranks and n == 2:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))  # of the live symbol that starts here; the next one starts there
    before = list(range(-1, n))
    tree = [(_NONE, 0)] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = (ranks.get(piece[i : i + 2], _NONE), i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = (rank, i)
        while k := k >> 1:
            new = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == new:
                break
            tree[k] = new

    while tree[1][0] < _NONE:
        i = tree[1][1]
        gone = end[i]
        end[i] = end[gone]
        if end[i] <= n:
            before[end[i]] = i
        put(gone, _NONE)
        put(i, ranks.get(piece[i : end[end[i]]], _NONE) if end[i] < n else _NONE)
        if (b := before[i]) >= 0:
            put(b, ranks.get(piece[b : end[i]], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def count_by_queue(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens of a piece: linked symbols and a priority queue of their merges; the survivors are counted."""
    n = len(piece)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        stop = after[j]
        if (rank := ranks.get(piece[i:stop])) is not None:
            heapq.heappush(queue, (rank, i, j, stop))

    for i in range(n - 1):
        offer(i, i + 1)
    left = n
    while queue:
        _, i, j, stop = heapq.heappop(queue)
        if not live[i] or after[i] != j or j >= n or not live[j] or after[j] != stop:
            continue  # one of its symbols has merged since
        live[j], after[i] = False, stop
        left -= 1
        if stop < n:
            before[stop] = i
            offer(i, stop)
        if before[i] >= 0:
            offer(before[i], i)
    return left


def words(text: str) -> list[str]:
    """Stretches of a text that encode apart from each other: all but the first stand after one space, left out here."""
    return _PLAIN_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")


def pieces(word: str, first: bool) -> list[str]:
    """The pattern's pieces of a stretch; if it isn't the first of its text, with the space before it."""
    return _PIECE.findall(word if first else " " + word)


class _Memory(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = made = self.make(word)
        return made


class Encoder:
    """Encodes texts with the segment tree, or counts tokens with the queue. Without special tokens: their strings are text."""

    def __init__(self, path: str = DEFAULT_FILE):
        ranks = read_ranks(path)
        tree = lambda w, first: tuple(chain.from_iterable(merge_by_tree(p.encode(errors="replace"), ranks) for p in pieces(w, first)))
        queue = lambda w, first: sum(count_by_queue(p.encode(errors="replace"), ranks) for p in pieces(w, first))
        self.ranks = ranks
        self._head, self._ids = _Memory(lambda w: tree(w, True)), _Memory(lambda w: tree(w, False))
        self._head_n, self._n = _Memory(lambda w: queue(w, True)), _Memory(lambda w: queue(w, False))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        head, *rest = words(text)
        return [*self._head[head], *chain.from_iterable(map(self._ids.__getitem__, rest))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        head, *rest = words(text)
        return self._head_n[head] + sum(n * self._n[w] for w, n in Counter(rest).items())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_FILE) -> Encoder:
    """This worker's encoder for a rank file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
