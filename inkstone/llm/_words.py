"""Word hashing and rolling word-gram hashes over Arrow batches, all in NumPy."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: Words that a worker remembers the hash of; beyond it the memory is emptied, never the work.
CACHE_WORDS = 300_000
#: Words hashed and rolled at a time, which bounds a worker's arrays.
BLOCK_WORDS = 150_000

_ODD_BYTES = re.compile(rb"[\x0b\x0c]")
_BYTE_WORD = re.compile(rb"[^ \t\r\n]+")
_TAG = re.compile(r"</?[a-z][^<>]{0,80}>|&(?:[a-z]{2,8}|#\d{1,6});")
_NOT_ALNUM = re.compile(r"[\W_]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    """word -> unsigned 64-bit hash, filled on demand."""

    def __missing__(self, word):
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = self.value(word)
        return h


class ExactHashes(_Hashes):
    """Hashes of words as they stand (bytes)."""

    @staticmethod
    def value(word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


class PlainHashes(_Hashes):
    """Hashes of lower-cased, decomposed words without accents and punctuation; 0 for a word of punctuation only."""

    @staticmethod
    def value(word: str) -> int:
        bare = _NOT_ALNUM.sub("", word)
        return (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0


def exact_words(raw: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, CR and LF."""
    return _BYTE_WORD.findall(raw) if _ODD_BYTES.search(raw) else raw.split()


def plain_words(text: str) -> list[str]:
    """Lower-cased words of a text without markup, decomposed so that accents fall away with the punctuation."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return text.split()


def blocks(texts, plain: bool, cache: dict):
    """Yield (first row, ends, hashes) for consecutive rows of a pyarrow string column; a null text has no words.

    ends[j] is the end of row (first + j) in the flat array hashes.
    """
    first, parts, ends, total = 0, [], [], 0
    for row, cell in enumerate(texts):
        value = cell.as_py() if plain else (cell.as_buffer() if cell.is_valid else None)
        if value is not None:
            words = plain_words(value) if plain else exact_words(value.to_pybytes())
            got = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            if plain:
                got = got[got != 0]
            parts.append(got)
            total += len(got)
        ends.append(total)
        if total >= BLOCK_WORDS:
            yield first, np.array(ends, np.int64), np.concatenate(parts)
            first, parts, ends, total = row + 1, [], [], 0
    if ends:
        yield first, np.array(ends, np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a gram hash is usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = f"{base}"
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, 2 * BLOCK_WORDS), base, np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[key][:n]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; shorter than hashes by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE, n))


def room(ends: np.ndarray, n: int) -> np.ndarray:
    """For each of the n words, the words from it to the end of its row."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)


def rows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its row in the block and its position in that row."""
    lengths = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), lengths)
    return row, np.arange(len(row)) - np.repeat(ends - lengths, lengths)


def _slide(values: np.ndarray, width: int, what) -> np.ndarray:
    """what (minimum or maximum) of each width consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = what(out[:-step], out[step:])
        have += step
    return out


def winnow(gram: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of some window of width valid grams of one row (all of them on ties).

    Any two equal stretches of width grams thus select the same positions.
    """
    if len(gram) < width:
        return np.empty(0, np.int64)
    value = np.where(valid, gram | np.uint64(1), np.uint64(0))  # 0 marks a gram over a row's end
    least = _slide(value, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    best = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero((best == value) & (value != 0))
