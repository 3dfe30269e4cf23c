"""Interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

ORDER = 5
DISCOUNT = 0.75

_HIDDEN = re.compile("[​-‏‪-‮⁠﻿­️]")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKUP = re.compile(r"</?\w[^<>]{0,80}>|<\|\w+\|>|\[[A-Z]{2,6}\]|&(?:\w{2,8}|#\d{1,6});|https?://\S+")
_GARBLED = re.compile("[ÂÃÐÑâ][\u0080-¿Œ-žƒˆ˜–-›€™Ђ-џҐґ№]")


def clean(text: str) -> str:
    """Composed, lower-cased text without invisible characters and markup; UTF-8 that was read as Latin is read anew."""
    if not text.isascii():
        if len(_GARBLED.findall(text)) > 2:
            text = _regarbled(text)
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text))
    return _MARKUP.sub(" ", text).lower()


def _regarbled(text: str) -> str:
    raw = bytearray()
    for c in text:
        o = ord(c)
        try:
            raw += bytes([o]) if o < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            raw += c.encode()
    return raw.decode("utf-8", "replace")


def letters(word: str) -> str:
    """The letters of a white-space word from which its language is told; empty for numbers, symbols and codes."""
    found = _LETTERS.findall(word)
    if not found or any(c.isdigit() for c in word) and len(word) > 12:
        return ""
    return " ".join(found) if len(max(found, key=len)) <= 40 else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each position >= n - 1."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Model:
    """P(c | up to ORDER - 1 characters before it). Words are scored with a space before and after them.

    For each order: sorted gram hashes with their discounted probabilities, and sorted context hashes with the weight
    that they leave to the next lower order. Lower orders count the different characters before a gram.
    """

    def __init__(self, texts: list[str]):
        joined = (" " + "  ".join(" ".join(filter(None, map(letters, clean(t).split()))) for t in texts) + " ")
        codes = _codes(joined)
        self.alphabet = len(np.unique(codes)) + 40  # the rest of a script's characters share one part
        self.grams, self.contexts = [], []
        for n in range(1, ORDER + 1):
            if len(codes) <= n:
                self.grams.append((np.zeros(0, np.uint64), np.zeros(0)))
                self.contexts.append((np.zeros(0, np.uint64), np.zeros(0)))
                continue
            gram, context = _hash(codes, n), _hash(codes, n - 1)[: len(codes) - n + 1] if n > 1 else np.zeros(len(codes), np.uint64)
            if n < ORDER:  # continuation counts: each different gram of one more character counts once
                once = np.sort(np.unique(_hash(codes, n + 1), return_index=True)[1])
                gram, context = gram[1:][once], context[1:][once]
            keys, at, counts = np.unique(gram, return_index=True, return_counts=True)
            of = context[at]
            c_keys, c_of = np.unique(of, return_inverse=True)
            total, kinds = np.bincount(c_of, weights=counts), np.bincount(c_of)
            self.grams.append((keys, np.maximum(counts - DISCOUNT, 0) / total[c_of]))
            self.contexts.append((c_keys, DISCOUNT * kinds / total))

    def log_probs(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural logarithm of each character's probability; hashes: for each order those of the grams and contexts."""
        p = np.full(len(hashes[0][0]), 1.0 / self.alphabet)
        for (gram, context), (keys, prob), (c_keys, left) in zip(hashes, self.grams, self.contexts):
            if not len(keys):
                continue
            g, c = np.searchsorted(keys, gram).clip(max=len(keys) - 1), np.searchsorted(c_keys, context).clip(max=len(c_keys) - 1)
            seen = c_keys[c] == context
            p = np.where(seen, np.where(keys[g] == gram, prob[g], 0.0) + left[c] * p, p)
        return np.log(p)


def word_hashes(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Gram and context hashes of every character of ` word ` but the first space, per order; each character's word."""
    pad = "\x00" * (ORDER - 1)
    codes = _codes("".join(f"{pad} {w} " for w in words))
    word = np.repeat(np.arange(len(words)), [ORDER + 1 + len(w) for w in words])
    start = np.concatenate([[0], np.cumsum([ORDER + 1 + len(w) for w in words])])[:-1]
    inside = np.arange(len(codes)) - start[word]
    at = np.flatnonzero(inside >= ORDER)  # the characters after the first space
    out = []
    for n in range(1, ORDER + 1):
        gram = _hash(codes, n)[at - n + 1]
        context = _hash(codes, n - 1)[at - n + 1] if n > 1 else np.zeros(len(at), np.uint64)
        out.append((gram, context))
    return out, word[at]


class Languages:
    """The models of all languages and a bounded memory of words' scores."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.models = [Model(samples[x]) for x in self.names]

    def score(self, words: list[str]) -> np.ndarray:
        """For each word its total log-probability in each language, and in the last column its characters."""
        out = np.zeros((len(words), len(self.names) + 1))
        has = [i for i, w in enumerate(words) if w]
        for at in range(0, len(has), 20_000):
            part = has[at : at + 20_000]
            hashes, word = word_hashes([words[i] for i in part])
            for k, m in enumerate(self.models):
                out[part, k] = np.bincount(word, weights=m.log_probs(hashes), minlength=len(part))
            out[part, -1] = np.bincount(word, minlength=len(part))
        return out
