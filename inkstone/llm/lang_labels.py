"""Problem 10: missing or wrong language labels, by interpolated Kneser-Ney character models (see _kn.py).

A document's words are scored in every language once per different word. Where no window of a document prefers another
language than the whole, the whole has one; else the languages of its words are decoded together, a change of language
costing less at the end of a sentence. What no model explains better than its held-out samples, by the calibrated
cross-entropy per character, has no language.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm import _kn

MIN_WORDS = 20
#: Samples of a language that its model is fitted on, at most; they are taken in the order of a hash of their ids.
SAMPLES = 2000
#: Cost of a change of language, in nats, within a sentence and after one.
CHANGE, CHANGE_AFTER_SENTENCE = 12.0, 5.0
WINDOW = 10
#: Preference, in nats over a window, from which a document is decoded.
DOUBT = 4.0
#: Most nats by which one word may prefer a language; and one that no language spells well, such as a name, from so
#: many nats a character in the best of them.
EVIDENCE, EVIDENCE_OF_NAMES, NAME = 5.0, 1.0, 1.8
CACHE_WORDS = 150_000
#: Words of documents that are decoded side by side, padded to the longest; one document may have more.
TOGETHER = 400_000

#: Codes and names of the eight languages.
SPELLINGS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
}

_ENDED = re.compile(r"[.!?…][\"'”’»)\]]*$")


def named_language(label):
    """Column: the two-letter code that a label names in upper or lower case, with a region, by three letters or by name; else null."""
    base = F.element_at(F.split(F.lower(F.trim(label)), "[-_]"), 1)
    names = [x for code, all_ in SPELLINGS.items() for name in all_.split() for x in (F.lit(name), F.lit(code))]
    return F.create_map(*names)[base]


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", key: str = "sample_id"):
    """(languages, most nats a character) from at most SAMPLES samples of each language.

    Each fifth sample is scored by models of the rest; the limit is their mean plus six deviations.
    """
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), text)
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLES).select(lang, text, "n").collect()  # bounded by SAMPLES
    by = {x: [r[1] for r in rows if r[0] == x] for x in sorted({r[0] for r in rows})}
    held = []
    if by and min(map(len, by.values())) >= 5:
        part = _kn.Languages({x: [t for i, t in enumerate(ts) if i % 5] for x, ts in by.items()})
        for k, x in enumerate(part.names):
            for t in by[x][::5]:
                s = part.score([_kn.letters(w) for w in _kn.clean(t).split()]).sum(axis=0)
                if s[-1]:
                    held.append(-s[k] / s[-1])
    most = float(np.mean(held) + 6 * np.std(held)) if held else float("inf")
    return _kn.Languages(by), most


class Scorer:
    """Scores of words, and whether they end a sentence, remembered by a worker: raw word -> row."""

    def __init__(self, languages: _kn.Languages):
        self.languages, self.row = languages, {}
        self.scores, self.ended = np.zeros((0, len(languages.names) + 1), np.float32), np.zeros(0, bool)

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Row numbers in self.scores of each document's words."""
        new = list({w for words in docs for w in words} - self.row.keys())
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.scores, self.ended = {}, self.scores[:0], self.ended[:0]
            new = list({w for words in docs for w in words})
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        if new:
            self.scores = np.concatenate([self.scores, bounded(self.languages.score([_kn.letters(w) for w in new])).astype(np.float32)])
            self.ended = np.concatenate([self.ended, np.fromiter((bool(_ENDED.search(w)) for w in new), bool, len(new))])
        return [np.fromiter(map(self.row.__getitem__, words), np.int64, len(words)) for words in docs]


def bounded(scores: np.ndarray) -> np.ndarray:
    """Word scores in which no word outweighs a passage: the best language's stays, others are at most EVIDENCE below."""
    best = scores[:, :-1].max(axis=1, keepdims=True)
    name = -best > NAME * scores[:, -1:]
    return np.hstack([np.maximum(scores[:, :-1], best - np.where(name, EVIDENCE_OF_NAMES, EVIDENCE)), scores[:, -1:]])


def _decode(scores: list[np.ndarray], ended: list[np.ndarray]) -> list[np.ndarray]:
    """Best language of each word of each document, by Viterbi over all documents side by side."""
    longest, k = max(map(len, scores)), scores[0].shape[1]
    s, cost = np.zeros((len(scores), longest, k), np.float32), np.full((len(scores), longest), CHANGE, np.float32)
    for i, (x, e) in enumerate(zip(scores, ended)):
        s[i, : len(x)] = x
        cost[i, 1 : len(e)][e[:-1]] = CHANGE_AFTER_SENTENCE
    value, came = s[:, 0].copy(), np.zeros((len(scores), longest, k), np.int8)
    for t in range(1, longest):
        best = value.argmax(axis=1)
        change = value[np.arange(len(value)), best] - cost[:, t]
        stay = value >= change[:, None]
        came[:, t] = np.where(stay, np.arange(k, dtype=np.int8), best[:, None].astype(np.int8))
        value = np.where(stay, value, change[:, None]) + s[:, t]
    state, out = value.argmax(axis=1), np.zeros((len(scores), longest), np.int8)
    for t in range(longest - 1, -1, -1):
        out[:, t] = state
        state = came[np.arange(len(scores)), t, state]
    return [o[: len(x)] for o, x in zip(out, scores)]


def _confidence(total: np.ndarray, chars: float) -> float:
    """Share of the best language when likelihoods count by the root of the length, as neighbouring characters depend."""
    x = (total - total.max()) / max(1.0, np.sqrt(max(chars, 1.0)))
    return float(1 / np.exp(x).sum())


def label(texts: list, scorer: Scorer, most: float) -> list[list[tuple]]:
    """For each text its rows (scope, first word, words, language, confidence): first the document, then its passages."""
    names = scorer.languages.names
    docs = [_kn.clean(t).split() if t else [] for t in texts]
    rows, out, doubtful = scorer.rows(docs), [[] for _ in texts], []
    for i, (words, r) in enumerate(zip(docs, rows)):
        s = scorer.scores[r]
        total = s.sum(axis=0, dtype=np.float64)
        if not total[-1] or -total[:-1].max() / total[-1] > most:
            out[i].append(("document", 0, len(words), None, 0.0))
            if not total[-1] or len(words) < MIN_WORDS:
                continue
        else:
            best = int(total[:-1].argmax())
            out[i].append(("document", 0, len(words), names[best], _confidence(total[:-1], total[-1])))
        if len(words) < MIN_WORDS:
            continue
        best = int(total[:-1].argmax())
        sums = np.zeros((len(s) + 1, len(names)))
        np.cumsum(s[:, :-1] - s[:, best : best + 1], axis=0, out=sums[1:])
        if (sums[WINDOW:] - sums[:-WINDOW]).max() > DOUBT or out[i][0][3] is None:
            doubtful.append(i)
        else:
            out[i].append(("passage", 0, len(words), names[best], out[i][0][4]))
    doubtful.sort(key=lambda i: -len(docs[i]))
    while doubtful:
        many = max(1, TOGETHER // len(docs[doubtful[0]]))
        part, doubtful = doubtful[:many], doubtful[many:]
        for i, state in zip(part, _decode([scorer.scores[rows[i]][:, :-1] for i in part], [scorer.ended[rows[i]] for i in part])):
            edge = np.concatenate([[0], np.flatnonzero(np.diff(state)) + 1, [len(state)]])
            for b, e in zip(edge[:-1], edge[1:]):
                t = scorer.scores[rows[i][b:e]].sum(axis=0, dtype=np.float64)
                if e - b >= MIN_WORDS and t[-1] and -t[state[b]] / t[-1] <= most:
                    out[i].append(("passage", int(b), int(e - b), names[state[b]], _confidence(t[:-1], t[-1])))
    return out


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model) -> Scorer:
    """This worker's scorer for a broadcast (name, languages, most)."""
    name, languages_, _ = model.value
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(languages_)
    return _SCORERS[name]


def broadcast_model(samples: DataFrame):
    """The fitted models, bounded by SAMPLES, for all executors."""
    return samples.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *fit(samples)))


def _label_rows(batches, model):
    scorer, most = scorer_of(model), model.value[2]
    names = ["id", "scope", "first_word", "n_words", "lang", "confidence"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = label(part.column(1).to_pylist(), scorer, most)
            row = np.repeat(np.arange(len(found)), list(map(len, found)))
            cols = zip(*(x for rows in found for x in rows))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, types))], names)


def languages(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, scope, first_word, n_words, lang, confidence): a row for each document and for each passage in one language.

    scope `document`: the language of the whole, null with confidence 0 for null and empty texts and those without
    words of a language. scope `passage`: at least MIN_WORDS consecutive words in a language; a document all in one
    language is one passage. Words are those of the cleaned text (markup and invisible characters are no words).
    """
    kind = df.schema[key].dataType.simpleString()
    model = broadcast_model(samples)
    schema = f"id {kind}, scope string, first_word int, n_words int, lang string, confidence double"
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(lambda it: _label_rows(it, model), schema).withColumnRenamed("id", key)


def unnamed(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang) of each language of a document that its label does not name.

    A document has the language of each passage, or, under MIN_WORDS words, that of the whole. The label travels with
    the text, so nothing is joined.
    """
    kind = df.schema[key].dataType
    if kind.simpleString() not in ("bigint", "int", "string"):
        raise ValueError("the key must be a number or a string")
    both = df.select(F.struct(F.col(key).alias("k"), named_language(F.col(lang)).alias("named")).alias("key"), F.col(text).alias("text"))
    found = languages(both, samples, "key", "text")
    has = (F.col("scope") == "passage") | (F.col("n_words") < MIN_WORDS)
    return found.where(has & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("key.named"))).select(F.col("key.k").alias(key), "lang").distinct()
