"""Feature extractors with a fit and a transform side over tables (id, text)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.plans.blocks import Made
from inkstone.plans.lineage import written

LEAST_WORDS, MOST_WORDS = 100, 1000
EPS = 1e-12
#: Terms with their idf that may be sent to every task; more are joined.
MOST_TERMS = 300_000
#: Words whose grams a worker remembers; beyond it the memory is emptied, never the work.
CACHE_WORDS = 200_000
#: And the grams that a worker has numbers for, or totals of, before it hands these on.
CACHE_GRAMS = 500_000


def _word_rows(batches):
    """Per batch its different words: (order..., at, term, n), the order columns and the place of the word's first occurrence."""
    for batch in batches:
        words, keys = batch.column(batch.num_columns - 1), batch.columns[:-1]
        flat, lengths = words.flatten(), np.diff(words.offsets.to_numpy())
        if not len(flat):
            continue
        places = list(zip(*(c.to_pylist() for c in keys)))
        order = np.array(sorted(range(len(places)), key=lambda i: tuple((x is not None, x) for x in places[i])))
        rank, wide = np.empty(len(order), np.int64), int(lengths.max())
        rank[order] = np.arange(len(order))
        place = np.repeat(rank, lengths) * wide + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        coded = flat.dictionary_encode()
        idx = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, idx, place)
        row = pa.array(order[first // wide])
        cols = [*(c.take(row) for c in keys), pa.array((first % wide).astype(np.int32)), coded.dictionary, pa.array(np.bincount(idx))]
        yield pa.RecordBatch.from_arrays(cols, [f"o{i}" for i in range(len(keys))] + ["at", "term", "n"])


def most_frequent(docs: DataFrame, n: int, order: list[str] = ("id",), lower: bool = True) -> DataFrame:
    """(idx, term, cnt): the n most frequent words, those first seen (by order, then place) first on ties.

    Words are counted batch by batch; what is moved is a row a batch and different word.
    """
    cols = docs.select(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), T.words("text", lower).alias("w"))
    names = cols.columns[:-1]
    words = cols.mapInArrow(_word_rows, ", ".join(f"{x} {t}" for x, t in cols.dtypes[:-1]) + ", at int, term string, n long")
    top = words.groupBy("term").agg(F.sum("n").alias("cnt"), F.min(F.struct(*names, "at")).alias("first")).orderBy(F.desc("cnt"), "first").limit(n)
    by = Window.orderBy(F.desc("cnt"), "first")  # n rows
    return top.select((F.row_number().over(by) - 1).alias("idx"), "term", "cnt")


def vectors(docs: DataFrame, vocab: list[str], lower: bool = True, mu: list[float] | None = None, sigma: list[float] | None = None, keep: list[str] = ()) -> DataFrame:
    """(id, keep..., vec): relative frequencies of the vocabulary's words, or their deviations from mu in sigmas.

    The words are found in the JVM; counting them into dense rows is one narrow stage on Arrow arrays, where an
    aggregation would shuffle more bytes than the texts have. Zeros for a text without words; where sigma is 0 values
    are only centred.
    """
    centre, scale = (np.array(mu), np.where(np.array(sigma) > EPS, sigma, 1.0)) if mu is not None else (None, None)

    def count(batches):
        for batch in batches:
            rf = _frequencies(batch.column(batch.num_columns - 1), vocab)
            if centre is not None:
                rf = (rf - centre) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(rf)], [*batch.schema.names[:-1], "vec"])

    rows = docs.select("id", *keep, T.words("text", lower).alias("vec"))
    return rows.mapInArrow(count, ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", vec array<double>")


def _frequencies(words: pa.ListArray, vocab: list[str]) -> np.ndarray:
    n, lengths = len(vocab), np.diff(words.offsets.to_numpy())
    idx = pc.fill_null(pc.index_in(words.flatten(), value_set=pa.array(vocab, pa.string())), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    hit = idx >= 0
    counts = np.bincount(row[hit] * n + idx[hit], minlength=len(lengths) * n).reshape(len(lengths), n)
    return counts / np.maximum(lengths, 1)[:, None]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def frequencies(docs: DataFrame, vocab: list[str], lower: bool = True) -> DataFrame:
    """(id, idx, rf): the vocabulary words that a text has, as parts of all its words."""
    return vectors(docs, vocab, lower).select("id", F.posexplode("vec").alias("idx", "rf")).where("rf > 0")


def column_stats(docs: DataFrame, vocab: list[str], lower: bool = True) -> DataFrame:
    """(idx, mu, sigma): mean and population deviation of each word's relative frequency over all texts, zeros included.

    Each task reduces its texts to their number, means and squared deviations, which are then combined, so nothing
    cancels. Without texts both are 0.
    """

    def reduce(batches):
        n, mean, square = 0, np.zeros(len(vocab)), np.zeros(len(vocab))
        for batch in batches:
            rf = _frequencies(batch.column(0), vocab)
            if len(rf):
                own, total = rf.mean(axis=0), n + len(rf)
                square += ((rf - own) ** 2).sum(axis=0) + (own - mean) ** 2 * (n * len(rf) / total)
                mean, n = mean + (own - mean) * (len(rf) / total), total
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), _lists(mean[None]), _lists(square[None])], ["n", "m", "q"])

    parts = docs.select(T.words("text", lower).alias("w")).mapInArrow(reduce, "n long, m array<double>, q array<double>")
    each = parts.select(F.posexplode(F.transform(F.arrays_zip("m", "q"), lambda x: F.struct(F.col("n").alias("n"), x["m"].alias("m"), x["q"].alias("q")))).alias("idx", "x"))
    tasks = each.groupBy("idx").agg(F.collect_list("x").alias("l"))  # a value a task
    total = lambda value: F.aggregate("l", F.lit(0.0), lambda a, x: a + value(x))
    mean = tasks.withColumn("all", total(lambda x: x["n"].cast("double"))).withColumn("mu", total(lambda x: x["n"] * x["m"]) / F.col("all"))
    off = total(lambda x: x["q"] + x["n"] * (x["m"] - F.col("mu")) * (x["m"] - F.col("mu")))
    found = mean.select("idx", "mu", F.sqrt(off / F.col("all")).alias("sigma"))
    every = docs.sparkSession.range(len(vocab)).select(F.col("id").cast("int").alias("idx"))
    return every.join(found, "idx", "left").na.fill(0.0, ["mu", "sigma"])


def _grams(words: pa.ListArray, expand, seen: dict, codes: dict):
    """(text, gram, count) of some texts as arrays, by text and gram, and the grams in their order; seen: the codes of each word's grams."""
    flat, lengths = words.flatten().dictionary_encode(), np.diff(words.offsets.to_numpy())
    if len(codes) > CACHE_GRAMS or len(seen) > CACHE_WORDS:
        codes.clear()
        seen.clear()
    own = []
    for w in flat.dictionary.to_pylist():
        if w not in seen:
            seen[w] = np.array([codes.setdefault(g, len(codes)) for g in (expand(w) if expand else (w,))], np.int64)
        own.append(seen[w])
    many = np.array([len(x) for x in own], np.int64)
    there, at = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True)
    names = np.array(list(codes) or [""], dtype=object)
    grams = names[there]
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, word = np.cumsum(many) - many, flat.indices.to_numpy()
    n = many[word]
    each = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cell = np.repeat(np.repeat(np.arange(len(lengths)), lengths), n) * max(len(grams), 1) + rank[at][each]
    count = np.bincount(cell)
    cell = np.flatnonzero(count)
    return cell // max(len(grams), 1), cell % max(len(grams), 1), count[cell], grams[order]


def _slices(batches, most: int = 128):
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _tally(batches, expand):
    """Per text its different terms in order, with their counts; the texts' other columns stay before them."""
    seen, codes = {}, {}
    for batch in _slices(batches):
        text, gram, n, names = _grams(batch.column(batch.num_columns - 1), expand, seen, codes)
        ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(names, pa.string()).take(pa.array(gram)), pa.array(n, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "terms", "tf"])


def term_lists(docs: DataFrame, terms, expand=None, keep: list[str] = ()) -> DataFrame:
    """(id, keep..., terms, tf): each text's different terms and counts as two arrays, in one narrow stage.

    terms: an array column; expand(term), if given, gives the grams of each term and is remembered by the worker.
    """
    cols = docs.select("id", *keep, terms.alias("t"))
    return cols.mapInArrow(lambda it: _tally(it, expand), ", ".join(f"{n} {t}" for n, t in cols.dtypes[:-1]) + ", terms array<string>, tf array<long>")


def term_totals(docs: DataFrame, terms, expand=None) -> DataFrame:
    """(gram, df, n) of all terms: texts that have them, and their number; a row leaves a task for each of its terms, not one a text."""

    def count(batches):
        seen, codes, df, n = {}, {}, Counter(), Counter()
        out = lambda: pa.RecordBatch.from_pydict({"gram": pa.array(list(df), pa.string()), "df": pa.array(df.values(), pa.int64()), "n": pa.array((n[g] for g in df), pa.int64())})
        for batch in _slices(batches):
            _, gram, tf, names = _grams(batch.column(0), expand, seen, codes)
            df.update(dict(zip(names, np.bincount(gram, minlength=len(names)).tolist())))
            n.update(dict(zip(names, np.bincount(gram, tf, minlength=len(names)).astype(np.int64).tolist())))
            if len(df) > CACHE_GRAMS:
                yield out()
                df, n = Counter(), Counter()
        if df:
            yield out()

    tasks = docs.select(terms.alias("t")).mapInArrow(count, "gram string, df long, n long")
    return tasks.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def padded_grams(low: int, high: int):
    """A function that gives the character n-grams of one word, which is padded by a space on both sides, case kept.

    A padded word that is not longer than n is taken once, whole, and no longer n is tried on it.
    """

    def grams(word: str) -> list[str]:
        p = f" {word} "
        return [p[i : i + n] for n in range(low, high + 1) if n == low or len(p) >= n for i in range(max(len(p) - n + 1, 1))]

    return grams


def idf_of(lists: DataFrame, n_docs: int, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(gram, df, idf) of terms in at least min_df texts: ln((1 + n) / (1 + df)) + 1; the most frequent ones only, if limited."""
    tf = lists.select(F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(F.col("x.terms").alias("gram"), "x.tf")
    return idf_from(tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), n_docs, min_df, max_features)


def idf_from(totals: DataFrame, n_docs: int, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """idf_of() of terms whose totals (gram, df, n) are there."""
    df = totals.where(F.col("df") >= min_df)
    if max_features is not None:
        df = df.orderBy(F.desc("n"), "gram").limit(max_features)
    return df.select("gram", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"))


def _weigh(batches, shared, places: bool = False):
    """Batches with weights for counts; with places, the terms' places among the known ones for their names."""
    terms, idf = shared.value
    for batch in batches:
        lists, tf = batch.columns[-2:]
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        hit = at >= 0
        w, row = (1 + np.log(tf.flatten().to_numpy()[hit])) * idf[at[hit]], row[hit]
        length = np.sqrt(np.bincount(row, weights=w * w, minlength=batch.num_rows))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
        kept = pa.array(at[hit].astype(np.int64)) if places else lists.flatten().filter(pa.array(hit))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(ends, kept), pa.ListArray.from_arrays(ends, pa.array(w / length[row]))], [*batch.schema.names[:-2], *(("idx", "val") if places else ("terms", "w"))])


def _sent(idf: DataFrame):
    known = idf.select("gram", "idf").toArrow()  # at most MOST_TERMS rows
    return idf.sparkSession.sparkContext.broadcast((known.column("gram").combine_chunks(), known.column("idf").to_numpy()))


def tfidf(lists: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, ..., terms, w): (1 + ln tf) * idf of the known terms as two arrays, each text at length 1; other columns of lists stay.

    A table of at most MOST_TERMS terms goes to the tasks, and nothing is shuffled; a larger one is joined.
    """
    if idf.count() <= MOST_TERMS:
        shared = _sent(idf)
        return lists.mapInArrow(lambda it: _weigh(_slices(it), shared), ", ".join(f"{n} {t}" for n, t in lists.dtypes[:-2]) + ", terms array<string>, w array<double>")
    raw = lists.select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).join(idf, F.col("x.terms") == F.col("gram"))
    x = raw.select("id", F.struct("gram", ((1 + F.log("x.tf")) * F.col("idf")).alias("w")).alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # the terms of one text
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y["w"] * y["w"]))
    names = lists.columns[:-2]
    both = lists.select(*names).join(x.withColumn("l", length), "id", "left")
    none = F.array()
    return both.select(*names, F.coalesce(F.transform("x", lambda y: y["gram"]), none.cast("array<string>")).alias("terms"), F.coalesce(F.transform("x", lambda y: y["w"] / F.col("l")), none.cast("array<double>")).alias("w"))


def placed_weights(lists: DataFrame, idf: DataFrame) -> DataFrame:
    """tfidf() of a table of at most MOST_TERMS terms, as (id, ..., idx, val): the terms' places in its order for their names."""
    shared = _sent(idf)
    return lists.mapInArrow(lambda it: _weigh(_slices(it), shared, True), ", ".join(f"{n} {t}" for n, t in lists.dtypes[:-2]) + ", idx array<long>, val array<double>")


class FeatureExtractor:
    """What a pipeline asks of its features; rows are keyed by id."""

    needs_zscoring = False

    def fit(self, docs: DataFrame, reference: DataFrame | None = None) -> "FeatureExtractor":
        raise NotImplementedError

    def transform(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, docs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
        return self.fit(docs, reference).transform(docs)

    def names(self) -> DataFrame:
        raise NotImplementedError

    def reference_stats(self) -> DataFrame | None:
        return None


class MostFrequentWords(FeatureExtractor):
    """Relative frequencies of the n most frequent words of docs, with mean and deviation over the reference texts."""

    needs_zscoring = True

    def __init__(self, n: int = 500, lowercase: bool = True, order: list[str] = ("id",)):
        if not LEAST_WORDS <= n <= MOST_WORDS:
            raise ValueError(f"n must be from {LEAST_WORDS} to {MOST_WORDS}")
        self.n, self.lowercase, self.order, self.vocab = n, lowercase, list(order), None

    def fit(self, docs, reference=None):
        local = lambda df: docs.sparkSession.createDataFrame(sorted(df.collect()), df.schema)  # at most MOST_WORDS rows
        self.vocab = local(most_frequent(docs, self.n, self.order, self.lowercase))
        self.terms = [r.term for r in self.vocab.collect()]
        self.size = len(self.terms)
        self.stats = local(column_stats(docs if reference is None else reference, self.terms, self.lowercase))
        return self

    def transform(self, docs):
        self._fitted()
        return vectors(docs, self.terms, self.lowercase)

    def standardized(self, docs: DataFrame, keep: list[str] = ()) -> DataFrame:
        """(id, keep..., vec) in deviations from the reference means; only centred where the deviation is 0."""
        self._fitted()
        stats = self.stats.orderBy("idx").collect()  # at most MOST_WORDS rows
        return vectors(docs, self.terms, self.lowercase, [r.mu for r in stats], [r.sigma for r in stats], keep)

    def names(self):
        self._fitted()
        return self.vocab

    def reference_stats(self):
        self._fitted()
        return self.stats

    def _fitted(self):
        if self.vocab is None:
            raise RuntimeError("fit comes before transform")


class CharNGrams(FeatureExtractor):
    """Sublinear tf-idf of character n-grams within words."""

    def __init__(self, ngram_range: tuple[int, int] = (3, 4), min_df: int = 2, max_features: int | None = None):
        self.range, self.min_df, self.max_features, self.idf = ngram_range, min_df, max_features, None

    def lists(self, docs, keep=()):
        return term_lists(docs, T.pieces("text"), padded_grams(*self.range), keep)

    def fit(self, docs, reference=None):
        totals = term_totals(docs, T.pieces("text"), padded_grams(*self.range))
        self.idf = written(idf_from(totals, docs.count(), self.min_df, self.max_features), "idf")
        return self

    def transform(self, docs, keep=()):
        if self.idf is None:
            raise RuntimeError("fit comes before transform")
        return tfidf(self.lists(docs, keep), self.idf)

    def rows(self, docs: DataFrame) -> DataFrame | Made:
        """Sparse rows of docs (id, doc, author, text); of few terms as what makes them, so that none goes through the JVM."""
        if self.idf.count() > MOST_TERMS:
            return _sparse(self, docs)
        shared, grams = _sent(self.idf), padded_grams(*self.range)
        return Made(docs, T.pieces("text"), lambda it: _weigh(_tally(it, grams), shared, True))

    def names(self):
        return self.idf.select("gram").orderBy("gram")


@dataclass(frozen=True)
class Metric:
    """features: the registered features that it needs; rows(space, docs): its rows (id, doc, author, vec or idx and val); distance: cosine or manhattan."""

    features: str
    rows: Callable[[FeatureExtractor, DataFrame], DataFrame]
    distance: str


def _unit(space, docs):
    return space.standardized(docs, ["doc", "author"]).withColumn("vec", V.unit(F.col("vec")))


def _sparse(space, docs):
    return space.transform(docs, ["doc", "author"]).select("id", "doc", "author", F.transform("terms", lambda x: F.xxhash64(x)).alias("idx"), F.col("w").alias("val"))


#: Registries through which a pipeline picks features and metrics by name; register() adds to them.
FEATURES: dict[str, Callable[..., FeatureExtractor]] = {"mfw": lambda config: MostFrequentWords(config.mfw_n, order=["doc", "chunk_index"]), "char_ngram": lambda config: CharNGrams()}
METRICS: dict[str, Metric] = {
    "cosine_delta": Metric("mfw", _unit, "cosine"), "burrows_delta": Metric("mfw", lambda space, docs: space.standardized(docs, ["doc", "author"]), "manhattan"), "char_ngram_cosine": Metric("char_ngram", _sparse, "cosine"),
}


def register(name: str, metric: Metric, extractor: Callable[..., FeatureExtractor] | None = None) -> None:
    """Add a metric, and with extractor the features of its name, made from a pipeline's settings."""
    if extractor is not None:
        FEATURES[metric.features] = extractor
    if metric.features not in FEATURES:
        raise ValueError(f"no such features: {metric.features}")
    METRICS[name] = metric


def required_features(metric: str) -> str:
    """The features that a metric is made of."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    return METRICS[metric].features
