"""Leave-one-out folds of natural and generated texts, their scores and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.operators import chunking, features
from inkstone.plans.lineage import written
from inkstone.plans.ranks import numbered


def sampled_essays(essays: DataFrame, per_author: int, seed: int = 1729) -> DataFrame:
    """(author, article_id, pick) of up to per_author essays of each author, in the order of a seeded hash of their keys."""
    order = Window.partitionBy("author").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("article_id"))), "article_id")
    return essays.select("author", "article_id", F.row_number().over(order).alias("pick")).where(F.col("pick") <= per_author)


def manifest(essays: DataFrame) -> DataFrame:
    """(author, article_id, tokens) of essays, by author and key."""
    return essays.select("author", "article_id", F.size(T.tokens("text")).alias("tokens")).orderBy("author", "article_id")


def leave_one_out(targets: DataFrame) -> DataFrame:
    """(fold, author, target_article_id, corpus_articles): a fold for each target, numbered from 0 by author and key.

    The fold's corpus is all other targets of the author; it is counted here and joined by author where it is used, so
    an author with many texts makes no list.
    """
    out = written(numbered(targets.select("author", F.col("article_id").alias("target_article_id")).distinct(), ["author", "target_article_id"], "n"), "targets")
    sizes = out.groupBy(F.col("author").alias("of")).agg(F.count("*").alias("all"))
    both = out.join(sizes, F.col("author").eqNullSafe(F.col("of")))
    return both.select((F.col("n") - 1).cast("long").alias("fold"), "author", "target_article_id", (F.col("all") - 1).alias("corpus_articles"))


def other_articles(essays: DataFrame) -> DataFrame:
    """(article_id, author, n_others, words_others): what an author's other articles offer as context, without pairing them."""
    own = written(essays.select("article_id", "author", T.word_count("text").alias("w")), "words")
    all_ = own.groupBy(F.col("author").alias("of")).agg(F.count("*").alias("n"), F.sum("w").alias("words"))
    both = own.join(all_, F.col("author").eqNullSafe(F.col("of")))
    return both.select("article_id", "author", (F.col("n") - 1).alias("n_others"), (F.col("words") - F.col("w")).cast("long").alias("words_others"))


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row a key: that of the greatest version; the upsert of a later delivery over an earlier one."""
    rest = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*key).agg(newest.alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def usable_recreations(recreations: DataFrame) -> DataFrame:
    """(target_article_id, model_alias, body): the last answer (by rec_id) for an essay and model that isn't blank."""
    named = recreations.select("rec_id", F.coalesce("source_article_id", "article_id").alias("target_article_id"), T.name_key("model_alias").alias("model_alias"), "body")
    kept = named.where(F.col("body").rlike(T.INK) & F.col("target_article_id").isNotNull() & F.col("model_alias").isNotNull())
    return latest(kept, ["target_article_id", "model_alias"], ["rec_id"])


def missing(targets: DataFrame, have: DataFrame, key: str = "target_article_id") -> DataFrame:
    """Targets that have no row; a run is complete when there are none."""
    return targets.join(have.select(key).distinct(), key, "left_anti")


def _sum_rows(batches):
    """Per batch the sums of vectors of each key, a row a key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
        vec = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        at = np.fromiter((order[k] for k in keys), np.int64, len(keys))
        by = np.argsort(at, kind="stable")
        sums = np.add.reduceat(vec[by], np.searchsorted(at[by], np.arange(len(order))), axis=0)
        yield _sum_batch(list(order), np.bincount(at), sums, batch.schema)


def _merged_rows(batches):
    """Rows (keys, n, s) in the order of their keys, a row a key; only one key's sums are held on to."""
    key, n, s, schema = None, 0, None, None
    for batch in batches:
        schema = batch.schema
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:-2])))
        counts, vec = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(max(len(keys), 1), -1)
        edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        done = []
        for b, e in zip(edges, [*edges[1:], len(keys)]):
            if s is not None and keys[b] == key:
                n, s = n + counts[b:e].sum(), s + vec[b:e].sum(axis=0)
                continue
            if s is not None:
                done.append((key, n, s))
            key, n, s = keys[b], counts[b:e].sum(), vec[b:e].sum(axis=0)
        if done:
            yield _sum_batch([k for k, _, _ in done], np.array([m for _, m, _ in done]), np.stack([v for _, _, v in done]), schema)
    if s is not None:
        yield _sum_batch([key], np.array([n]), s[None], schema)


def _sum_batch(keys, n, sums, schema):
    names = [f"k{i}" for i in range(len(keys[0]))]
    cols = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*keys))]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), lists], [*names, "n", "s"])


def vector_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, s): vectors vec added up by keys, batch by batch first; what is moved is a row a key and batch."""
    cols = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "vec")
    names = cols.columns[:-1]
    schema = ", ".join(f"{n} {t}" for n, t in cols.dtypes[:-1]) + ", n long, s array<double>"
    part = cols.mapInArrow(_sum_rows, schema)
    total = part.repartition(*names).sortWithinPartitions(*names).mapInArrow(_merged_rows, schema)
    return total.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "n", "s")


def mean_cosine(s: Column, n: Column, t: Column, m: Column) -> Column:
    """Mean cosine distance between two groups of unit vectors from their sums and numbers; NaN if one is empty."""
    return F.when((n > 0) & (m > 0), 1 - V.dot(s, t) / (n * m)).otherwise(float("nan"))


def score_folds(essays: DataFrame, reference: DataFrame, recreations: DataFrame, chunk_size: int, fill: float = chunking.MIN_FILL, n_words: int = 100) -> DataFrame:
    """(author, target_article_id, model_alias, natural/generated/corpus_n_chunks, natural/generated_mean_distance, delta).

    Natural essays are those that were recreated; vocabulary from their chunks, means and deviations from the reference
    texts alone. A fold's distance is the mean over all pairs of a target's (or its recreation's) chunks and the chunks
    of the author's other natural essays, from vector sums: linear in the chunks, and no pairs are made.
    """
    made = usable_recreations(recreations)
    natural = essays.join(made.select(F.col("target_article_id").alias("article_id")).distinct(), "article_id", "left_semi")
    author = natural.select(F.col("article_id").alias("target_article_id"), "author")
    chunk = lambda a: chunking.serialized(chunking.chunk_articles(a, chunk_size, fill)).select(F.col("chunk_id").alias("id"), F.col("source_doc_id").alias("doc"), "author", F.col("token_text").alias("text"))
    own = written(chunk(natural), "natural")
    answers = made.join(author, "target_article_id").select("author", F.col("model_alias").alias("config"), F.lit("generated").alias("split"), F.concat("target_article_id", F.lit("|"), "model_alias").alias("article_id"), F.col("body").alias("text"))
    gen = written(chunk(answers), "generated")
    ref = reference.select(F.col("article_id").alias("id"), "text")
    space = features.MostFrequentWords(n_words).fit(own, ref)
    unit = lambda docs: space.standardized(docs, keep=["doc"]).select("id", "doc", V.unit(F.col("vec")).alias("vec"))
    nat = written(vector_sums(unit(own), "doc"), "sums").select(F.col("doc").alias("target_article_id"), F.col("n").alias("tn"), F.col("s").alias("ts"))
    g = vector_sums(unit(gen), "doc").select(F.col("doc").alias("gen_id"), F.col("n").alias("gn"), F.col("s").alias("gs"))
    total = vector_sums(nat.join(author, "target_article_id").select("author", F.col("ts").alias("vec")), "author").select("author", F.col("s").alias("us"))
    chunks_of = nat.join(author, "target_article_id").groupBy("author").agg(F.sum("tn").alias("un"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(space.size)), lambda i: F.lit(0.0))
    base = made.select("target_article_id", "model_alias").join(author, "target_article_id").withColumn("gen_id", F.concat("target_article_id", F.lit("|"), "model_alias"))
    full = base.join(nat, "target_article_id", "left").join(total, "author", "left").join(chunks_of, "author", "left").join(g, "gen_id", "left")
    full = full.select("author", "target_article_id", "model_alias", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tn", "gn", "un")), *(F.coalesce(c, zero).alias(c) for c in ("ts", "gs", "us")))
    rest, cn = F.zip_with("us", "ts", lambda x, y: x - y), F.col("un") - F.col("tn")
    out = full.withColumn("cs", rest).withColumn("cn", cn).withColumn("nat", mean_cosine(F.col("ts"), F.col("tn"), F.col("cs"), F.col("cn"))).withColumn("gen", mean_cosine(F.col("gs"), F.col("gn"), F.col("cs"), F.col("cn")))
    return out.select(
        "author", "target_article_id", "model_alias", F.col("tn").alias("natural_n_chunks"), F.col("gn").alias("generated_n_chunks"), F.col("cn").alias("corpus_n_chunks"),
        F.col("nat").alias("natural_mean_distance"), F.col("gen").alias("generated_mean_distance"), (F.col("gen") - F.col("nat")).alias("delta_natural_vs_generated"),
    )
