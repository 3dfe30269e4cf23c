"""Articles cut into chunks of equal numbers of tokens, and reports on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

CHUNK_TOKENS = 1000
MIN_FILL = 0.8


def chunk_articles(articles: DataFrame, size: int = CHUNK_TOKENS, fill: float = MIN_FILL, tokenize: Callable[[str], Column] = T.tokens) -> DataFrame:
    """chunk_id, author, config, split, source_doc_id, chunk_index, tokens, n_tokens of articles.

    tokenize gives the tokens of a text column as an array column, such as that of a tokenizer at hand. Chunks don't overlap; a last one under size * fill tokens (at least 1) is left out. A text without tokens has none.
    """
    cut = articles.select("author", "config", "split", F.col("article_id").alias("source_doc_id"), tokenize("text").alias("all"))
    n = F.size("all")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = cut.select("author", "config", "split", "source_doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("all", i * size + 1, size))).alias("chunk_index", "tokens"))
    kept = parts.withColumn("n_tokens", F.size("tokens")).where(F.col("n_tokens") >= max(int(size * fill), 1))
    return kept.select(F.format_string("%s::c%03d", "source_doc_id", "chunk_index").alias("chunk_id"), "author", "config", "split", "source_doc_id", "chunk_index", "tokens", "n_tokens")


def serialized(chunks: DataFrame) -> DataFrame:
    """Chunks with token_text, the tokens joined by spaces, in place of tokens."""
    return chunks.withColumn("token_text", F.array_join("tokens", " ")).drop("tokens")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Per author: chunks, their tokens in all, least, most and on average, and source documents."""
    n = F.col("n_tokens")
    return chunks.groupBy("author").agg(
        F.count("*").alias("n_chunks"), F.sum(n).alias("total_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"),
        F.round(F.avg(n), 6).alias("mean_tokens"), F.countDistinct("source_doc_id").alias("n_source_docs"),
    )


def article_report(articles: DataFrame) -> DataFrame:
    """Per author: articles and their words in all, least, most and on average."""
    n = T.word_count("text")
    return articles.groupBy("author").agg(
        F.count("*").alias("n_articles"), F.sum(n).cast("long").alias("total_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.round(F.avg(n), 6).alias("mean_words")
    )


def too_few(chunks: DataFrame, least: int, authors: list[str] | None = None) -> DataFrame:
    """Authors that have chunks, but fewer than least."""
    some = chunks if authors is None else chunks.where(F.col("author").isin(*authors))
    return some.groupBy("author").agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") < least)


def enforce_minimum(chunks: DataFrame, least: int, authors: list[str] | None = None) -> None:
    """Raise ValueError if any author has fewer chunks than least."""
    if bad := too_few(chunks, least, authors).limit(20).collect():
        raise ValueError("too few chunks: " + ", ".join(f"{r.author} ({r.n_chunks})" for r in bad))
