"""Experiments: the models asked for, a selection and its manifest, what targets have so far, and prompts with context."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.folds import sampled_essays
from inkstone.plans.ranks import numbered
from inkstone.sources import generation

#: Rows that an error names.
NAMED = 20


def resolved(asked: DataFrame | None, models: DataFrame) -> DataFrame:
    """(model_alias, model_slug, known) of each alias asked for, or of all known ones; an unknown one has no slug and is to be skipped."""
    known = models.select(T.name_key("model_alias").alias("model_alias"), "model_slug").where("model_alias is not null").groupBy("model_alias").agg(F.min("model_slug").alias("model_slug"))
    names = known.select("model_alias") if asked is None else asked.select(T.name_key("model_alias").alias("model_alias")).where("model_alias is not null").distinct()
    return names.join(known.withColumn("known", F.lit(True)), "model_alias", "left").select("model_alias", "model_slug", F.coalesce("known", F.lit(False)).alias("known"))


def selected(essays: DataFrame, authors: int, per_author: int, seed: int = 1729) -> DataFrame:
    """(author, article_id, pick) of per_author essays of each of so many authors who have as many, in the order of seeded hashes.

    ValueError if a number isn't positive or too few authors have enough essays.
    """
    if authors < 1 or per_author < 1:
        raise ValueError("authors and essays per author must be positive")
    enough = essays.groupBy("author").agg(F.count("*").alias("n")).where(F.col("n") >= per_author)
    drawn = enough.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("author"))), "author").limit(authors).select("author").collect()  # the number asked for
    if len(drawn) < authors:
        raise ValueError(f"only {len(drawn)} authors have {per_author} essays")
    return sampled_essays(essays.where(F.col("author").isin([r.author for r in drawn])), per_author, seed)


def manifest_document(essays: DataFrame, picked: DataFrame, **header) -> dict:
    """The manifest of a selection: the settings, then its essays with their tokens, by author and key."""
    rows = picked.join(essays.select("article_id", F.size(T.tokens("text")).alias("tokens")), "article_id").orderBy("author", "article_id").select("author", "article_id", "tokens")
    return {**header, "essays": [r.asDict() for r in rows.collect()]}  # a selection's rows


def manifest_rows(spark, document: dict) -> DataFrame:
    """(author, article_id, tokens) of a manifest; ValueError if it lists no essays or one twice."""
    rows = [(r["author"], r["article_id"], r["tokens"]) for r in document.get("essays", ())]
    if not rows or len({r[1] for r in rows}) < len(rows):
        raise ValueError("a manifest lists essays, each once")
    return spark.createDataFrame(rows, "author string, article_id string, tokens long")


def uneven(targets: DataFrame, per_author: int) -> DataFrame:
    """(author, n) of authors who haven't per_author targets."""
    return targets.groupBy("author").agg(F.count("*").alias("n")).where(F.col("n") != per_author)


def enforce_even(targets: DataFrame, per_author: int) -> None:
    if bad := uneven(targets, per_author).limit(NAMED).collect():
        raise ValueError("uneven folds: " + ", ".join(f"{r.author} ({r.n})" for r in bad))


def enforce_present(targets: DataFrame, have: DataFrame, key: str) -> None:
    """Raise ValueError if have lacks any target."""
    if bad := targets.select(key).distinct().join(have.select(key).distinct(), key, "left_anti").limit(NAMED).collect():
        raise ValueError(f"no {key} " + ", ".join(str(r[0]) for r in bad))


def resume(targets: DataFrame, models: Iterable[str], have: DataFrame, value: str) -> DataFrame:
    """(place, article_id, model, value, todo): every target of every model in the targets' order, with a null hole where nothing is there.

    targets: author, article_id. models: a table of models' names. have: article_id, model, value, one row a key.
    """
    placed = numbered(targets.select("author", "article_id").distinct(), ["author", "article_id"], "place")
    grid = placed.select("place", "article_id", F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    both = grid.join(have.select("article_id", "model", value), ["article_id", "model"], "left")
    return both.select("place", "article_id", "model", value, F.col(value).isNull().alias("todo"))


def contexts(essays: DataFrame, picked: DataFrame) -> DataFrame:
    """(article_id, author, context): the author's other selected essays as titled blocks by key; null where there are none.

    picked: author, article_id, a bounded number for each author, so that no author's texts become one unbounded row.
    """
    texts = picked.select("author", "article_id").join(essays.select("article_id", "text"), "article_id")
    other = texts.select("author", F.col("article_id").alias("other"), "text")
    pairs = picked.select("author", "article_id").join(other, "author").where("article_id <> other")
    block = F.concat(F.lit("--- "), F.col("other"), F.lit(" ---\n"), F.col("text"))
    made = pairs.select("article_id", F.struct("other", block.alias("block")).alias("b")).groupBy("article_id").agg(F.sort_array(F.collect_list("b")).alias("b"))  # a selection's texts
    context = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return picked.select("article_id", "author").join(made, "article_id", "left").select("article_id", "author", context.alias("context"))


def fold_corpus(picked: DataFrame) -> DataFrame:
    """(author, target_article_id, corpus_article_id): the texts that each selected essay's fold is held against, the author's other selected ones."""
    other = picked.select("author", F.col("article_id").alias("corpus_article_id"))
    return picked.select("author", F.col("article_id").alias("target_article_id")).join(other, "author").where("target_article_id <> corpus_article_id")


def recreation_prompts(essays: DataFrame, picked: DataFrame, details: DataFrame) -> DataFrame:
    """(article_id, model_slug, prompt) for each selected essay's assignments; details: article_id, model_slug, assignment, one row a key."""
    both = details.where("assignment is not null").join(contexts(essays, picked), "article_id")
    return both.select("article_id", "model_slug", generation.recreation_prompt(F.col("assignment"), F.col("context")).alias("prompt"))


def detail_prompts(essays: DataFrame) -> DataFrame:
    """(article_id, prompt): what asks for the assignment of an essay, under its key as title."""
    return essays.select("article_id", generation.assignment_prompt(F.col("author"), F.col("article_id"), T.word_count("text")).alias("prompt"))


def generated_id(article_id):
    """Column: the id of a recreation of an article."""
    return F.concat(article_id, F.lit("::gen"))
