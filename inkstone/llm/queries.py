"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import cross_split, eval_leaks, group_splits, lang_labels, mixing, pairs, pieces, shared_spans, tokens
from inkstone.llm.oracle import SQL  # noqa: F401
from inkstone.plans.lineage import written
from inkstone.sources import corpus


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return corpus.table(spark, d, name)


# Problem 1


def _p1_records(spark, d):
    essays = _t(spark, d, "essays").select(F.lit("essays").alias("rec_table"), F.col("article_id").alias("rec_key"), "text")
    recreations = _t(spark, d, "recreation").select(F.lit("recreation").alias("rec_table"), F.col("rec_id").cast("string").alias("rec_key"), F.col("body").alias("text"))
    return essays.unionByName(recreations)


def p1_found(spark, d):
    return shared_spans.spans(shared_spans.factors(_p1_records(spark, d)))


def p1_factors(spark, d):
    return shared_spans.factors(_p1_records(spark, d))


def p1_shared(spark, d):
    records = _p1_records(spark, d)
    return shared_spans.shared_amount(shared_spans.spans(shared_spans.factors(records)), records)


# Problem 2


def p2_found(spark, d):
    return group_splits.linked_authors(_t(spark, d, "chunk"))


def p2_forest(spark, d):
    forest = group_splits.author_components(_t(spark, d, "chunk"))[1]
    return forest.select(F.col("a").alias("author_a"), F.col("b").alias("author_b"), F.col("weight").alias("source_doc_id"))


def p2_members(spark, d):
    return group_splits.members(_t(spark, d, "chunk"))


def p2_splits(spark, d):
    return group_splits.splits(_t(spark, d, "chunk"))


# Problem 3


def _p3(spark, d):
    return pieces.essay_pieces(_t(spark, d, "essays")).union(pieces.chunk_pieces(_t(spark, d, "chunk")))


def p3_pieces(spark, d):
    """All pieces; the text of a chunk's piece is its tokens, joined by spaces."""
    return _p3(spark, d).withColumn("text", F.coalesce("text", F.array_join("tokens", " ", ""))).drop("tokens")


def p3_found(spark, d):
    return _p3(spark, d).groupBy("item_table", "item_id").agg(F.max("piece").alias("last")).where("last > 0").select("item_table", "item_id")


# Problem 4


def p4_defects(spark, d):
    detail = _t(spark, d, "detail")
    prompt = detail.where("assignment is not null").groupBy("article_id", "model_slug").agg(F.max("assignment").alias("prompt"))
    recreations = _t(spark, d, "recreation").where("rec_id is not null")
    both = recreations.join(prompt, ["article_id", "model_slug"], "left").select("rec_id", "body", "word_count", "prompt")
    return pairs.defects(both, detail.select("title"), _t(spark, d, "lang_samples"))


def p4_found(spark, d):
    return p4_defects(spark, d).where("rank = 1").select("rec_id", "defect")


# Problems 5, 8 and 9


_P5_GROUPS = ["source", "lang", "topic"]


def _p5_sized(spark, d):
    """Tokens of essays and recreations by source, language and topic; blank names are null, each key counts once."""
    tidy = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    essays = _t(spark, d, "essays").select("article_id", tidy("config").alias("source"), tidy("lang").alias("lang"), tidy("topic").alias("topic"), "text")
    essays = written(tokens.once(tokens.count(essays, "article_id", keep=["source", "lang", "topic"]), "article_id"), "p5-essays")
    made = _t(spark, d, "recreation").select("rec_id", tidy("model_alias").alias("source"), F.coalesce("source_article_id", "article_id").alias("article_id"), "body")
    made = tokens.once(tokens.count(made, "rec_id", "body", keep=["source", "article_id"]), "rec_id")
    place = essays.where("article_id is not null").select("article_id", "lang", "topic")
    return essays.select("source", "lang", "topic", "n_tokens").unionByName(made.join(place, "article_id", "left").select("source", "lang", "topic", "n_tokens"))


def p5_budget(spark, d):
    return tokens.budget(_p5_sized(spark, d), _P5_GROUPS)


def p5_totals(spark, d):
    return tokens.totals(_p5_sized(spark, d), _P5_GROUPS)


def p8_ids(spark, d):
    return tokens.encode(_t(spark, d, "documents"))


def _p9(spark, d):
    documents = _t(spark, d, "documents")
    sized = written(tokens.once(tokens.count(documents, keep=["source"])), "p9-sizes")
    budgets, chosen = mixing.plan(sized, _t(spark, d, "source_weights"))
    budgets = written(budgets, "p9-budgets")
    return budgets, mixing.draw(sized, written(chosen, "p9-lengths"))


def p9_shares(spark, d):
    return mixing.shares(*_p9(spark, d))


def p9_drawn(spark, d):
    return _p9(spark, d)[1]


# Problems 6 and 7


def _split():
    return F.lower(F.trim("split"))


def p6_found(spark, d):
    tests = _t(spark, d, "essays").where(_split().isin("test", "validation"))
    return eval_leaks.leaks(tests, _t(spark, d, "reference_corpus")).select(F.col("corpus_key").alias("corpus_article_id"), F.col("test_key").alias("test_article_id"))


def _p7_pairs(spark, d):
    essays = _t(spark, d, "essays")
    return cross_split.overlaps(essays.where(_split().isin("test", "validation")), essays.where(_split() == "train"))


def p7_found(spark, d):
    return _p7_pairs(spark, d).select(F.least("eval_key", "train_key").alias("article_id_a"), F.greatest("eval_key", "train_key").alias("article_id_b")).distinct()


def p7_report(spark, d):
    """Evaluation essays with an overlap, and overlaps, by split and config of the evaluation essay."""
    place = _t(spark, d, "essays").where("article_id is not null").groupBy(F.col("article_id").alias("eval_key")).agg(F.min(_split()).alias("split"), F.min(F.lower(F.trim("config"))).alias("config"))
    return _p7_pairs(spark, d).join(place, "eval_key").groupBy("split", "config").agg(F.count("*").alias("pairs"), F.countDistinct("eval_key").alias("eval_essays"), F.countDistinct("train_key").alias("train_essays"))


# Problem 10


def p10_found(spark, d):
    return lang_labels.unnamed(_t(spark, d, "documents"), _t(spark, d, "lang_samples"))


def p10_languages(spark, d):
    return lang_labels.languages(_t(spark, d, "documents"), _t(spark, d, "lang_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_factors, p1_shared, p2_found, p2_forest, p2_members, p2_splits, p3_found, p3_pieces, p4_found, p4_defects, p5_budget, p5_totals, p6_found, p7_found, p7_report, p8_ids, p9_drawn, p9_shares, p10_found, p10_languages)}
