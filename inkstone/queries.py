"""The registered queries of the stylometry operators, over whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.operators import chunking, distance, evaluation, experiment, features, folds, leakage, reports
from inkstone.plans.lineage import written
from inkstone.plans.ranks import numbered
from inkstone.sources import corpus

CHUNK = 200
FOLD_CHUNK = 100
WORDS = 100
PERMUTATIONS = 250
FEWEST_CHUNKS = 12
SAMPLE = 5


def _t(spark, d, name) -> DataFrame:
    return corpus.table(spark, d, name)


# Corpus and text


def text_normalized(spark, d):
    n = T.normalize("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("n_chars_norm"))


def text_counts(spark, d):
    return _t(spark, d, "documents").select(
        "doc_id", F.size(T.words("text")).alias("n_words"), F.size(T.tokens("text")).alias("n_tokens"), T.word_count("text").alias("n_pieces"), T.model_tokens("text").alias("model_tokens")
    )


def test_articles(spark, d):
    return corpus.test_slice(spark, d).select("article_id", "author", "config", "split", "topic", "lang", F.md5("text").alias("text_md5"))


def reference_articles(spark, d):
    return corpus.reference_slice(spark, d).select("article_id", "author", "config", "split", F.md5("text").alias("text_md5"))


def article_summary(spark, d):
    return chunking.article_report(corpus.test_slice(spark, d).unionByName(corpus.reference_slice(spark, d)))


def config_split_counts(spark, d):
    both = corpus.test_slice(spark, d).unionByName(corpus.reference_slice(spark, d))
    return both.groupBy("config", "split").agg(F.count("*").alias("n_articles"), F.countDistinct("author").alias("n_authors"))


def reference_overlap(spark, d):
    """Test articles whose text, white space aside, is also a reference article's."""
    ref = corpus.reference_slice(spark, d).select(F.md5(T.normalize("text")).alias("h"))
    return corpus.test_slice(spark, d).withColumn("h", F.md5(T.normalize("text"))).join(ref, "h", "left_semi").select("article_id", "author", "h")


def text_extraction(spark, d):
    """First filled of body, title and article id; the model's last path part; a title of last resort."""
    r = _t(spark, d, "recreation").dropDuplicates(["rec_id"])
    return r.select("rec_id", F.md5(T.first_filled("body", "title", "article_id")).alias("text_md5"), T.last_part("model_slug").alias("model"), T.first_filled(F.trim("title"), F.trim("article_id")).alias("title"), F.coalesce("source_article_id", "article_id").alias("essay_id"))


def prompt_tokens(spark, d):
    """Estimated tokens of the framed recreation prompts, by model: the assignment and the author's other essays as context."""
    det = _t(spark, d, "detail").where("assignment is not null").groupBy("article_id", "model_slug").agg(F.max("assignment").alias("assignment"))
    rec = folds.latest(_t(spark, d, "recreation").select("rec_id", "article_id", "model_slug", "body"), ["article_id", "model_slug"], ["rec_id"])
    ctx = folds.other_articles(corpus.test_slice(spark, d)).select("article_id", "words_others")
    both = rec.join(det, ["article_id", "model_slug"]).join(ctx, "article_id")
    context = F.bround(F.col("words_others") * F.lit(T.TOKENS_PER_WORD)).cast("long") + T.FRAME
    return both.groupBy("model_slug").agg(F.count("*").alias("n"), F.sum(T.message_tokens("assignment") + context).alias("input_tokens"), F.sum(T.model_tokens("body")).alias("output_tokens"))


def _details(spark, d):
    det = _t(spark, d, "detail").where("article_id is not null and assignment is not null").groupBy("article_id", "model_slug").agg(F.max("assignment").alias("assignment"))
    return det.where("model_slug is not null")


def detail_tokens(spark, d):
    """Estimated tokens of the assignments and of the framed essays they were made from, by author; details without an essay are left out."""
    both = _details(spark, d).join(corpus.test_slice(spark, d).select("article_id", "author", "text"), "article_id")
    return both.groupBy("author").agg(F.count("*").alias("n"), F.sum(T.message_tokens("text")).alias("input_tokens"), F.sum(T.model_tokens("assignment")).alias("output_tokens"))


def recreation_tokens(spark, d):
    """Estimated tokens of the usable recreations and of their framed assignments, by author and model."""
    det = _details(spark, d)
    rec = folds.latest(_t(spark, d, "recreation").select("rec_id", "article_id", "model_slug", "body"), ["article_id", "model_slug"], ["rec_id"])
    both = rec.join(det, ["article_id", "model_slug"]).join(corpus.test_slice(spark, d).select("article_id", "author"), "article_id")
    return both.groupBy("author", "model_slug").agg(F.count("*").alias("n"), F.sum(T.message_tokens("assignment")).alias("input_tokens"), F.sum(T.model_tokens("body")).alias("output_tokens"))


def recreation_prompts(spark, d):
    """Prompts for the sampled essays' assignments, with the author's other sampled essays as context."""
    essays = corpus.test_slice(spark, d)
    made = experiment.recreation_prompts(essays, folds.sampled_essays(essays, SAMPLE), _details(spark, d))
    return made.select("article_id", "model_slug", F.md5("prompt").alias("prompt_md5"), T.message_tokens("prompt").alias("tokens"))


def author_context(spark, d):
    return folds.other_articles(corpus.test_slice(spark, d))


# Chunks


def _chunks(spark, d, size=CHUNK):
    return chunking.chunk_articles(corpus.test_slice(spark, d), size)


def chunks(spark, d):
    return chunking.serialized(_chunks(spark, d)).select("chunk_id", "author", "config", "split", "source_doc_id", "chunk_index", "n_tokens", F.md5("token_text").alias("token_md5"))


def chunk_report(spark, d):
    return chunking.chunk_report(_chunks(spark, d))


def stored_chunk_report(spark, d):
    """The report on the stored chunks, each key once, with tokens counted anew."""
    c = _t(spark, d, "chunk").where("chunk_id is not null").groupBy("chunk_id").agg(F.min(T.name_key("author")).alias("author"), F.min("source_doc_id").alias("source_doc_id"), F.max(F.size("tokens")).alias("n_tokens"))
    return chunking.chunk_report(c)


def few_chunks(spark, d):
    return chunking.too_few(_chunks(spark, d), FEWEST_CHUNKS)


# Features


def _docs(spark, d, size=CHUNK):
    return chunking.serialized(_chunks(spark, d, size)).select(F.col("chunk_id").alias("id"), F.col("source_doc_id").alias("doc"), "author", "chunk_index", F.col("token_text").alias("text"))


def _reference(spark, d):
    return corpus.reference_slice(spark, d).select(F.col("article_id").alias("id"), "text")


def _space(spark, d, docs):
    return features.MostFrequentWords(WORDS, order=["doc", "chunk_index"]).fit(docs, _reference(spark, d))


def mfw_vocabulary(spark, d):
    return features.most_frequent(_docs(spark, d), WORDS, ["doc", "chunk_index"])


def mfw_head(spark, d):
    return mfw_vocabulary(spark, d).where("idx < 50")


def mfw_frequencies(spark, d):
    docs = written(_docs(spark, d), "docs")
    vocab = [r.term for r in features.most_frequent(docs, WORDS, ["doc", "chunk_index"]).orderBy("idx").collect()]  # WORDS rows
    return features.frequencies(docs, vocab).select("id", "idx", F.round("rf", 9).alias("rf"))


def mfw_reference_stats(spark, d):
    s = _space(spark, d, written(_docs(spark, d), "docs"))
    return s.stats.join(s.vocab, "idx").select("idx", "term", F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"))


def _deviations(spark, d):
    docs = written(_docs(spark, d), "docs")
    return _space(spark, d, docs).standardized(docs, ["doc", "author"])


def _standard(spark, d):
    return written(_deviations(spark, d), "standard")


def mfw_zscores(spark, d):
    return _deviations(spark, d).select("id", F.posexplode("vec").alias("idx", "z")).select("id", "idx", F.round("z", 6).alias("z"))


def _essay_texts(spark, d):
    return written(corpus.test_slice(spark, d).select(F.col("article_id").alias("id"), F.col("article_id").alias("doc"), "author", "text"), "essays")


def _char_weights(spark, d):
    docs = _essay_texts(spark, d)
    return features.CharNGrams().fit(docs).transform(docs)


def _idf(lists, docs, **limits):
    return features.idf_of(lists, docs.count(), **limits)


def char_gram_idf(spark, d):
    docs = _essay_texts(spark, d)
    return _idf(features.CharNGrams().lists(docs), docs).select("gram", "df", F.round("idf", 9).alias("idf"))


def char_gram_weights(spark, d):
    return _char_weights(spark, d).select("id", F.explode(F.arrays_zip("terms", "w")).alias("x")).select("id", F.col("x.terms").alias("gram"), F.round("x.w", 9).alias("w"))


def char_gram_top(spark, d):
    """The 500 most frequent grams as vocabulary."""
    docs = _essay_texts(spark, d)
    return _idf(features.CharNGrams().lists(docs), docs, max_features=500).select("gram", "df")


def content_words(spark, d):
    w = _essay_texts(spark, d).select("author", F.explode(leakage.content_words("text")).alias("word"))
    return w.groupBy("author").agg(F.count("*").alias("n_content"), F.countDistinct("word").alias("n_different"))


def leakage_idf(spark, d):
    docs = _essay_texts(spark, d)
    return _idf(features.term_lists(docs, T.long_words("text")), docs).select(F.col("gram").alias("word"), "df", F.round("idf", 9).alias("idf"))


def leakage_folds(spark, d):
    return leakage.folds_of(_essay_texts(spark, d))


def leakage_check(spark, d):
    return leakage.leakage_check(_essay_texts(spark, d))


def chunk_drift(spark, d):
    """Cosine distance of each chunk's deviations to those of the chunk before it in its document."""
    rows = written(_standard(spark, d), "drift").withColumn("place", F.substring_index("id", "::c", -1).cast("int"))
    before = rows.select("doc", (F.col("place") + 1).alias("place"), F.col("vec").alias("before"))
    return rows.join(before, ["doc", "place"]).select("id", F.round(V.cosine_distance(F.col("vec"), F.col("before")), 6).alias("distance"))


# Distances: rows against all rows; of vectors each twentieth


def _twentieth(rows, key="id"):
    return rows.where(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 20 == 0)


def _found(n):
    return n.select("query", "id", F.col("d").alias("distance"), "rank")


def cosine_delta_nearest(spark, d):
    rows = distance.unit_rows(_standard(spark, d))
    return _found(distance.nearest(rows, _twentieth(rows)))


def burrows_delta_nearest(spark, d):
    rows = _standard(spark, d)
    return _found(distance.nearest(rows, _twentieth(rows), "manhattan", places=5))


def _sparse(spark, d):
    """Rows of grams, an author's together: the texts are put in order, as they are smaller."""
    texts = corpus.test_slice(spark, d).select(F.col("article_id").alias("id"), F.col("article_id").alias("doc"), "author", "text")
    docs = written(texts.repartitionByRange(F.xxhash64("author")).sortWithinPartitions(F.xxhash64("author")), "essays")
    return features.CharNGrams().fit(docs).rows(docs)


def char_gram_nearest(spark, d):
    """Of every essay."""
    rows = _sparse(spark, d)
    return _found(distance.nearest(rows, rows))


def _embeddings(spark, d):
    return _t(spark, d, "embeddings").where("embedding is not null").select(F.format_string("%08d", "vec_id").alias("id"), F.col("vec_id").cast("string").alias("doc"), F.col("label").cast("string").alias("author"), F.col("embedding").cast("array<double>").alias("vec"), "vec_id")


def embedding_cosine_nearest(spark, d):
    rows = distance.unit_rows(_embeddings(spark, d))
    return _found(distance.nearest(rows, rows.where("vec_id % 20 = 0")))


def embedding_l1_nearest(spark, d):
    rows = _embeddings(spark, d)
    return _found(distance.nearest(rows, rows.where("vec_id % 20 = 0"), "manhattan"))


# Evaluation


def auc_cosine_delta(spark, d):
    return evaluation.auc(distance.pair_histogram(distance.unit_rows(_standard(spark, d))))


def auc_burrows_delta(spark, d):
    return evaluation.auc(distance.pair_histogram(_standard(spark, d), "manhattan"))


def auc_char_gram(spark, d):
    return evaluation.auc(distance.pair_histogram(_sparse(spark, d)))


def auc_embedding(spark, d):
    return evaluation.auc(distance.pair_histogram(distance.unit_rows(_embeddings(spark, d))))


def permutation_auc(spark, d):
    rows = distance.unit_rows(_standard(spark, d))
    return evaluation.permutation_test(rows, PERMUTATIONS).select("k", "n_self", F.round("auc", 6).alias("auc"))


def permutation_summary(spark, d):
    blocks = distance.packed(distance.unit_rows(_standard(spark, d)), ids=True)
    steps = written(distance.pair_histogram(blocks), "steps")
    observed = evaluation.auc(steps, places=12).first().auc
    s = evaluation.permutation_summary(evaluation.permutation_test(blocks, PERMUTATIONS, histogram=steps), observed)
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def distance_histogram(spark, d):
    return evaluation.histogram_bins(distance.pair_histogram(distance.unit_rows(_standard(spark, d))))


def author_distances(spark, d):
    return evaluation.author_matrix(_standard(spark, d)).select("author_i", "author_j", "n_pairs", F.round("mean_distance", 6).alias("mean_distance"))


def author_distances_burrows(spark, d):
    return distance.author_means(_standard(spark, d), "manhattan").select("author_i", "author_j", "n_pairs", F.round("mean_distance", 5).alias("mean_distance"))


def author_distances_char_gram(spark, d):
    return distance.author_means(_sparse(spark, d)).select("author_i", "author_j", "n_pairs", F.round("mean_distance", 6).alias("mean_distance"))


def author_similarity(spark, d, normalize=True):
    m = written(evaluation.author_matrix(_standard(spark, d)), "matrix")
    return evaluation.similarity(m, normalize).select("author_i", "author_j", F.round("similarity", 6).alias("similarity"))


# Folds


def _targets(spark, d):
    made = folds.usable_recreations(_t(spark, d, "recreation"))
    return corpus.test_slice(spark, d).join(made.select(F.col("target_article_id").alias("article_id")).distinct(), "article_id", "left_semi")


def essay_sample(spark, d):
    return folds.sampled_essays(corpus.test_slice(spark, d), SAMPLE)


def essay_manifest(spark, d):
    return folds.manifest(corpus.test_slice(spark, d))


def leave_one_out(spark, d):
    return folds.leave_one_out(_targets(spark, d))


def detail_upsert(spark, d):
    r = folds.latest(_t(spark, d, "detail").where("article_id is not null and assignment is not null").select("article_id", "model_slug", "assignment"), ["article_id", "model_slug"], ["assignment"])
    return r.select("article_id", "model_slug", F.md5("assignment").alias("assignment_md5"))


def usable_recreations(spark, d):
    return folds.usable_recreations(_t(spark, d, "recreation")).select("target_article_id", "model_alias", "rec_id", experiment.generated_id("target_article_id").alias("gen_id"), F.md5("body").alias("body_md5"))


def missing_recreations(spark, d):
    targets = corpus.test_slice(spark, d).select(F.col("article_id").alias("target_article_id"), "author")
    return folds.missing(targets, folds.usable_recreations(_t(spark, d, "recreation")))


def model_aliases(spark, d):
    """All requested aliases, and whether the model map knows them; the others are skipped."""
    return experiment.resolved(_t(spark, d, "recreation"), _t(spark, d, "model_map"))


def uneven_authors(spark, d):
    """Authors of the sample who haven't the full number of essays."""
    return experiment.uneven(folds.sampled_essays(corpus.test_slice(spark, d), SAMPLE), SAMPLE)


def fold_corpus(spark, d):
    return experiment.fold_corpus(folds.sampled_essays(corpus.test_slice(spark, d), SAMPLE))


def largest_authors(spark, d):
    """The test articles of the three authors with most of them."""
    essays = corpus.test_slice(spark, d)
    names = [r.author for r in essays.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(3).collect()]
    return corpus.articles(_t(spark, d, "essays"), names, (corpus.TEST_CONFIG,)).select("article_id", "author")


def char_gram_names(spark, d):
    """The vocabulary of character grams in its order."""
    names = features.CharNGrams().fit(_essay_texts(spark, d)).names()
    return numbered(names, ["gram"], "n").select((F.col("n") - 1).alias("idx"), "gram")


def _model_names(spark, d, column="model_alias"):
    return sorted(r[0] for r in _t(spark, d, "model_map").select(T.name_key(column) if column == "model_alias" else column).distinct().collect() if r[0])  # a table of models


def detail_resume(spark, d):
    """What is there of every essay's assignment by every model, in the order of a run; holes are still to be done."""
    have = _details(spark, d).select("article_id", F.col("model_slug").alias("model"), F.md5("assignment").alias("assignment_md5"))
    return experiment.resume(corpus.test_slice(spark, d), _model_names(spark, d, "model_slug"), have, "assignment_md5")


def article_ids(spark, d):
    """The id of every essay row without a usable one, built of its config, split, author and place."""
    return corpus.numbered_ids(_t(spark, d, "essays")).where("built").select("article_id", F.md5("text").alias("text_md5"))


def known_models(spark, d):
    """Requested aliases (those of recreations) that the model map knows, with their slug."""
    asked = _t(spark, d, "recreation").select(T.name_key("model_alias").alias("model_alias")).where("model_alias is not null").distinct()
    return asked.join(F.broadcast(_t(spark, d, "model_map").select(T.name_key("model_alias").alias("model_alias"), "model_slug")), "model_alias")  # a table of models


def fold_scores(spark, d):
    s = folds.score_folds(corpus.test_slice(spark, d), corpus.reference_slice(spark, d), _t(spark, d, "recreation"), FOLD_CHUNK, n_words=WORDS)
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("bigint", "int") else F.col(c) for c, t in s.dtypes))


# Reports


def _folds(spark, d):
    return reports.folds(_t(spark, d, "fold_result"))


def _report(f):
    return lambda spark, d: f(_folds(spark, d))


def author_breakdown(spark, d):
    return reports.author_breakdown(_folds(spark, d), _model_names(spark, d))


def trick_grid(spark, d):
    return reports.trick_grid(_folds(spark, d), _model_names(spark, d))


def jaccard(spark, d):
    return reports.jaccard(_folds(spark, d), _t(spark, d, "model_map"))


def detection_roc(spark, d):
    return evaluation.roc_points(reports.detection_scores(_folds(spark, d)), ["model_alias"])


QUERIES = {
    f.__name__: f
    for f in (
        text_normalized, text_counts, test_articles, reference_articles, article_summary, config_split_counts, reference_overlap, text_extraction, prompt_tokens, author_context,
        chunks, chunk_report, stored_chunk_report, few_chunks, mfw_vocabulary, mfw_head, mfw_frequencies, mfw_reference_stats, mfw_zscores, char_gram_idf, char_gram_weights, char_gram_top,
        content_words, leakage_idf, leakage_folds, leakage_check, cosine_delta_nearest, burrows_delta_nearest, char_gram_nearest, embedding_cosine_nearest, embedding_l1_nearest,
        auc_cosine_delta, auc_burrows_delta, auc_char_gram, auc_embedding, permutation_auc, permutation_summary, distance_histogram, author_distances,
        essay_sample, essay_manifest, leave_one_out, detail_upsert, usable_recreations, missing_recreations, known_models, fold_scores, author_breakdown, jaccard, detection_roc,
        fold_corpus, largest_authors, char_gram_names, author_distances_burrows, author_distances_char_gram, detail_tokens, recreation_tokens, recreation_prompts, model_aliases, uneven_authors, detail_resume, article_ids, trick_grid, chunk_drift,
    )
} | {
    "author_similarity_normalized": author_similarity,
    "author_similarity_raw": partial(author_similarity, normalize=False),
    "kept_dropped_folds": _report(reports.kept_and_dropped),
    "fold_summary": _report(reports.summary),
    "fold_summary_model": _report(lambda f: reports.summary(f, "model_alias")),
    "fold_summary_author": _report(lambda f: reports.summary(f, "model_alias", "author")),
    "natural_pool": _report(reports.natural_pool),
    "ranking_distance": _report(reports.ranking),
    "ranking_match": _report(lambda f: reports.ranking(f, match=True)),
    "tricks_by_model": _report(reports.tricks),
    "tricks_by_author": _report(lambda f: reports.tricks_by(f, "author")),
    "tricks_by_model_author": _report(lambda f: reports.tricks_by(f, "model_alias", "author")),
    "trick_matrix": _report(reports.trick_matrix),
    "detection_auc": _report(reports.detection_auc),
    "delta_quartiles": _report(reports.delta_quartiles),
    "headline": _report(reports.headline),
    "author_heatmap": _report(reports.author_heatmap),
    "author_order": _report(reports.author_order),
    "model_order": _report(reports.model_order),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return auc_cosine_delta(spark, d)
