import hashlib
import json
import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.operators import chunking, distance, evaluation, features, folds, leakage, logistic, reports
from inkstone.plans import lineage
from inkstone.plans.ranks import numbered
from inkstone.sources import corpus, sinks

ARTICLE = "article_id string, author string, text string, config string, split string"


def article(key, text, author="Ann Lee"):
    return (key, author, text, "cross_topic_1", "train")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normalize_and_words(spark):
    df = spark.createDataFrame([(1, "  a b\n\nc "), (2, None), (3, ""), (4, "don't stop_1 Ünï")], "i int, t string")
    out = {r.i: r for r in df.select("i", T.normalize("t").alias("n"), T.words("t").alias("w"), T.tokens("t").alias("k"), T.word_count("t").alias("c")).collect()}
    assert out[1].n == "a b c" and out[1].c == 3
    assert out[2].n == "" and out[2].w == [] and out[2].c == 0
    assert out[3].k == []
    assert out[4].w == ["don", "t", "stop_1", "ünï"] and out[4].k == ["don", "'", "t", "stop_1", "Ünï"]


def test_token_estimate_rounds_half_to_even(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in (0, 1, 50, 150)], "t string")
    assert [r[0] for r in df.select(T.model_tokens("t")).collect()] == [0, 1, round(50 * 1.33), round(150 * 1.33)]


def test_char_grams_take_short_words_once():
    got = [g for w in ("a", "bc", "def") for g in features.padded_grams(3, 4)(w)]
    assert got == [" a ", " bc", "bc ", " bc ", " de", "def", "ef ", " def", "def "]


def test_text_of_several_kinds(spark):
    df = spark.createDataFrame([("a", ["b", "c"], (None, "", "t"), 1), (None, None, None, 2)], "s string, l array<string>, r struct<text:string,body:string,title:string>, n int")
    assert [tuple(r) for r in df.select(*(T.text_of(df, c) for c in "slr")).collect()] == [("a", "b c", "t"), ("", "", "")]
    with pytest.raises(TypeError):
        T.text_of(df, "n")
    assert spark.range(1).select(T.lowered(F.lit("A  b C")), T.lowered(F.lit("A  b C"), 2)).first()[:] == ("a  b c", "a b")


def test_article_is_one_whole_row_and_gets_an_id(spark):
    cols = "article_id string, author string, text string, config string, split string, topic string, lang string"
    df = spark.createDataFrame([("1", "b", "x", "c", "s", "t", None), ("1", "a", "y", "c", "s", None, "en"), (None, "a", "p", "c", "s", None, None), ("0", "a", "q", "c", "s", None, None), (None, "a", "p", "c", "s", None, None)], cols)
    assert corpus.articles(df.where("article_id = '1'")).collect()[0][:] == ("1", "a", "y", "c", "s", None, "en")
    got = sorted((r.text, r.article_id, r.built) for r in corpus.numbered_ids(df).collect())
    assert got[0][1] == got[1][1] != got[2][1] and {got[0][1], got[2][1]} == {"c/s/a/0", "c/s/a/1"} and got[3:] == [("x", "1", False), ("y", "1", False)]


def test_name_key_and_fallbacks(spark):
    df = spark.createDataFrame([("  Ann \t LEE ", "", "x/y"), (None, "b", "z"), (" ", None, "q")], "a string, b string, c string")
    assert [tuple(r) for r in df.select(T.name_key("a"), T.first_filled("b", "c"), T.last_part("c")).collect()] == [("ann lee", "x/y", "y"), (None, "b", "z"), (None, "q", "q")]


def test_articles_are_deduplicated_and_filtered(spark):
    rows = [article("1", "a b"), article("1", "a b"), article("2", " \n"), article("3", None), article("4", "x", None), article(None, "y"), article("5", "c", " ann  LEE ")]
    got = corpus.articles(spark.createDataFrame(rows, ARTICLE))
    assert values(got, "article_id", "author") == [("1", "ann lee"), ("5", "ann lee")]
    assert corpus.articles(spark.createDataFrame(rows, ARTICLE), authors=["bob"]).count() == 0


@pytest.mark.parametrize("n, kept", [(100, [10] * 10), (98, [10] * 9 + [8]), (97, [10] * 9), (7, []), (8, [8]), (0, [])])
def test_chunks_keep_full_tails(spark, n, kept):
    a = corpus.articles(spark.createDataFrame([article("1", " ".join(["foo"] * n) or "-")], ARTICLE)).withColumn("text", F.lit(" ".join(["foo"] * n)))
    got = chunking.chunk_articles(a, 10, 0.8).orderBy("chunk_index").collect()
    assert [r.n_tokens for r in got] == kept
    assert [r.chunk_id for r in got] == [f"1::c{i:03d}" for i in range(len(kept))]


def test_minimum_guard(spark):
    chunks = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)], "author string, n_tokens int")
    with pytest.raises(ValueError, match="b"):
        chunking.enforce_minimum(chunks, 2)
    chunking.enforce_minimum(chunks, 2, authors=["a", "nobody"])


DOCS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "birds fly", ""]


def docs(spark, texts=DOCS):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")


def test_vocabulary_breaks_ties_by_first_place(spark):
    got = [r.term for r in features.most_frequent(docs(spark), 4).orderBy("idx").collect()]
    assert got == ["the", "cat", "sat", "dog"]


def test_vectors_and_stats(spark):
    vocab = ["the", "cat", "sat"]
    got = {r.id: r.vec for r in features.vectors(docs(spark), vocab).collect()}
    assert got["d0"] == pytest.approx([2 / 6, 1 / 6, 1 / 6]) and got["d4"] == [0, 0, 0]
    stats = features.column_stats(docs(spark), vocab).orderBy("idx").collect()
    want = np.array([got[f"d{i}"] for i in range(5)])
    assert [r.mu for r in stats] == pytest.approx(want.mean(axis=0)) and [r.sigma for r in stats] == pytest.approx(want.std(axis=0))
    none = features.column_stats(docs(spark).limit(0), vocab).collect()
    assert [(r.mu, r.sigma) for r in none] == [(0, 0)] * 3


def test_extractor_limits():
    for n in (99, 1001):
        with pytest.raises(ValueError):
            features.MostFrequentWords(n)
    with pytest.raises(RuntimeError):
        features.CharNGrams().transform(None)
    with pytest.raises(ValueError):
        features.required_features("none")


def test_tfidf_joined_or_sent_is_the_same(spark, monkeypatch):
    f = features.CharNGrams().fit(docs(spark))
    lists = f.lists(docs(spark))
    sent = {r.id: dict(zip(r.terms, r.w)) for r in features.tfidf(lists, f.idf).collect()}
    monkeypatch.setattr(features, "MOST_TERMS", 0)
    joined = {r.id: dict(zip(r.terms, r.w)) for r in features.tfidf(lists, f.idf).collect()}
    assert sent.keys() == joined.keys() and all(sent[k] == pytest.approx(joined[k]) for k in sent)
    assert sum(w * w for w in sent["d0"].values()) == pytest.approx(1)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, author string, doc string, vec array<double>")


def brute_pairs(rows, metric):
    out = []
    for i, (_, a, d, u) in enumerate(rows):
        for _, b, e, v in rows[i + 1 :]:
            if d != e:
                u1, v1 = np.array(u), np.array(v)
                dist = 1 - u1 @ v1 if metric == "cosine" else np.abs(u1 - v1).sum()
                out.append((round(dist * 10000), a == b))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_auc_counts_each_pair_once(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(20):
        v = rng.normal(size=5) + (i % 2) * 2
        rows.append((f"r{i}", f"a{i % 2}", f"d{i // 2 * 2 + i % 2 if i > 3 else i % 2}", (v / np.linalg.norm(v)).tolist()))
    pairs = brute_pairs(rows, "cosine")
    r = evaluation.auc(distance.pair_histogram(vectors(spark, rows), block=block)).first()
    won = sum((s < t) + (s == t) / 2 for s, x in pairs if x for t, y in pairs if not y)
    n1 = sum(x for _, x in pairs)
    assert (r.n_pairs, r.n_self) == (len(pairs), n1) and r.auc == pytest.approx(won / (n1 * (len(pairs) - n1)), abs=1e-6)


def test_auc_of_one_class_is_nan(spark):
    rows = [(f"r{i}", "a", f"d{i}", [1.0, 0.0]) for i in range(3)]
    assert math.isnan(evaluation.auc(distance.pair_histogram(vectors(spark, rows))).first().auc)
    assert math.isnan(evaluation.auc(distance.pair_histogram(vectors(spark, rows).limit(0))).first().auc)


def test_permutations_see_clusters_and_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i:02d}", f"a{i % 2}", f"d{i}", ([1.0, 0.0] if i % 2 else [0.0, 1.0]) + rng.normal(0, 0.01, 2)) for i in range(16)]
    rows = [(i, a, d, (v / np.linalg.norm(v)).tolist()) for i, a, d, v in rows]
    df = vectors(spark, rows)
    observed = evaluation.auc(distance.pair_histogram(df)).first().auc
    s = evaluation.permutation_summary(evaluation.permutation_test(df, 30), observed).first()
    assert observed == 1 and s.n_valid == 30 and s.p_value < 0.2 and 0.2 < s.mean < 0.8


def test_nearest_skips_own_document_and_breaks_ties(spark):
    rows = [("q", "a", "d1", [1.0, 0.0]), ("x", "a", "d1", [1.0, 0.0]), ("z", "b", "d2", [0.0, 1.0]), ("y", "b", "d3", [0.0, 1.0]), ("zero", "b", "d4", [0.0, 0.0])]
    df = vectors(spark, rows)
    got = distance.nearest(df, df.where("id = 'q'"), top=2).orderBy("rank").collect()
    assert [(r.id, r.d) for r in got] == [("y", 1.0), ("z", 1.0)]
    assert distance.nearest(df, df.limit(0)).count() == 0


def test_author_matrix_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", f"a{i % 3}", f"d{i % 3}{i % 2}", rng.normal(size=4).tolist()) for i in range(18)] + [("solo", "s", "ds", [1.0, 1.0, 0.0, 0.0]), ("null", "n", "dn", [0.0] * 4)]
    got = {(r.author_i, r.author_j): (r.n_pairs, r.mean_distance) for r in evaluation.author_matrix(vectors(spark, rows)).collect()}
    unit = [(a, d, np.array(v) / (np.linalg.norm(v) or 1)) for _, a, d, v in rows]
    for (x, y), (n, mean) in got.items():
        want = [1 - u @ v for i, (a, d, u) in enumerate(unit) for j, (b, e, v) in enumerate(unit) if i != j and d != e and (a, b) == (x, y)]
        assert n == (len(want) // 2 if x == y else len(want))
        assert mean == pytest.approx(np.mean(want)) if want else math.isnan(mean)
    sim = {(r.author_i, r.author_j): r.similarity for r in evaluation.similarity(evaluation.author_matrix(vectors(spark, rows))).collect()}
    assert min(v for v in sim.values() if not math.isnan(v)) == 0 and max(v for v in sim.values() if not math.isnan(v)) == 1 and math.isnan(sim["s", "s"])


def test_vector_rules(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "u array<double>, v array<double>")
    got = df.select(V.norm(F.col("u")).alias("n"), V.cosine_distance(F.col("u"), F.col("v")).alias("c"), V.manhattan(F.col("u"), F.col("v")).alias("m")).collect()
    assert got[0].n == 5 and got[0].c == 0 and got[0].m == 7 and got[1].c == 0


def test_scored_auc_and_roc(spark):
    s = spark.createDataFrame([("m", 0.9, True), ("m", 0.8, True), ("m", 0.8, False), ("m", 0.1, False), ("m", float("nan"), True), ("m", None, False), ("one", 0.5, True)], "g string, score double, positive boolean")
    got = {r.g: r for r in evaluation.scored_auc(s, ["g"]).collect()}
    assert got["m"].auc == pytest.approx(3.5 / 4) and math.isnan(got["one"].auc)
    points = {(r.g, r.threshold): (r.tpr, r.fpr) for r in evaluation.roc_points(s, ["g"]).collect()}
    assert points["m", 0.8] == (1.0, 0.5) and points["one", 0.5] == (1.0, 0.0)


def test_tables_between_stages_need_a_shared_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    on = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            lineage.shared_dir(on(master))
    assert lineage.shared_dir(on("local[4]")).startswith("file://")


def test_numbered_is_global(spark):
    df = spark.range(1000).withColumn("w", F.lit(2)).repartition(7)
    got = numbered(df, [F.desc("id")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and got[0].id == 999
    assert numbered(df, ["id"], "s", weight="w").where("id = 999").first().s == 2000
    assert numbered(df.limit(0), ["id"]).count() == 0


FOLD = "fold int, author string, target_article_id string, natural_n_chunks int, generated_n_chunks int, corpus_n_chunks int, natural_mean_distance double, generated_mean_distance double, delta_natural_vs_generated double, model_alias string"


def fold(i, model, nat, gen, n=1, author="a"):
    return (i, author, f"t{i}", 1, n, 4, nat, gen, gen - nat if nat is not None and gen is not None else None, model)


def test_reports_drop_empty_folds_and_keep_nan(spark):
    nan = float("nan")
    rows = [fold(0, "m1", 0.7, 0.6), fold(0, " M1 ", 0.7, 0.6), fold(1, "m1", 0.8, 0.9), fold(2, "m1", 0.8, nan, 0), fold(0, "m2", 0.7, 0.65), fold(3, None, 0.1, 0.2)]
    f = reports.folds(spark.createDataFrame(rows, FOLD))
    assert values(reports.kept_and_dropped(f), "model_alias", "kept", "dropped") == [("m1", 2, 1), ("m2", 1, 0)]
    s = {r.model_alias: r for r in reports.summary(f, "model_alias").collect()}
    assert math.isnan(s["m1"].generated_mean) and s["m2"].generated_std == 0
    t = {r.model_alias: r for r in reports.tricks(f).collect()}
    assert (t["m1"].n_tricks, t["m1"].best_trick, t[reports.POOLED].n_folds) == (1, "t0", 3)
    j = {(r.model_a, r.model_b): r.jaccard for r in reports.jaccard(f, spark.createDataFrame([("m1",), ("M2",), ("m3",)], "model_alias string")).collect()}
    assert j["m1", "m2"] == 1 and j["m1", "m3"] == 0 and j["m3", "m3"] == 0
    assert reports.ranking(f).orderBy("place").first().label == "m2"
    assert reports.tricks(f.limit(0)).count() <= 1


def test_fold_scores_equal_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    say = lambda n, p: " ".join(rng.choice(words, n, p=p))
    rows, made = [], []
    for a in range(2):
        p = rng.dirichlet(np.ones(150))
        for k in range(3):
            rows.append((f"{a}{k}", f"author {a}", say(60, p), "cross_topic_1", "train", None, None))
            made.append((a * 3 + k, f"{a}{k}", None, "m", say(45, p)))
    made.append((99, "00", None, "m", " "))
    essays = spark.createDataFrame(rows, ARTICLE + ", topic string, lang string")
    ref = spark.createDataFrame([(f"r{i}", "x", say(80, None), "cross_genre_2", "train") for i in range(5)], ARTICLE)
    rec = spark.createDataFrame(made, "rec_id long, article_id string, source_article_id string, model_alias string, body string")
    got = folds.score_folds(essays, ref, rec, 20, n_words=100).collect()
    assert len(got) == 6 and all(r.natural_n_chunks == 3 and r.generated_n_chunks == 2 and r.corpus_n_chunks == 6 for r in got)
    assert all(0 < r.natural_mean_distance < 2 and r.delta_natural_vs_generated == pytest.approx(r.generated_mean_distance - r.natural_mean_distance) for r in got)


def test_leave_one_out_and_missing(spark):
    t = spark.createDataFrame([("b", "2"), ("a", "1"), ("a", "3"), ("a", "3")], "author string, article_id string")
    assert values(folds.leave_one_out(t), "fold", "author", "target_article_id", "corpus_articles") == [(0, "a", "1", 1), (1, "a", "3", 1), (2, "b", "2", 0)]
    have = spark.createDataFrame([("1",), (None,)], "target_article_id string")
    assert values(folds.missing(t.withColumnRenamed("article_id", "target_article_id").distinct(), have), "target_article_id") == [("2",), ("3",)]


def test_leakage_rule():
    assert leakage.leaks(0.5, 0.52, 5) and not leakage.leaks(0.22, 0.23, 5) and not leakage.leaks(0.5, 0.6, 5)


def test_leakage_needs_two_authors(spark):
    d = docs(spark, ["alpha beta gamma"] * 4).withColumn("author", F.lit("a"))
    assert leakage.accuracies(d, T.long_words("text"))[0].count() == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x" / "r.json")
    assert sinks.load_json(spark, path, 7) == 7
    for value in ({"old": 1}, {"b": [1, {"c": 0.5}], "a": float("nan"), "é": "ü"}):
        sinks.save_json(spark, path, value, sort_keys=True)
    assert json.loads(open(path).read()) == {"a": None, "b": [1, {"c": 0.5}], "é": "ü"} == sinks.load_json(spark, path) and open(path).read().index('"a"') < open(path).read().index('"b"')
    assert [x.name for x in (tmp_path / "x").iterdir() if not x.name.endswith(".crc")] == ["r.json"]
    df = spark.createDataFrame([("k", 0.12345678), ("n", None), ("x", float("nan"))], "k string, v double")
    assert values(df.select("k", sinks.fixed("v", 4).alias("v")), "k", "v") == [("k", "0.1235"), ("n", ""), ("x", "")]
    sinks.write_csv(df, str(tmp_path / "csv"), {"v": 6})
    sinks.write_pairs(df, str(tmp_path / "p"), 3)
    with pytest.raises(ValueError):
        sinks.write_pairs(df, str(tmp_path / "p"), 4)
    assert sinks.read_pairs(spark, str(tmp_path / "p"), 3).count() == 3
    with pytest.raises(ValueError):
        sinks.read_pairs(spark, str(tmp_path / "p"), 2)
    assert "| k | v |" in sinks.markdown("R", {"t": df})
    assert corpus.load_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "l.json").write_text('[{"a": 1, "b": NaN}, {"a": null}]')
    assert corpus.load_json(spark, str(tmp_path / "l.json"), "a int, b double").count() == 2
    assert corpus.find_recreations(str(tmp_path)).endswith("l.json") and corpus.find_recreations("/nowhere") is None


def test_leakage_weighs_every_word_as_the_reference_does(spark):
    many = [f"w{i}" for i in range(20_100)]
    texts = {"a": many + ["all"] * 3, "b": many + ["all"], "c": ["all", "lone"], "d": ["none"]}
    rows = spark.createDataFrame(list(texts.items()), "id string, w array<string>")
    got = {r.id: r.features for r in leakage.tfidf_rows(rows).collect()}
    assert all(v.size == 20_101 for v in got.values()) and got["c"].numNonzeros() == 1 and got["d"].numNonzeros() == 0
    every, pair = math.log(5 / 4) + 1, math.log(5 / 3) + 1
    length = math.hypot((1 + math.log(3)) * every, pair * math.sqrt(20_100))
    assert got["a"][0] == pytest.approx((1 + math.log(3)) * every / length) and got["a"][1] == pytest.approx(pair / length)


def test_leakage_check_tells_authors_by_topic(spark):
    rng = np.random.default_rng(3)
    topics = {a: [f"{a}word{i}" for i in "abcdefgh"] for a in ("ann", "bob")}
    d = spark.createDataFrame([(f"{a}{k}", a, " ".join(rng.choice(w, 30)) + " the and") for a, w in topics.items() for k in range(10)], "id string, author string, text string")
    got = {r.arm: r for r in leakage.leakage_check(d).collect()}
    assert got["content"]["mean"] == 1 and got["content"].features == 16 and got["words"].features == 18 and got["words"].warning and (got["words"].texts, got["words"].authors, got["words"].folds) == (20, 2, 5)


def dense_predictions(x, label, fold, classes):
    """By Newton's method on all parameters at once."""
    out = np.zeros(len(x), np.int64)
    for f in set(fold.tolist()):
        train = fold != f
        there = np.unique(label[train])
        a, y = np.c_[x[train], np.ones(train.sum())], (label[train][:, None] == there).astype(float)
        d, k = a.shape[1], len(there)
        penalty = np.tile(np.r_[np.ones(d - 1), 0], k)
        w = np.zeros(d * k)
        for _ in range(30):
            p = np.exp(a @ w.reshape(k, d).T)
            p /= p.sum(axis=1, keepdims=True)
            hessian = np.diag(penalty) + np.block([[a.T @ (a * (p[:, i] * ((i == j) - p[:, j]))[:, None]) for j in range(k)] for i in range(k)])
            w = w - np.linalg.lstsq(hessian, ((p - y).T @ a).ravel() + penalty * w, rcond=1e-10)[0]
        own = np.c_[x[~train], np.ones((~train).sum())] @ w.reshape(k, d).T
        out[~train] = there[own.argmax(axis=1)]
    return out


@pytest.mark.parametrize("common", [0, 12, 30])
def test_fits_in_blocks_of_classes_are_those_of_the_whole_objective(spark, monkeypatch, common):
    rng = np.random.default_rng(8)
    label, fold = rng.integers(0, 6, 260), rng.integers(0, 3, 260)
    label[0], fold[0] = 6, 1  # an author of one text
    x = rng.exponential(size=(260, 30)) * (rng.random((260, 30)) < 0.3 + 0.5 * (np.arange(30) % 6 == label[:, None])) * np.where(np.arange(30) < 12, 1, rng.random((260, 30)) < 0.2)
    x[5] = 0
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    data = [(int(f), int(k), np.flatnonzero(v).tolist(), v[v > 0].tolist()) for f, k, v in zip(fold, label, x)]
    monkeypatch.setattr(logistic, "VALUES", 200)
    monkeypatch.setattr(logistic, "SUMMED", 64)
    rows = logistic.rows_of(spark.createDataFrame(data, "fold int, label long, idx array<long>, val array<double>").repartition(3), 30, common, 7)
    assert len(rows.blocks(2)) > 3 and sum(rows.sizes) == 260
    got = Counter((r.fold, r.label, r.predicted) for r in logistic.predictions(spark, rows).collect())
    assert got == Counter(zip(fold.tolist(), label.tolist(), dense_predictions(x, label, fold, 7).tolist()))
    assert sum(n for (_, k, p), n in got.items() if k == p) > 100


def test_leakage_check_of_many_authors_keeps_weights_in_tasks(spark):
    """1,000 authors of two words each; weights of all folds are some 10 million."""
    d = spark.createDataFrame([(f"{a:04d}{k}", f"a{a}", f"w{a} " * 3 + f"v{a} w{(a + 1) % 1000}") for a in range(1000) for k in range(5)], "id string, author string, text string")
    by_fold, size = leakage.accuracies(d, T.long_words("text"))
    got = by_fold.collect()
    assert size == 2000 and [r.fold for r in got] == list(range(5)) and sum(r.n for r in got) == 5000 and all(r.accuracy == 1 for r in got)


def test_products_of_sparse_rows_take_bounded_memory():
    sides = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        idx = [np.unique((20_000 * rng.random(1200) ** 2).astype(np.int64)) for _ in range(1024)]
        sides.append({"author": np.arange(1024)} | distance._by_column(pa.array(idx), pa.array([np.full(len(i), len(i) ** -0.5) for i in idx]), np.arange(1024)))
    tracemalloc.start()
    rows = sum(len(d) for d, _ in distance._dots(*sides))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1024 and peak < 150e6  # two blocks of entries; 220 MB with 128 rows at a time


def test_vector_sums_carry_keys_over_batches(spark):
    rng = np.random.default_rng(4)
    data = [(f"k{i % 7}" if i % 5 else None, int(i % 3), rng.normal(size=4).tolist()) for i in range(500)]
    df = spark.createDataFrame(data, "a string, b int, vec array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {(r.a, r.b): (r.n, r.s) for r in folds.vector_sums(df, "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)
    assert len(got) == len({x[:2] for x in data})
    for key, (n, s) in got.items():
        own = np.array([v for a, b, v in data if (a, b) == key])
        assert n == len(own) and s == pytest.approx(own.sum(axis=0))
    assert folds.vector_sums(df.limit(0), "a").count() == 0


def test_configurations_with_the_splits_that_are_there(spark, tmp_path):
    for split in ("train", "test"):
        spark.createDataFrame([(split[0],)], "text string").write.parquet(f"{tmp_path}/c1/{split}.parquet")
    assert values(corpus.load_config(spark, str(tmp_path), "c1"), "text", "config", "split") == [("t", "c1", "test"), ("t", "c1", "train")]
    with pytest.raises(FileNotFoundError):
        corpus.load_config(spark, str(tmp_path), "c2")


def test_hooks_for_tokens_and_tags(spark):
    df = spark.createDataFrame([("d", "a", "one-two three", "c", "s")], "article_id string, author string, text string, config string, split string")
    assert chunking.chunk_articles(df, 2, 0.5, tokenize=T.pieces).first().tokens == ["one-two", "three"]
    assert df.select(leakage.content_words("text", lambda w: w != "two")).first()[0] == ["one", "three"]


def gram_rows(spark, n=40, columns=12):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        idx = np.sort(rng.choice(columns, 5, replace=False))
        v = rng.random(5)
        rows.append((f"r{i:02d}", f"a{i % 4}", f"d{i // 2 if i < 8 else i}", idx.tolist(), (v / np.linalg.norm(v)).tolist()))
    dense = [(i, a, d, [dict(zip(x, v)).get(c, 0.0) for c in range(columns)]) for i, a, d, x, v in rows]
    return spark.createDataFrame(rows, "id string, author string, doc string, idx array<long>, val array<double>").repartition(3), dense


@pytest.mark.parametrize("full", [0, 4, 10**9])
def test_sparse_rows_are_written_once_and_counted_as_pairs(spark, monkeypatch, full):
    monkeypatch.setattr(distance, "DENSE", full)  # tasks have that of their own process; the functions are called here, too
    rows, dense = gram_rows(spark)
    blocks = distance.packed(rows, 7, ids=True)
    read = blocks.reader()
    assert sum(blocks.sizes) == 40 and max(blocks.sizes) <= 7 and sorted(i for k in range(len(blocks.names)) for i in read(k)["id"].to_pylist()) == [r[0] for r in dense]
    for k in range(len(blocks.names)):
        a, b = read(0), read(k)
        vec = dict((r[0], np.array(r[3])) for r in dense)
        want = np.array([[vec[i] @ vec[j] for j in b["id"].to_pylist()] for i in a["id"].to_pylist()])
        assert np.concatenate([m for m, _ in distance._dots(a, b)]) == pytest.approx(want)
    got = {r.step: (r.n_self, r.n_cross) for r in distance.pair_histogram(blocks).collect()}
    pairs = brute_pairs(dense, "cosine")
    assert got == {s: (sum(x for t, x in pairs if t == s), sum(not x for t, x in pairs if t == s)) for s in {t for t, _ in pairs}}


def test_terms_of_many_texts_leave_a_worker_in_small_batches():
    words = pa.array([[f"w{i % 50}", "all", "all"] for i in range(1000)])
    out = list(features._tally([pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(1000)]), words], ["id", "t"])], features.padded_grams(3, 4)))
    assert max(b.num_rows for b in out) <= 128 and sum(b.num_rows for b in out) == 1000
    row = out[3].slice(3, 1).to_pydict()
    one = features.padded_grams(3, 4)
    want = Counter(g for w in words[387].as_py() for g in one(w))
    assert row["id"] == ["d387"] and (row["terms"], row["tf"]) == ([[k for k, _ in sorted(want.items())]], [[v for _, v in sorted(want.items())]])


def test_term_totals_are_a_row_a_task_and_term(spark):
    d = docs(spark, ["aa bb aa", "bb cc", ""] * 100).repartition(2)
    assert {r.gram: (r.df, r.n) for r in features.term_totals(d, T.words("text")).collect()} == {"aa": (100, 200), "bb": (200, 200), "cc": (100, 100)}


def test_gram_rows_are_made_as_they_are_packed(spark, monkeypatch):
    d = docs(spark, ["the cat sat", "the cat ran far", "a dog ran", "the dog sat far", ""]).withColumn("doc", F.col("id")).withColumn("author", F.concat(F.lit("a"), F.substring("id", 2, 1).cast("int") % 2))
    space = features.CharNGrams().fit(d)
    made = sorted(map(tuple, distance.pair_histogram(space.rows(d), block=2).collect()))
    monkeypatch.setattr(features, "MOST_TERMS", 0)
    assert made == sorted(map(tuple, distance.pair_histogram(space.rows(d), block=2).collect())) and sum(a + b for _, a, b in made) == 10


def test_nearest_sparse_rows_of_every_row(spark):
    rows, dense = gram_rows(spark)
    want = {(i, r): (j, d) for i, _, e, u in dense for r, (d, j) in enumerate(sorted((round(1 - np.dot(u, v), 6), j) for j, _, f, v in dense if e != f)[:10], 1)}
    got = {(r.query, r["rank"]): (r.id, r.d) for r in distance.nearest(rows, rows, block=7).collect()}
    assert len(got) == 400 and got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    one = distance.nearest(rows, rows.where("id = 'r05'"), block=7).collect()
    assert {(r.query, r["rank"]): r.id for r in one} == {k: v[0] for k, v in want.items() if k[0] == "r05"}


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_author_means_of_authors_in_one_block_and_in_several(spark, metric):
    sparse, dense = gram_rows(spark)
    names = lambda r: (r.author_i, r.author_j)
    want = {}
    for n, (_, x, d, u) in enumerate(dense):
        for _, y, e, v in dense[n + 1 :]:
            if d != e:
                far = 1 - np.dot(u, v) if metric == "cosine" else np.abs(np.subtract(u, v)).sum()
                for key in {(x, y), (y, x)}:
                    want.setdefault(key, []).append(far)
    for block in (3, 1000):
        for rows in [vectors(spark, dense)] + [sparse] * (metric == "cosine"):
            got = {names(r): (r.n_pairs, r.mean_distance) for r in distance.author_means(rows, metric, block).collect()}
            assert got.keys() == want.keys() and all(got[k] == (len(w), pytest.approx(np.mean(w))) for k, w in want.items())


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_permutations_equal_relabelled_pairs(spark, metric):
    rng = np.random.default_rng(6)
    rows = [(f"r{i:02d}", f"a{i % 3}" if i % 2 else "often", f"d{i // 2 if i < 8 else i}", rng.random(4).tolist()) for i in range(30)]
    if metric == "cosine":
        rows = [(i, a, d, (np.array(v) / np.linalg.norm(v)).tolist()) for i, a, d, v in rows]
    far = lambda u, v: 1 - np.dot(u, v) if metric == "cosine" else np.abs(np.subtract(u, v)).sum() / 4
    pairs = [(math.floor(far(rows[i][3], rows[j][3]) * 10**4 + 0.5), i, j) for i in range(30) for j in range(i + 1, 30) if rows[i][2] != rows[j][2]]
    steps = Counter(s for s, _, _ in pairs)
    ahead, middle = 0, {}
    for s in sorted(steps):
        middle[s] = ahead + (steps[s] + 1) / 2
        ahead += steps[s]
    want = {}
    for k in range(5):
        order = sorted(range(30), key=lambda i: (hashlib.md5(f"7:{k}:{rows[i][0]}".encode()).hexdigest(), i))
        label = {i: rows[at][1] for at, i in enumerate(order)}
        own = [middle[s] for s, i, j in pairs if label[i] == label[j]]
        want[k] = (len(own), 1 - (sum(own) - len(own) * (len(own) + 1) / 2) / (len(own) * (len(pairs) - len(own))))
    for block in (4, 100):
        blocks = distance.packed(vectors(spark, rows).repartition(2), block, ids=True)
        got = {r.k: (r.n_self, r.auc) for r in evaluation.permutation_test(blocks, 5, 7, metric).collect()}
        assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    assert evaluation.permutation_test(vectors(spark, rows).limit(0), 3).where("n_self > 0").count() == 0


def test_manhattan_histogram_takes_a_tile_in_small_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{i:02d}", f"a{i % 3}", f"d{i}", rng.normal(size=7).tolist()) for i in range(40)]
    got = {r.step: (r.n_self, r.n_cross) for r in distance.pair_histogram(vectors(spark, rows), "manhattan", block=9).collect()}
    want = {}
    for i, (_, a, _, u) in enumerate(rows):
        for _, b, _, v in rows[i + 1 :]:
            key = math.floor(np.abs(np.subtract(u, v)).sum() / 7 * 10**4 + 0.5)
            want[key] = tuple(np.add(want.get(key, (0, 0)), (a == b, a != b)))
    assert got == want
    x = {"vec": rng.normal(size=(600, 5)), "author": np.zeros(600, np.int64)}
    assert max(d.size for d, _, _ in distance._parts_of(x, x, "manhattan", True)) <= distance.ROWS * distance.COLUMNS
    assert distance._manhattan(x["vec"][:3], x["vec"].T) == pytest.approx(np.abs(x["vec"][:3, None] - x["vec"][None]).sum(axis=2))


def test_auc_of_more_pairs_than_a_long_multiplies(spark):
    h = spark.createDataFrame([(1, 3 * 10**9, 10**10), (2, 10**9, 3 * 10**10)], "step long, n_self long, n_cross long")
    r = evaluation.auc(h).first()  # n_self * n_cross is over 2**63
    assert (r.n_self, r.n_cross) == (4 * 10**9, 4 * 10**10) and r.auc == pytest.approx((3 * 3.5 + 1.5) / 16)
    scores = spark.createDataFrame([("m", 0.9, True, 4 * 10**9), ("m", 0.1, False, 4 * 10**9)], "g string, score double, positive boolean, weight long")
    assert evaluation.scored_auc(scores, ["g"]).first().auc == 1


def frequency_rows(n: int, columns: int = 6) -> tuple[np.ndarray, list[tuple]]:
    """Deviations of counts by a text's words, so that values recur, in an order that keeps those of one length apart."""
    rng = np.random.default_rng(11)
    v = (rng.poisson(1.0, (n, columns)) / (20 + np.arange(n) % 4)[:, None] - 0.1) / np.arange(1, columns + 1)
    return v, [(f"r{i:03d}", f"a{i % 3}", f"d{i // 2}", v[i].tolist()) for i in range(n)]


def test_manhattan_distances_share_the_minima_of_equal_values(monkeypatch):
    v, _ = frequency_rows(600)
    ordered = v[distance._alike(v)]
    x, y = ordered - ordered.min(axis=0), np.ascontiguousarray((v - v.min(axis=0)).T)
    assert len(distance._shared(x[:150])[1]) * 2 < len(distance._shared((v - v.min(axis=0))[:150])[1])  # one length, not four
    want = np.abs(x[:150, None] - y.T[None]).sum(axis=2)
    assert distance._manhattan_shared(x[:150], y, *distance._shared(x[:150])) == pytest.approx(want)
    monkeypatch.setattr(distance, "SHARED", 1)
    assert distance._shared(x[:150]) is None  # too many values: row by row
    a = {"vec": ordered}
    got = np.zeros((600, 600))
    for limit in (0, 10**6):
        monkeypatch.setattr(distance, "SHARED", limit)
        for d, r, c in distance._parts_of(a, a, "manhattan", False):
            got[r, c] = d
        assert got == pytest.approx(np.abs(ordered[:, None] - ordered[None]).sum(axis=2))


def test_author_sums_by_value_equal_those_by_pair(monkeypatch):
    v, _ = frequency_rows(80)
    side = lambda s: {"vec": v[s], "author": np.sort(np.arange(40) // 9), "doc": np.arange(80)[s] // 3}
    a, b = side(slice(0, 40)), side(slice(38, 78))  # documents of both sides
    monkeypatch.setattr(distance, "CHEAPER", 10**6)
    for p, q in ((a, b), (a, a)):
        s, n = distance._sums_by_value(p, q, p["author"], q["author"], p is q)
        ok = (p["doc"][:, None] != q["doc"][None]) & (np.triu(np.ones((40, 40), bool), 1) if p is q else True)
        far = np.abs(p["vec"][:, None] - q["vec"][None]).sum(axis=2) * ok
        fold = lambda t: np.array([[t[np.ix_(p["author"] == i, q["author"] == j)].sum() for j in range(5)] for i in range(5)])  # noqa: B023, E731
        assert (n == fold(ok)).all() and s == pytest.approx(fold(far))
    monkeypatch.setattr(distance, "CHEAPER", 0)
    assert distance._sums_by_value(a, b, a["author"], b["author"], False) is None


def test_unit_rows_keep_what_has_no_length(spark):
    rows = [("r0", "a", "d0", [3.0, 4.0]), ("r1", "a", "d1", [0.0, 0.0]), ("r2", "b", "d2", [0.0, -2.0])]
    assert {r.id: r.vec for r in distance.unit_rows(vectors(spark, rows)).collect()} == {"r0": [0.6, 0.8], "r1": [0.0, 0.0], "r2": [0.0, -1.0]}


def test_labels_are_ordered_once_for_all_strips_of_a_tile():
    rng = np.random.default_rng(12)
    x, y = np.r_[rng.integers(0, 90, 300), np.zeros(60, int), [95]], np.r_[rng.integers(0, 80, 300), np.zeros(50, int)]  # 0 is frequent
    ranks = rng.random((len(x), len(y)))
    side = distance._sorted_labels(y)
    want = (ranks * (x[:, None] == y[None])).sum()
    assert sum(distance._same_sums(ranks[i : i + 100], x[i : i + 100], side) for i in range(0, len(x), 100)) == pytest.approx(want)


def test_permutations_take_strips_of_a_tile(spark):
    rng = np.random.default_rng(13)
    rows = [(f"r{i:04d}", f"a{i % 7}", f"d{i // 2}", rng.normal(size=3).tolist()) for i in range(distance.STRIP + distance.ROWS + 9)]
    df = distance.unit_rows(vectors(spark, rows))
    got = [{r.k: (r.n_self, r.auc) for r in evaluation.permutation_test(distance.packed(df.repartition(1), block, ids=True), 3).collect()} for block in (100, 8192)]
    assert len(got[0]) == 3 and got[0].keys() == got[1].keys() and all(got[0][k][0] == got[1][k][0] and got[0][k][1] == pytest.approx(got[1][k][1]) for k in got[0])
