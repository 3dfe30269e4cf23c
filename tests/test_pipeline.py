import math

import numpy as np
import pytest

from inkstone import pipeline
from inkstone.operators import experiment, features, folds
from inkstone.sources import generation
from inkstone.streaming import scorer

ARTICLE = "article_id string, author string, text string, config string, split string, topic string, lang string"


def small_corpus(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(160)]
    rows = []
    for a in ("ann", "bob"):
        p = rng.dirichlet(np.ones(160))
        rows += [(f"{a}{k}", a, " ".join(rng.choice(words, 400, p=p)), "cross_topic_1", "train", None, None) for k in range(3)]
    ref = [(f"r{k}", "x", " ".join(rng.choice(words, 300)), "cross_genre_2", "train", None, None) for k in range(4)]
    return spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(ref, ARTICLE)


def test_run_tells_authors_apart(spark):
    essays, ref = small_corpus(spark)
    out = pipeline.run(essays, ref, pipeline.Config(chunk_size=50, mfw_n=100, permutations=20, topic_leakage=False))
    assert out["chunks"] == 48 and set(out["metrics"]) == {"cosine_delta", "burrows_delta", "char_ngram_cosine"}
    for m in out["metrics"].values():
        assert m["n_pairs"] == 48 * 47 // 2 - 6 * 28 and m["auc"] > 0.8
    assert out["metrics"]["cosine_delta"]["permutations"]["p_value"] < 0.2


def test_every_metric_has_its_permutation_test(spark):
    essays, ref = small_corpus(spark)
    out = pipeline.run(essays, ref, pipeline.Config(chunk_size=50, mfw_n=100, permutations=20, topic_leakage=False))
    for m in out["metrics"].values():
        p = m["permutations"]
        assert p["n_valid"] == 20 and abs(p["mean"] - 0.5) < 0.1 and p["p_value"] == pytest.approx(1 / 21)


def test_config_refuses_what_it_does_not_know(tmp_path):
    with pytest.raises(ValueError):
        pipeline.Config.read(None, no_such=1)
    with pytest.raises(ValueError):
        pipeline.Config(metrics=("none",))
    (tmp_path / "c.json").write_text('{"mfw_n": 200, "metrics": ["cosine_delta"]}')
    assert pipeline.Config.read(str(tmp_path / "c.json"), chunk_size=None, permutations=5) == pipeline.Config(mfw_n=200, metrics=("cosine_delta",), permutations=5)


def test_stream_equals_batch(spark, tmp_path):
    essays, ref = small_corpus(spark)
    docs = essays.selectExpr("article_id as id", "author", "text")
    space = features.MostFrequentWords(100).fit(docs, ref.selectExpr("article_id as id", "text"))
    profiles = scorer.author_sums(space, docs)
    new = docs.union(spark.createDataFrame([("n", "nobody", "w1 w2"), ("e", "ann", "")], "id string, author string, text string"))
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    scorer.run(stream, space, profiles, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.id: r.distance for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.distance for r in scorer.scored(new, space, profiles).collect()}
    assert got.keys() == want.keys() and math.isnan(got["n"]) and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in got)


def test_answers_are_resumed(spark):
    prompts = spark.createDataFrame([("1", "a\n\nb"), ("2", "c"), ("3", None), (None, "d")], "k string, prompt string")
    have = spark.createDataFrame([("2", "old"), ("1", None)], "k string, body string")
    assert {r.k: r.body for r in generation.answers(prompts, have, "k").collect()} == {"1": "b"}
    assert {r.k: r.body for r in generation.answers(prompts, have, "k", overwrite=True).collect()} == {"1": "b", "2": "c"}
    tries = []
    assert generation.ask(lambda p: tries.append(p), "x", tries=3, wait=0) is None and len(tries) == 3


def test_report_of_folds(spark):
    fold = "fold int, author string, target_article_id string, natural_n_chunks int, generated_n_chunks int, corpus_n_chunks int, natural_mean_distance double, generated_mean_distance double, delta_natural_vs_generated double, model_alias string"
    f = spark.createDataFrame([(i, "a", f"t{i}", 1, 1, 2, 0.7, 0.7 + i / 10 - 0.1, i / 10 - 0.1, "m") for i in range(3)], fold)
    text = pipeline.final_report(f, spark.createDataFrame([("m",)], "model_alias string"))
    assert "## Headline" in text and "best_mimic" in text


def test_tables_have_fixed_places(spark, tmp_path):
    fold = "fold int, author string, target_article_id string, natural_n_chunks int, generated_n_chunks int, corpus_n_chunks int, natural_mean_distance double, generated_mean_distance double, delta_natural_vs_generated double, model_alias string"
    f = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}", 1, 1, 2, 0.7, 0.7 + i / 10 - 0.1, i / 10 - 0.1, "m.1") for i in range(4)], fold)
    names = pipeline.write_tables(f, spark.createDataFrame([("m.1",), ("n",)], "model_alias string"), str(tmp_path))
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/{n}").collect()
    assert len(names) >= 8 and read("tricks_by_author")[0].trick_rate == "0.5000"
    assert [tuple(r) for r in read("trick_matrix")] == [("t0", "1", "0"), ("t1", "0", "0"), ("t2", "0", "0"), ("t3", "0", "0")]
    assert read("author_breakdown")[0]["n"] in ("", None) and [r.place for r in read("authors")] == ["1", "2"]


def test_registered_metrics_run(spark):
    essays, ref = small_corpus(spark)
    features.register("first_words", features.Metric("mfw", features.METRICS["burrows_delta"].rows, "manhattan"))
    out = pipeline.run(essays, ref, pipeline.Config(chunk_size=50, mfw_n=100, permutations=0, metrics=("first_words",), topic_leakage=False))
    assert out["metrics"]["first_words"]["auc"] > 0.8
    with pytest.raises(ValueError):
        features.register("x", features.Metric("none", None, "cosine"))
    del features.METRICS["first_words"]


def tables(spark, folder):
    essays, ref = small_corpus(spark)
    essays.write.parquet(f"{folder}/essays.parquet")
    ref.write.parquet(f"{folder}/reference_corpus.parquet")
    keys = [r.article_id for r in essays.select("article_id").collect()]
    spark.createDataFrame([(k, "x/m", f"Write about {k}.") for k in keys], "article_id string, model_slug string, assignment string").write.parquet(f"{folder}/detail.parquet")
    texts = {r.article_id: r.text for r in essays.collect()}
    spark.createDataFrame([(i, k, None, "x/m", "m", texts[k]) for i, k in enumerate(keys)], "rec_id long, article_id string, source_article_id string, model_slug string, model_alias string, body string").write.parquet(f"{folder}/recreation.parquet")
    spark.createDataFrame([("m", "x/m"), ("M ", "x/m")], "model_alias string, model_slug string").write.parquet(f"{folder}/model_map.parquet")


def test_experiment_from_selection_to_scores(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path)
    monkeypatch.setattr(pipeline.lineage, "forget", lambda s: None)
    call = lambda command, out, *more: pipeline.main([command, "--data", str(tmp_path), "--out", f"{tmp_path}/{out}", "--chunk-size", "50", "--mfw-n", "100", *more])
    call("select", "m.json", "--authors", "2", "--essays-per-author", "2")
    document = pipeline.sinks.load_json(spark, f"{tmp_path}/m.json")
    assert len(document["essays"]) == 4 and document["seed"] == 1729
    call("score", "scores", "--manifest", f"{tmp_path}/m.json")
    scores = spark.read.parquet(f"{tmp_path}/scores").collect()
    assert len(scores) == 4 and all(r.delta_natural_vs_generated == pytest.approx(0) and r.corpus_n_chunks == 8 for r in scores)
    call("details", "d", "--manifest", f"{tmp_path}/m.json", "--model", "x/m")
    call("recreate", "r", "--manifest", f"{tmp_path}/m.json", "--model", "x/m")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 4 and all("Write about" in r.body for r in spark.read.parquet(f"{tmp_path}/r").collect())
    call("models", "known")
    assert spark.read.parquet(f"{tmp_path}/known").count() == 1
    with pytest.raises(ValueError):
        pipeline.score(pipeline.corpus.test_slice(spark, str(tmp_path)), pipeline.corpus.reference_slice(spark, str(tmp_path)), spark.read.parquet(f"{tmp_path}/recreation.parquet").limit(0), document, pipeline.Config(chunk_size=50, mfw_n=100))
    with pytest.raises(SystemExit):
        call("score", "x")


def test_generation_leaves_holes_and_resumes(spark, tmp_path):
    tables(spark, tmp_path)
    essays = pipeline.corpus.test_slice(spark, str(tmp_path))
    document = experiment.manifest_document(essays, experiment.selected(essays, 2, 3), essays_per_author=3)
    run = lambda provider, **more: [(r.place, r.article_id, r.body) for r in pipeline.generate(spark, str(tmp_path), "recreate", document, "x/m", f"{tmp_path}/made", provider, wait=0, **more).orderBy("place").collect()]
    monkey = lambda p: None if "ann1." in p.rsplit("\n\n", 1)[-1] else "one"
    assert [b for _, _, b in run(monkey)] == ["one", None, "one", "one", "one", "one"]
    assert [b for _, _, b in run(lambda p: "two")] == ["one", "two", "one", "one", "one", "one"]
    assert [b for _, _, b in run(lambda p: "three", overwrite=True)] == ["three"] * 6


def test_contexts_selection_and_guards(spark):
    essays, _ = small_corpus(spark)
    picked = folds.sampled_essays(essays, 2)
    got = {r.article_id: r for r in experiment.contexts(essays, picked).collect()}
    assert len(got) == 4 and all(r.context.startswith("--- ") and r.context.count("---") == 2 and k not in r.context.split(" ---")[0] for k, r in got.items())
    assert experiment.contexts(essays, picked.where("pick = 1")).where("context is not null").count() == 0
    with pytest.raises(ValueError):
        experiment.selected(essays, 3, 1)
    with pytest.raises(ValueError):
        experiment.selected(essays, 0, 1)
    with pytest.raises(ValueError):
        experiment.enforce_even(picked, 3)
    experiment.enforce_even(picked, 2)
    with pytest.raises(ValueError):
        experiment.manifest_rows(spark, {"essays": []})
    models = spark.createDataFrame([("M", "x/m")], "model_alias string, model_slug string")
    asked = spark.createDataFrame([("m",), ("zz",), (None,)], "model_alias string")
    assert sorted(tuple(r) for r in experiment.resolved(asked, models).collect()) == [("m", "x/m", True), ("zz", None, False)]
