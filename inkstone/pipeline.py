"""The attribution pipeline and the command line: python -m inkstone.pipeline COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import chunking, distance, evaluation, experiment, features, folds, leakage, reports
from inkstone.plans import lineage
from inkstone.plans.lineage import written
from inkstone.sources import corpus, generation, sinks


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    min_fill: float = 0.8
    min_chunks_per_author: int = 1
    mfw_n: int = 500
    permutations: int = 250
    seed: int = 1729
    metrics: tuple[str, ...] = ("cosine_delta", "burrows_delta", "char_ngram_cosine")
    topic_leakage: bool = True

    def __post_init__(self):
        for m in self.metrics:
            features.required_features(m)
        if not 0 < self.min_fill <= 1 or self.chunk_size < 1:
            raise ValueError("chunk_size must be positive and min_fill in (0, 1]")

    @classmethod
    def read(cls, path: str | None = None, **over) -> "Config":
        known = {f.name for f in fields(cls)}
        given = json.load(open(path, encoding="utf-8")) if path else {}
        if unknown := (given.keys() | over.keys()) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        both = given | {k: v for k, v in over.items() if v is not None}
        return cls(**both | ({"metrics": tuple(both["metrics"])} if "metrics" in both else {}))


def _docs(chunks: DataFrame) -> DataFrame:
    return written(chunking.serialized(chunks).select(F.col("chunk_id").alias("id"), F.col("source_doc_id").alias("doc"), "author", "chunk_index", F.col("token_text").alias("text")), "docs")


def fitted(name: str, docs: DataFrame, reference: DataFrame, config: Config) -> features.FeatureExtractor:
    """The registered features of that name, fitted on docs and, for means and deviations, on reference (article_id, text)."""
    extractor = features.FEATURES[name](config)
    return extractor.fit(docs, reference.select(F.col("article_id").alias("id"), "text") if extractor.needs_zscoring else None)


def metric_rows(metric: str, docs: DataFrame, space: features.FeatureExtractor) -> tuple[DataFrame, str]:
    """Rows (id, doc, author, vec or idx and val) of a registered metric, and the distance that it is."""
    made = features.METRICS[metric]
    return written(made.rows(space, docs), metric), made.distance


def run(essays: DataFrame, reference: DataFrame, config: Config) -> dict:
    """Evaluate every metric on essays (as corpus.articles gives them): pairs, AUC and permutation test, and topic leakage."""
    chunks = chunking.chunk_articles(essays, config.chunk_size, config.min_fill)
    chunking.enforce_minimum(chunks, config.min_chunks_per_author)
    docs = _docs(chunks)
    spaces = {name: fitted(name, docs, reference, config) for name in {features.required_features(m) for m in config.metrics}}
    out: dict = {"config": asdict(config), "chunks": docs.count(), "metrics": {}}
    for metric in config.metrics:
        rows, kind = metric_rows(metric, docs, spaces[features.required_features(metric)])
        histogram = written(distance.pair_histogram(rows, kind), "histogram")
        found = evaluation.auc(histogram).first().asDict()
        if config.permutations > 0:
            found["permutations"] = evaluation.permutation_summary(evaluation.permutation_test(rows, config.permutations, config.seed, kind), found["auc"]).first().asDict()
        found["histogram"] = [r.asDict() for r in evaluation.histogram_bins(histogram).orderBy("is_self", "bin").collect()]  # bins
        out["metrics"][metric] = found
    if config.topic_leakage:
        out["topic_leakage"] = [r.asDict() for r in leakage.leakage_check(docs.select("id", "author", "text")).collect()]  # two arms
    return out


def final_tables(fold_results: DataFrame, models: DataFrame) -> dict[str, tuple[DataFrame, dict[str, int]]]:
    """name -> (table in its order, fixed places of its number columns) of all fold reports."""
    f = written(reports.folds(fold_results), "folds")
    names = sorted(r[0] for r in models.select(T.name_key("model_alias")).distinct().collect() if r[0])  # a table of models
    six = lambda *c: dict.fromkeys(c, 6)
    return {
        "kept_and_dropped": (reports.kept_and_dropped(f).orderBy("model_alias"), {}),
        "ranking_distance": (reports.ranking(f).orderBy("place"), six("mean", "std")),
        "ranking_match": (reports.ranking(f, match=True).orderBy("place"), six("mean", "std")),
        "authors": (reports.author_order(f).orderBy("place"), six("mean")),
        "author_breakdown": (reports.author_breakdown(f, names).join(reports.author_order(f).select("author", "place"), "author").orderBy("place").drop("place"), six(*names)),
        "author_heatmap": (reports.author_heatmap(f).orderBy("author", "model_alias"), six("natural", "generated", "delta")),
        "tricks_by_model": (reports.tricks(f).orderBy(F.desc("trick_rate"), "model_alias"), {"trick_rate": 4, "mean_delta": 6, "median_delta": 6}),
        "tricks_by_author": (reports.tricks_by(f, "author").orderBy(F.desc("trick_rate"), "author"), {"trick_rate": 4}),
        "trick_matrix": (reports.trick_grid(f, names).groupBy("target_article_id").pivot("model_alias", names).agg(F.max("trick")).orderBy("target_article_id"), {}),
        "jaccard": (reports.jaccard(f, models).orderBy("model_a", "model_b"), {"jaccard": 4}),
        "detection_auc": (reports.detection_auc(f).orderBy(F.desc("auc"), "model_alias"), {"auc": 4}),
        "delta_quartiles": (reports.delta_quartiles(f).orderBy("model_alias"), six("least", "q1", "median", "q3", "most")),
        "roc": (evaluation.roc_points(reports.detection_scores(f), ["model_alias"]).orderBy("model_alias", F.desc("threshold")), six("threshold", "tpr", "fpr")),
        "headline": (reports.headline(f), {}),
    }


def final_report(fold_results: DataFrame, models: DataFrame) -> str:
    """All fold reports as Markdown, but for the points of curves and the matrix of targets."""
    tables = {name.replace("_", " ").capitalize(): t for name, (t, _) in final_tables(fold_results, models).items() if name not in ("roc", "trick_matrix")}
    return sinks.markdown("Natural and generated texts", tables)


def write_tables(fold_results: DataFrame, models: DataFrame, folder: str) -> list[str]:
    """A folder of CSV for each fold report; null cells are empty, NaN is `nan` but in the tables of authors and models, where it is empty."""
    made = final_tables(fold_results, models)
    for name, (table, places) in made.items():
        sinks.write_csv(table, f"{folder}/{name}", places, nan="" if name in ("author_breakdown", "author_heatmap") else "nan")
    return list(made)


def _provider(name: str | None):
    """The function named `module:function`; without a name the offline stub."""
    if not name:
        return generation.stub
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def generate(spark: SparkSession, data: str, stage: str, document: dict, model: str, out: str, provider=generation.stub, overwrite: bool = False, wait: float = generation.FIRST_WAIT) -> DataFrame:
    """Run the stage `details` or `recreate` for a manifest's essays and one model into a Parquet folder; gives (place, article_id, body) with null holes.

    What the folder has is kept and not asked for again, unless it is to be overwritten; an answer that failed stays a hole.
    """
    essays, picked = corpus.test_slice(spark, data), experiment.manifest_rows(spark, document)
    experiment.enforce_present(picked, essays, "article_id")
    have = sinks.read_parquet(spark, out, "article_id string, body string")
    if stage == "details":
        prompts = experiment.detail_prompts(essays.join(picked.select("article_id"), "article_id", "left_semi"))
    else:
        details = corpus.table(spark, data, "detail").where(F.col("model_slug") == model).groupBy("article_id", "model_slug").agg(F.max("assignment").alias("assignment"))
        prompts = experiment.recreation_prompts(essays, picked, details).select("article_id", "prompt")
    made = generation.answers(prompts, have, "article_id", provider, overwrite, wait).where("body is not null")
    old = have.join(made.select("article_id"), "article_id", "left_anti") if overwrite else have
    both = written(old.select("article_id", "body").unionByName(made), "answers")
    both.write.mode("overwrite").parquet(out)
    return experiment.resume(picked, [model], both.withColumn("model", F.lit(model)), "body").select("place", "article_id", "body", "todo")


def score(essays: DataFrame, reference: DataFrame, recreations: DataFrame, document: dict, config: Config) -> DataFrame:
    """Fold scores of a manifest's essays; ValueError if the folds are uneven, an essay is gone or one has no recreation."""
    picked = experiment.manifest_rows(essays.sparkSession, document)
    experiment.enforce_even(picked, document["essays_per_author"])
    experiment.enforce_present(picked, essays, "article_id")
    made = folds.usable_recreations(recreations).withColumnRenamed("target_article_id", "article_id")
    experiment.enforce_present(picked, made, "article_id")
    keys = picked.select("article_id")
    mine = recreations.withColumn("source_article_id", F.coalesce("source_article_id", "article_id")).join(keys.withColumnRenamed("article_id", "source_article_id"), "source_article_id", "left_semi")
    scores = written(folds.score_folds(essays.join(keys, "article_id", "left_semi"), reference, mine, config.chunk_size, config.min_fill, config.mfw_n), "scores")
    if bad := scores.where("corpus_n_chunks = 0").limit(1).collect():
        raise ValueError(f"the fold of {bad[0].target_article_id} has no corpus")
    return scores


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="inkstone")
    parser.add_argument("command", choices=["corpus", "chunks", "evaluate", "similarity", "report", "tables", "select", "score", "details", "recreate", "models"])
    parser.add_argument("--data", required=True, help="folder of Parquet tables")
    parser.add_argument("--out", required=True, help="folder or file to write")
    parser.add_argument("--config", help="JSON settings")
    parser.add_argument("--chunk-size", type=int)
    parser.add_argument("--mfw-n", type=int)
    parser.add_argument("--permutations", type=int)
    parser.add_argument("--authors", type=int, default=5)
    parser.add_argument("--essays-per-author", type=int, default=5)
    parser.add_argument("--seed", type=int, default=1729)
    parser.add_argument("--manifest", help="what select wrote")
    parser.add_argument("--model", help="slug of the model that answers")
    parser.add_argument("--provider", help="module:function that answers prompts")
    parser.add_argument("--recreations", help="folder with a JSON file of recreations, in place of the table")
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    config = Config.read(args.config, chunk_size=args.chunk_size, mfw_n=args.mfw_n, permutations=args.permutations)
    spark = SparkSession.builder.appName("inkstone").getOrCreate()
    essays, table = corpus.test_slice(spark, args.data), lambda name: corpus.table(spark, args.data, name)
    chunks = chunking.chunk_articles(essays, config.chunk_size, config.min_fill)
    reference = corpus.reference_slice(spark, args.data)
    document = sinks.load_json(spark, args.manifest) if args.manifest else None
    if args.command in ("score", "details", "recreate") and document is None:
        parser.error("a manifest is needed")
    if args.command in ("details", "recreate") and not args.model:
        parser.error("a model is needed")
    if args.command == "corpus":
        chunking.article_report(essays).write.mode("overwrite").parquet(args.out)
    elif args.command == "chunks":
        chunking.serialized(chunks).write.mode("overwrite").parquet(args.out)
    elif args.command == "evaluate":
        sinks.save_json(spark, args.out, run(essays, reference, config))
    elif args.command == "similarity":
        docs = _docs(chunks)
        matrix = written(evaluation.author_matrix(metric_rows("cosine_delta", docs, fitted("mfw", docs, reference, config))[0]), "matrix")
        authors = docs.select("author").distinct().count()
        sinks.write_pairs(evaluation.similarity(matrix).orderBy("author_i", "author_j"), args.out, authors * authors)
    elif args.command == "report":
        sinks.save_text(spark, args.out, final_report(table("fold_result"), table("model_map")))
    elif args.command == "tables":
        write_tables(table("fold_result"), table("model_map"), args.out)
    elif args.command == "select":
        picked = experiment.selected(essays, args.authors, args.essays_per_author, args.seed)
        sinks.save_json(spark, args.out, experiment.manifest_document(essays, picked, seed=args.seed, authors=args.authors, essays_per_author=args.essays_per_author, chunk_size=config.chunk_size, min_fill=config.min_fill))
    elif args.command == "score":
        found = corpus.find_recreations(args.recreations) if args.recreations else None
        if args.recreations and found is None:
            parser.error(f"no recreations in {args.recreations}")
        made = corpus.load_json(spark, found, corpus.RECREATION) if found else table("recreation")
        score(essays, reference, made, document, config).write.mode("overwrite").parquet(args.out)
    elif args.command == "models":
        experiment.resolved(None, table("model_map")).orderBy("model_alias").write.mode("overwrite").parquet(args.out)
    else:
        generate(spark, args.data, args.command, document, args.model, args.out, _provider(args.provider), args.overwrite)
    lineage.forget(spark)


if __name__ == "__main__":
    main()
