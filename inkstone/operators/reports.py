"""Reports over fold results: rankings, breakdowns, tricks, overlaps and detection. NaN is kept apart from null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import evaluation
from inkstone.operators.folds import latest

MEASURES = {"natural": "natural_mean_distance", "generated": "generated_mean_distance", "delta": "delta_natural_vs_generated"}
POOLED = "all_models_pooled"


def folds(df: DataFrame) -> DataFrame:
    """One row a model and target: redelivered rows are one fold, the model by its key."""
    keyed = df.withColumn("model_alias", T.name_key("model_alias")).where(F.col("model_alias").isNotNull() & F.col("target_article_id").isNotNull())
    return latest(keyed, ["model_alias", "target_article_id"], ["fold"]).withColumn("author", T.name_key("author"))


def valid() -> Column:
    """Folds that count: with generated chunks and a delta that is a number."""
    d = F.col("delta_natural_vs_generated")
    return (F.col("generated_n_chunks") > 0) & d.isNotNull() & ~F.isnan(d)


def kept_and_dropped(f: DataFrame) -> DataFrame:
    return f.groupBy("model_alias").agg(F.count_if(valid()).alias("kept"), F.count_if(~F.coalesce(valid(), F.lit(False))).alias("dropped"))


def mean_std(name: str, column: str) -> list[Column]:
    """Mean and sample deviation; both NaN if any value is, the deviation 0 for a single one."""
    x = F.coalesce(F.col(column), F.lit(float("nan")))
    return [F.round(F.avg(x), 6).alias(f"{name}_mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias(f"{name}_std")]


def summary(f: DataFrame, *group: str) -> DataFrame:
    """Folds and mean and deviation of the natural, generated and delta distances of each group, or of all."""
    return f.groupBy(*group).agg(F.count("*").alias("n_folds"), *(c for n, m in MEASURES.items() for c in mean_std(n, m)))


def natural_pool(f: DataFrame) -> DataFrame:
    """(target_article_id, natural_mean_distance): each target once, of the model last by name."""
    return latest(f.select("target_article_id", "model_alias", "natural_mean_distance"), ["target_article_id"], ["model_alias"]).drop("model_alias")


def ranking(f: DataFrame, match: bool = False) -> DataFrame:
    """(label, n, mean, std): the natural pool and each model by mean distance, or by 1 - it; the nearest first, NaN left out."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    nat = natural_pool(f).where(number("natural_mean_distance")).select(F.lit("natural").alias("label"), F.col("natural_mean_distance").alias("x"))
    gen = f.where(valid() & number("generated_mean_distance")).select(F.col("model_alias").alias("label"), F.col("generated_mean_distance").alias("x"))
    mean = F.round(1 - F.avg("x"), 6) if match else F.round(F.avg("x"), 6)
    out = nat.union(gen).groupBy("label").agg(F.count("*").alias("n"), mean.alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 6).alias("std"))
    order = [F.desc("mean") if match else F.col("mean"), F.col("label")]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row a model


def author_breakdown(f: DataFrame, models: list[str]) -> DataFrame:
    """A row an author, a column a model: mean delta, null where there is none."""
    return f.where(valid()).groupBy("author").pivot("model_alias", models).agg(F.round(F.avg("delta_natural_vs_generated"), 6))


def tricks(f: DataFrame) -> DataFrame:
    """Per model and pooled: folds, tricks (delta < 0), rate, mean and median delta, and the target of the best trick."""
    d = F.col("delta_natural_vs_generated")
    trick = d < 0
    best = F.min(F.when(trick, F.struct(d.alias("d"), "target_article_id"))).getField("target_article_id")
    out = f.where(valid()).rollup("model_alias").agg(
        F.count("*").alias("n_folds"), F.count_if(trick).alias("n_tricks"), F.round(F.count_if(trick) / F.count("*"), 6).alias("trick_rate"),
        F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.median(d), 6).alias("median_delta"), best.alias("best_trick"),
    )
    return out.withColumn("model_alias", F.coalesce("model_alias", F.lit(POOLED)))


def tricks_by(f: DataFrame, *group: str) -> DataFrame:
    d = F.col("delta_natural_vs_generated")
    return f.where(valid()).groupBy(*group).agg(F.count("*").alias("n_folds"), F.count_if(d < 0).alias("n_tricks"), F.round(F.count_if(d < 0) / F.count("*"), 6).alias("trick_rate"))


def trick_matrix(f: DataFrame) -> DataFrame:
    """(target_article_id, models_tricked, n_models): for each target its models with a trick; a model without one is a 0 of the matrix."""
    trick = F.when(valid() & (F.col("delta_natural_vs_generated") < 0), F.col("model_alias"))
    return f.groupBy("target_article_id").agg(F.array_join(F.array_sort(F.collect_set(trick)), ",").alias("models_tricked"), F.countDistinct(trick).alias("n_models"))


def trick_grid(f: DataFrame, models: list[str]) -> DataFrame:
    """(target_article_id, model_alias, trick): the dense matrix of all targets and models; 0 also where there is no fold."""
    grid = f.select("target_article_id").distinct().select("target_article_id", F.explode(F.array(*(F.lit(m) for m in models))).alias("model_alias"))
    trick = f.where(valid()).select("target_article_id", "model_alias", (F.col("delta_natural_vs_generated") < 0).cast("int").alias("trick"))
    return grid.join(trick, ["target_article_id", "model_alias"], "left").na.fill(0, ["trick"])


def author_heatmap(f: DataFrame) -> DataFrame:
    """(author, model_alias, n_folds, natural, generated, delta): mean distances of the valid folds, row by row of the heat map."""
    means = [F.round(F.avg(c), 6).alias(n) for n, c in MEASURES.items()]
    return f.where(valid()).groupBy("author", "model_alias").agg(F.count("*").alias("n_folds"), *means)


def _placed(means: DataFrame, name: str, descending: bool) -> DataFrame:
    order = [F.isnan("mean"), F.desc("mean") if descending else F.col("mean"), F.col(name)]
    return means.select(F.row_number().over(Window.orderBy(*order)).alias("place"), name, "mean")  # a row an author or model


def author_order(f: DataFrame) -> DataFrame:
    """(place, author, mean) by the mean natural distance, the greatest first; NaN comes last, names break ties."""
    return _placed(f.groupBy("author").agg(F.round(F.avg(F.coalesce("natural_mean_distance", F.lit(float("nan")))), 6).alias("mean")), "author", True)


def model_order(f: DataFrame) -> DataFrame:
    """(place, model_alias, mean) by the mean delta, the least first; NaN comes last, names break ties."""
    return _placed(f.groupBy("model_alias").agg(F.round(F.avg(F.coalesce("delta_natural_vs_generated", F.lit(float("nan")))), 6).alias("mean")), "model_alias", False)


def jaccard(f: DataFrame, models: DataFrame) -> DataFrame:
    """(model_a, model_b, both, either, jaccard) of the models' sets of tricked targets; 0 for two empty sets.

    models: model_alias. Pairs are counted within each target, of which there are as many models.
    """
    sets = f.where(valid() & (F.col("delta_natural_vs_generated") < 0)).groupBy("target_article_id").agg(F.collect_set("model_alias").alias("m"))
    size = sets.select(F.explode("m").alias("model_alias")).groupBy("model_alias").agg(F.count("*").alias("n"))
    names = models.select(T.name_key("model_alias").alias("model_alias")).distinct().join(size, "model_alias", "left").select("model_alias", F.coalesce("n", F.lit(0)).alias("n"))
    pairs = sets.select(F.explode("m").alias("model_a"), "m").select("model_a", F.explode("m").alias("model_b")).groupBy("model_a", "model_b").agg(F.count("*").alias("both"))
    all_ = names.groupBy().agg(F.collect_list(F.struct("model_alias", "n")).alias("l"))  # a table of models
    grid = all_.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).select(F.col("a.model_alias").alias("model_a"), F.col("b.model_alias").alias("model_b"), F.col("a.n").alias("x"), F.col("b.n").alias("y"))
    both = grid.join(pairs, ["model_a", "model_b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    either = F.col("x") + F.col("y") - F.col("both")
    return both.select("model_a", "model_b", "both", either.alias("either"), F.when(either > 0, F.round(F.col("both") / either, 6)).otherwise(0.0).alias("jaccard"))


def detection_scores(f: DataFrame) -> DataFrame:
    """(model_alias, score, positive, weight): a model's generated distances against the natural pool, which is counted by rounded score first."""
    gen = f.where(valid()).select("model_alias", F.col("generated_mean_distance").alias("score"), F.lit(True).alias("positive"), F.lit(1).cast("long").alias("weight"))
    models = f.groupBy().agg(F.collect_set("model_alias").alias("models"))  # a row, of a table of models
    pool = natural_pool(f).groupBy(F.round("natural_mean_distance", evaluation.SCORE_PLACES).alias("score")).agg(F.count("*").alias("weight")).join(F.broadcast(models))
    return gen.union(pool.select(F.explode("models").alias("model_alias"), "score", F.lit(False), "weight"))


def detection_auc(f: DataFrame) -> DataFrame:
    return evaluation.scored_auc(detection_scores(f), ["model_alias"])


def delta_quartiles(f: DataFrame) -> DataFrame:
    d = "delta_natural_vs_generated"
    q = lambda p: F.round(F.percentile(d, F.lit(p)), 6)
    return f.where(valid()).groupBy("model_alias").agg(F.min(d).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(d).alias("most"))


def headline(f: DataFrame) -> DataFrame:
    """(pick, name): the model nearest to the natural texts, the best detected, and the hardest and easiest author; names break ties."""
    by_model = f.where(valid()).groupBy("model_alias").agg(F.round(F.avg("generated_mean_distance"), 6).alias("v"))
    by_author = f.where(valid()).groupBy("author").agg(F.round(F.avg("delta_natural_vs_generated"), 6).alias("v"))
    pick = lambda df, c, what, name: df.where(F.col("v").isNotNull() & ~F.isnan("v")).agg(what.alias("s")).select(F.lit(name).alias("pick"), F.col(f"s.{c}").alias("name"))
    least = lambda c: F.min(F.struct("v", c))
    most = lambda c: F.min(F.struct((-F.col("v")).alias("v"), c))
    det = detection_auc(f).select("model_alias", F.col("auc").alias("v"))
    return pick(by_model, "model_alias", least("model_alias"), "best_mimic").union(pick(det, "model_alias", most("model_alias"), "best_detected")).union(pick(by_author, "author", least("author"), "hardest_author")).union(pick(by_author, "author", most("author"), "easiest_author"))
