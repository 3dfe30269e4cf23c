"""Statistics over distances: AUC, permutation tests, ROC points, histograms, and the author similarity matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators import distance as D
from inkstone.operators.folds import vector_sums
from inkstone.plans.lineage import written

BINS = 30
#: Places to which scores are rounded before they are compared.
SCORE_PLACES = 4


def _kinds(scores: DataFrame, group: list[str], name: str, places: int) -> DataFrame:
    """(group, name, p, n): positive and other scores by rounded score; each counts once, or as often as weight says."""
    w = F.col("weight") if "weight" in scores.columns else F.lit(1)
    count = lambda which: F.sum(F.when(which, w).otherwise(0))
    some = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return some.groupBy(*group, F.round("score", places).alias(name)).agg(count(F.col("positive")).alias("p"), count(~F.col("positive")).alias("n"))


def _product(a: str, b: str):
    """The product of two counts as a double; as a long it would overflow from some 10**5 rows on, which is an error."""
    return F.col(a).cast("double") * F.col(b).cast("double")


def auc(histogram: DataFrame, places: int = 6) -> DataFrame:
    """(n_pairs, n_self, n_cross, auc): the chance that a pair of one author is nearer than one of two, ties half.

    NaN if there is only one kind of pair.
    """
    by = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)  # steps of a fixed grid
    h = histogram.withColumn("beyond", F.coalesce(F.sum("n_cross").over(by), F.lit(0)))
    won = F.sum(F.col("n_self") * (F.col("beyond") + F.col("n_cross") / 2))
    s, c = F.sum("n_self"), F.sum("n_cross")
    out = h.agg(F.coalesce(s + c, F.lit(0)).alias("n_pairs"), F.coalesce(s, F.lit(0)).alias("n_self"), F.coalesce(c, F.lit(0)).alias("n_cross"), won.alias("won"))
    value = F.when((F.col("n_self") > 0) & (F.col("n_cross") > 0), F.round(F.col("won") / _product("n_self", "n_cross"), places)).otherwise(float("nan"))
    return out.select("n_pairs", "n_self", "n_cross", value.alias("auc"))


def permutation_test(rows: DataFrame | D.Blocks, permutations: int = 250, seed: int = 1729, metric: str = "cosine", histogram: DataFrame | None = None) -> DataFrame:
    """(k, n_self, auc): the AUC after each shuffle of the rows' authors; distances are ranked once, for all shuffles.

    A shuffle gives each row the author of the row whose place by id is this row's place by a seeded hash. rows: also
    blocks with ids; histogram: that of their pairs, if it is there.
    """
    blocks = rows if isinstance(rows, D.Blocks) else D.packed(rows, ids=True)
    h = D.pair_histogram(blocks, metric) if histogram is None else histogram
    steps = h.select("step", (F.col("n_self") + F.col("n_cross")).alias("n")).toPandas().sort_values("step")  # a bounded number of steps
    total, ahead = int(steps["n"].sum()), np.cumsum(steps["n"]) - steps["n"]
    middle = dict(zip(steps["step"], ahead + (steps["n"] + 1) / 2))
    sums = D.permuted_ranks(blocks, middle, permutations, seed, metric)
    n1 = F.col("n_self").cast("double")
    n0 = F.lit(float(total)) - n1
    value = F.when((n1 > 0) & (n0 > 0), 1 - (F.col("rank_sum") - n1 * (n1 + 1) / 2) / (n1 * n0)).otherwise(float("nan"))
    return sums.select("k", "n_self", value.alias("auc"))


def permutation_summary(permuted: DataFrame, observed: float) -> DataFrame:
    """Valid shuffles, their mean, deviation, median and high quantiles, and p = (1 + those at least observed) / (1 + valid)."""
    ok = permuted.where(~F.isnan("auc"))
    out = ok.agg(
        F.count("*").alias("n_valid"), F.avg("auc").alias("mean"), F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("std"), F.median("auc").alias("median"),
        F.percentile("auc", F.lit(0.95)).alias("q95"), F.percentile("auc", F.lit(0.99)).alias("q99"), F.count_if(F.col("auc") >= observed).alias("n_at_least"),
    )
    return out.withColumn("p_value", F.when(F.col("n_valid") > 0, (1 + F.col("n_at_least")) / (1 + F.col("n_valid"))).otherwise(float("nan")))


def histogram_bins(histogram: DataFrame, bins: int = BINS) -> DataFrame:
    """(is_self, bin, n): each kind's pairs in bins of equal width over the kind's own range; empty bins are left out."""
    long = histogram.select("step", F.explode(F.array(F.struct(F.lit(1).alias("is_self"), F.col("n_self").alias("n")), F.struct(F.lit(0).alias("is_self"), F.col("n_cross").alias("n")))).alias("x")).select("step", "x.*").where("n > 0")
    kind = Window.partitionBy("is_self")  # steps of a fixed grid
    lo, hi = F.min("step").over(kind), F.max("step").over(kind)
    at = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col("step") - lo) * bins / (hi - lo)).cast("int"))).otherwise(0)
    return long.withColumn("bin", at).groupBy("is_self", "bin").agg(F.sum("n").alias("n"))


def scored_auc(scores: DataFrame, group: list[str], places: int = SCORE_PLACES) -> DataFrame:
    """(group, n_pos, n_neg, auc) of scores (group, score, positive), higher being more positive, ties half."""
    steps = _kinds(scores, group, "s", places)
    below = Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # rounded scores of a group
    h = steps.withColumn("less", F.coalesce(F.sum("n").over(below), F.lit(0)))
    out = h.groupBy(*group).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)).alias("won"))
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(F.col("won") / _product("n_pos", "n_neg"), 6)).otherwise(float("nan"))
    return out.select(*group, "n_pos", "n_neg", value.alias("auc"))


def roc_points(scores: DataFrame, group: list[str], places: int = SCORE_PLACES) -> DataFrame:
    """(group, threshold, tpr, fpr): parts of both kinds at or above each rounded score; 0 where a kind is missing."""
    steps = _kinds(scores, group, "threshold", places)
    above, all_ = Window.partitionBy(*group).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group)
    part = lambda c: F.when(F.sum(c).over(all_) > 0, F.round(F.sum(c).over(above) / F.sum(c).over(all_), 6)).otherwise(0.0)
    return steps.select(*group, "threshold", part("p").alias("tpr"), part("n").alias("fpr"))


def author_matrix(rows: DataFrame, exclude_same_doc: bool = True) -> DataFrame:
    """(author_i, author_j, n_pairs, mean_distance) of all authors, by cosine.

    The mean over pairs of unit vectors is 1 - (S_i . S_j) / (n_i n_j), S being the sum of an author's vectors; pairs
    within one document are taken off by the same rule. Linear in the rows. A document has one author. NaN for no pairs.
    """
    unit = D.unit_rows(rows).select("author", "doc", "vec")
    doc = written(vector_sums(unit, "author", "doc"), "documents")
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    if exclude_same_doc:
        counts = doc.groupBy("author").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.sum(square("s")).alias("q"))
    else:  # only a row with itself is no pair
        counts = unit.groupBy("author").agg(F.count("*").alias("n"), F.count("*").alias("own"), F.sum(square("vec")).alias("q"))
    vec = vector_sums(doc.select("author", F.col("s").alias("vec")), "author").select("author", F.col("s").alias("vec"))
    sums = written(vec.join(counts, "author").select(F.col("author").alias("id"), "vec", "q", "n", "own"), "authors")

    def value(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"author_i": [], "author_j": [], "n_pairs": [], "mean_distance": []})
        dot = np.stack(a["vec"].to_numpy()) @ np.stack(b["vec"].to_numpy()).T
        n = np.outer(a["n"], b["n"])
        if same:
            dot[np.diag_indices(len(a))] -= a["q"].to_numpy()
            n[np.diag_indices(len(a))] -= a["own"].to_numpy()
        i, j = np.indices(dot.shape).reshape(2, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, 1 - dot / n, np.nan)
        x, y = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        # a pair within one author was counted from both ends
        out = pd.DataFrame({"author_i": x, "author_j": y, "n_pairs": np.where(x == y, n[i, j] // 2, n[i, j]), "mean_distance": mean[i, j]})
        return out if same else pd.concat([out, out.rename(columns={"author_i": "author_j", "author_j": "author_i"})])

    got = D.cells(sums, value, "author_i string, author_j string, n_pairs long, mean_distance double")
    return got.withColumn("mean_distance", F.coalesce("mean_distance", F.lit(float("nan"))))  # pandas hands NaN over as null


def similarity(matrix: DataFrame, normalize: bool = True) -> DataFrame:
    """(author_i, author_j, similarity): 1 - mean distance within [0, 1], or stretched to it over all cells; NaN stays."""
    s = F.lit(1.0) - F.col("mean_distance")
    if not normalize:
        return matrix.select("author_i", "author_j", F.when(F.isnan("mean_distance"), s).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).alias("similarity"))
    ends = matrix.where(~F.isnan("mean_distance")).agg((1 - F.max("mean_distance")).alias("lo"), (1 - F.min("mean_distance")).alias("hi")).first()
    span = ends.hi - ends.lo if ends.lo is not None else 0.0
    value = F.when(F.isnan("mean_distance"), s).otherwise((s - ends.lo) / span if span > 0 else F.lit(0.0))
    return matrix.select("author_i", "author_j", value.alias("similarity"))
