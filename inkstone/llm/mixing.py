"""Problem 9: mixing sources to target weights, by fitting a budget of tokens to exact document lengths.

Documents are counted by exact token length, so a source is a table of lengths however many documents it has. A
budget is first met by whole passes over the source, then by the same part of every length, and what is left by a
bounded-knapsack program over the lengths. Seeded documents then fill the count chosen for each length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The last part of a budget, in longest documents, that the knapsack program fits; bounds its table, not its input.
TAIL = 4
#: Slices in which documents of one source and length are ordered.
SLICES = 256


def _knapsack(lengths: list[tuple[int, int]], want: int) -> dict[int, int]:
    """How many of each (length, count) to take, so that their sum is as near to want, from below, as it can be."""
    items, sums = [], [1]
    full = (1 << (want + 1)) - 1
    for n, have in lengths:
        have, part = min(have, want // n), 1
        while have > 0:  # binary parts of a bounded count
            k = min(part, have)
            items.append((n, k))
            sums.append((sums[-1] | sums[-1] << n * k) & full)
            have, part = have - k, part * 2
            if sums[-1] >> want & 1:
                have = 0
        if sums[-1] >> want & 1:
            break
    rest, took = sums[-1].bit_length() - 1, {}
    for (n, k), below in zip(reversed(items), reversed(sums[:-1])):
        if not below >> rest & 1:
            rest -= n * k
            took[n] = took.get(n, 0) + k
    return took


def fit(lengths: list[tuple[int, int]], budget: int) -> tuple[int, dict[int, int]]:
    """(whole passes, documents of each length to take once more) for a budget of tokens; lengths: (n_tokens > 0, documents)."""
    total = sum(n * have for n, have in lengths)
    if not total or budget <= 0:
        return 0, {}
    passes, rest = divmod(budget, total)
    take = {n: have * rest // total for n, have in lengths}
    rest -= sum(n * k for n, k in take.items())
    near = TAIL * max(n for n, _ in lengths)
    for n, have in sorted(lengths, reverse=True):  # what rounding left is at most one document of each length
        if rest > near and take[n] < have:
            more = min(have - take[n], (rest - near + n - 1) // n, 1 + (rest - near) // n)
            more = min(more, rest // n)
            take[n] += more
            rest -= n * more
    for n, k in _knapsack([(n, have - take[n]) for n, have in sorted(lengths, reverse=True) if have > take[n]], rest).items():
        take[n] += k
    return passes, {n: k for n, k in take.items() if k}


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths = [(int(n), int(k)) for n, k in zip(pdf["n_tokens"], pdf["docs"])]
    passes, take = fit(lengths, int(pdf["budget"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "passes": passes, "extra": [take.get(n, 0) for n, _ in lengths]})


def plan(sized: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(budgets by source, counts by source and length) of a mix.

    sized: doc key, source, n_tokens. weights: source, target_share, max_repeats; rows without a source, share or
    repeats and repeated sources (but the first by share) are left out. total_tokens is the size that the shares are of;
    by default all tokens of sized. A source that can't reach its share is used max_repeats times, and its shortfall is
    reported, but not made up by others, as these would then exceed their shares.
    """
    weights = weights.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    counts = sized.where("n_tokens > 0 and source is not null").groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("available"))
    both = weights.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        total_tokens = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    budgets = both.withColumn("total_tokens", F.lit(total_tokens).cast("long")).withColumn("budget", F.least(F.floor(F.col("total_tokens") * F.col("target_share")), most).cast("long"))
    budgets = budgets.select("source", "target_share", "max_repeats", "available", "total_tokens", "budget")
    chosen = counts.join(budgets.select("source", "budget"), "source").groupBy("source").applyInPandas(_fit_source, "source string, n_tokens long, passes long, extra long")  # a row for each length of a source
    return budgets, chosen


def reachable_total(sized: DataFrame, weights: DataFrame) -> int:
    """The most tokens of which every source with documents can give its share within its repeats; for plan's total_tokens.

    With it no source falls short, so the shares of what is drawn are the targets too (sources without documents aside).
    """
    by = sized.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    asked = weights.where("target_share > 0 and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("times"))
    return by.join(asked, "source").agg(F.min(F.floor(F.col("available") * F.col("times") / F.col("share")))).first()[0] or 0


def draw(sized: DataFrame, chosen: DataFrame, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """(key, source, n_tokens, repeats): each drawn document and how often it is used, at most max_repeats times.

    Documents of a source and length stand in the order of a seeded hash. It is taken in SLICES slices that are counted
    first, so that one crowded length, such as that of many copies, is ordered by many tasks.
    """
    group = ["source", "n_tokens"]
    hashed = sized.where("n_tokens > 0 and source is not null").select(key, *group).withColumn("h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("slice", F.pmod(F.shiftright("h", 32), F.lit(SLICES)))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows a length
    slices = hashed.groupBy(*group, "slice").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(chosen, group)
    order = Window.partitionBy(*group, "slice").orderBy("h", key)
    ranked = hashed.withColumn("r", F.row_number().over(order)).join(slices, [*group, "slice"])
    drawn = ranked.withColumn("repeats", (F.col("passes") + (F.col("ahead") + F.col("r") <= F.col("extra")).cast("int")).cast("int"))
    return drawn.where("repeats > 0").select(key, *group, "repeats")


def shares(budgets: DataFrame, drawn: DataFrame) -> DataFrame:
    """Each source with what it reached: its share of total_tokens, of the drawn tokens, and the tokens that it is short of.

    A source without documents reaches 0.
    """
    got = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    everywhere = F.sum("tokens").over(Window.partitionBy())  # a row a source
    rows = budgets.join(got, "source", "left").na.fill(0, ["documents", "most_repeats", "tokens"])
    part = lambda whole: F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    short = F.greatest(F.floor(F.col("total_tokens") * F.col("target_share")) - F.col("tokens"), F.lit(0)).cast("long")
    return rows.select("source", "target_share", "max_repeats", "available", "documents", "most_repeats", "tokens", part(F.col("total_tokens")).alias("share"), part(everywhere).alias("share_of_drawn"), short.alias("short_tokens"))
