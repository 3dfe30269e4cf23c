"""Streams: new articles scored against a frozen feature space, batch by batch.

Fitting and scoring are apart, so a stream needs only the vocabulary, the reference means and deviations, and each
author's vector sum, all of bounded size or joined as a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.functions import vectors as V
from inkstone.operators import features
from inkstone.operators.folds import mean_cosine, vector_sums


def author_sums(space: features.MostFrequentWords, chunks: DataFrame) -> DataFrame:
    """(author, n, s) of chunks (id, author, text): the profile that new articles are held against."""
    unit = space.standardized(chunks, keep=["author"]).select("author", V.unit(F.col("vec")).alias("vec"))
    return vector_sums(unit, "author")


def scored(articles: DataFrame, space: features.MostFrequentWords, profiles: DataFrame) -> DataFrame:
    """(id, author, distance): each article's mean cosine distance to the chunks of the author it claims.

    articles: id, author, text, a stream or a table. NaN for an author without a profile.
    """
    vec = space.standardized(articles, keep=["author"]).select("id", "author", V.unit(F.col("vec")).alias("vec"))
    both = vec.join(profiles, "author", "left")
    distance = mean_cosine(F.coalesce("s", F.col("vec")), F.coalesce("n", F.lit(0)), F.col("vec"), F.lit(1))
    return both.select("id", "author", distance.alias("distance"))


def run(articles: DataFrame, space: features.MostFrequentWords, profiles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score all that is there of a stream into Parquet, once; a rerun goes on from the checkpoint."""
    return scored(articles, space, profiles).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
