"""Problem 2: splits that keep related records together, by Boruvka contraction to a spanning forest.

Records are linked by the sources that they share. A source with one author links nothing further, so the graph holds
only authors, with a star of edges for every source of several. In each round every component takes its least edge to
another one; the taken edges are the forest, which is written, and the components are at least halved. Components are
then stratified by their size in records and dealt to the splits systematically within each band of sizes.
Nothing is gathered: the driver sees only whether edges are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.plans.lineage import written

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Hexadecimal digits of the slices in which a band of component sizes is accumulated, so that no task orders a whole band.
SLICE_DIGITS = 3


def author_name(author) -> Column:
    """Lower case, single spaces; null for null, blank and `unknown` authors."""
    name = F.trim(F.regexp_replace(F.lower(author), r"(?U)\s+", " "))
    return F.when((name != "") & (name != "unknown"), name)


def _rooted(parent: DataFrame) -> DataFrame:
    """Follow (c, p) to the roots, doubling the stride until nothing changes. A root is its own parent."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "p2-roots")
        if not parent.where("moved").limit(1).count():
            return parent.select("c", "p")
        parent = parent.select("c", "p")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, components) of edges (a, b, weight): forest has a, b, weight; components has node, root.

    Only nodes of edges between two different nodes are listed. Ties of weight are broken by the nodes, so the forest
    is that of least total weight and the same on every run. Null nodes and loops are left out; repeated edges count once.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    left = written(edges.where("a <> b").groupBy(lo.alias("a"), hi.alias("b")).agg(F.min("weight").alias("weight")).select("a", "b", "weight", F.col("a").alias("u"), F.col("b").alias("v")), "p2-edges")
    node = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    of = written(node.select("node", F.col("node").alias("root")), "p2-components")
    taken = []
    while left.limit(1).count():
        both = left.union(left.select("a", "b", "weight", F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min(F.struct("weight", "a", "b", "v")).alias("e")).select(F.col("u").alias("c"), F.col("e.v").alias("p"), "e.a", "e.b", "e.weight"), "p2-least")
        taken.append(least.select("a", "b", "weight"))
        back = least.select(F.col("c").alias("p"), F.col("p").alias("back"))
        parent = least.select("c", "p").join(back, "p").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        root = _rooted(parent)
        of = written(of.join(root.select(F.col("c").alias("root"), F.col("p").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "p2-components")
        for end in ("u", "v"):
            left = left.join(root.select(F.col("c").alias(end), F.col("p").alias("to")), end).drop(end).withColumnRenamed("to", end)
        lo, hi = F.least("u", "v"), F.greatest("u", "v")
        left = left.where("u <> v").groupBy(lo.alias("u"), hi.alias("v")).agg(F.min(F.struct("weight", "a", "b")).alias("e"))
        left = written(left.select("e.a", "e.b", "e.weight", "u", "v"), "p2-edges")
    forest = reduce(DataFrame.union, taken).distinct() if taken else left.select("a", "b", "weight")
    return forest, of


def _source(source: str) -> Column:
    return F.when(F.trim(F.col(source)) != "", F.col(source))


def _links(rows: DataFrame, source: str, author: str) -> DataFrame:
    """Different (source, author); blank sources are null."""
    return rows.select(_source(source).alias("source"), author_name(F.col(author)).alias("author")).distinct()


def author_components(rows: DataFrame, source: str = "source_doc_id", author: str = "author") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, forest, components of linked authors) of rows; a component's root is its least author."""
    links = written(_links(rows, source, author), "p2-links")
    known = links.where("source is not null and author is not null")
    centre = known.groupBy("source").agg(F.min("author").alias("a"), F.max("author").alias("z")).where("a <> z").drop("z")
    star = known.join(centre, "source").where("author <> a").select("a", F.col("author").alias("b"), F.col("source").alias("weight"))
    forest, of = spanning_forest(star)
    least = of.groupBy("root").agg(F.min("node").alias("least"))
    return links, forest, written(of.join(least, "root").select("node", F.col("least").alias("root")), "p2-authors")


def linked_authors(rows: DataFrame, source: str = "source_doc_id", author: str = "author") -> DataFrame:
    """(author_a, author_b), author_a < author_b: authors that must share a split.

    That is all pairs of a component; members() gives the same in a row an author.
    """
    of = author_components(rows, source, author)[2]
    b = of.select(F.col("node").alias("author_b"), "root")
    return of.select(F.col("node").alias("author_a"), "root").join(b, "root").where("author_a < author_b").select("author_a", "author_b")


def members(rows: DataFrame, source: str = "source_doc_id", author: str = "author") -> DataFrame:
    """(author, root) of every author that is linked to another one; authors of one root must share a split."""
    return author_components(rows, source, author)[2].select(F.col("node").alias("author"), "root")


def _part(x: Column, splits) -> Column:
    edge, part = 0.0, F
    for name, share in splits[:-1]:
        edge += share
        part = part.when(x < edge, name)
    return part.otherwise(splits[-1][0])


def dealt(components: DataFrame, splits=SPLITS) -> DataFrame:
    """(root, rows, band, split) of components (root, rows): bands are powers of two of rows.

    Within a band components stand in the order of their hash; the place of a component's middle row, as a part of the
    band's rows, decides its split. So each band is divided in proportion, to within one component.
    """
    banded = components.withColumn("band", F.floor(F.log2(F.col("rows"))).cast("int")).withColumn("h", F.md5("root")).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = banded.groupBy("band", "slice").agg(F.sum("rows").alias("in_slice"))
    order = Window.partitionBy("band").orderBy("slice")  # at most 4096 rows a band
    slices = slices.withColumn("ahead", F.sum("in_slice").over(order) - F.col("in_slice")).withColumn("in_band", F.sum("in_slice").over(Window.partitionBy("band")))
    inner = Window.partitionBy("band", "slice").orderBy("h", "root")
    placed = banded.withColumn("upto", F.sum("rows").over(inner)).join(slices, ["band", "slice"])
    x = (F.col("ahead") + F.col("upto") - F.col("rows") / 2) / F.col("in_band")
    return placed.select("root", "rows", "band", _part(x, splits).alias("split"))


def splits(rows: DataFrame, key: str = "chunk_id", source: str = "source_doc_id", author: str = "author", proportions=SPLITS) -> DataFrame:
    """(key, source, root, split): every row's split, the same for all rows linked by sources or authors.

    A row without source and author stands alone, under its key. Repeated rows come out once and count once; a key of
    several sources comes out with each, and links nothing by itself. A component larger than
    a split's share can't be divided; its band then leans to the split that its middle falls in.
    """
    links, _, of = author_components(rows, source, author)
    of = of.withColumnRenamed("node", "author")
    rooted = links.where("author is not null").join(of, "author", "left").withColumn("root", F.concat(F.lit("author:"), F.coalesce("root", "author")))
    by_source = rooted.where("source is not null").groupBy("source").agg(F.min("root").alias("root"))  # one value, as a source's authors are linked
    by_author = rooted.groupBy("author").agg(F.min("root").alias("root"))
    each = rows.select(F.col(key).alias("k"), _source(source).alias("source"), author_name(F.col(author)).alias("author"))
    in_source = each.where("source is not null").select("k", "source").distinct().join(by_source, "source", "left").select("k", "source", F.coalesce("root", F.concat(F.lit("source:"), "source")).alias("root"))
    own = F.concat(F.lit("row:"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    no_source = each.where("source is null").distinct().join(by_author, "author", "left").select("k", "source", F.coalesce("root", own).alias("root"))
    placed = written(in_source.union(no_source).distinct(), "p2-placed")
    deal = dealt(placed.groupBy("root").agg(F.count("*").alias("rows")), proportions)
    return placed.join(deal.select("root", "split"), "root").select(F.col("k").alias(key), F.col("source").alias(source), "root", "split")
