"""Distances between all rows of a table, never as one row a pair.

What is needed of a distance matrix is either its distribution (AUC, permutation tests, histograms) or each query's
nearest rows. Rows are hashed into blocks of bounded size; two blocks make a tile, which a task takes in parts, each a
matrix product; only counts by distance, sums, or the nearest rows of each query, leave the task. Blocks are files that
tasks read (plans/blocks.py); those of the nearest dense rows are shuffled.

rows: id, author, doc and vec (array<double>), or idx and val for sparse rows (of length 1). Cosine distances are of
vectors at length 1; one without length is at distance 1 from all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import vectors as V
from inkstone.plans.blocks import Blocks, Made, dealt, folder, load, over, pieces, save
from inkstone.plans.lineage import written

#: Rows of a block, and of the part of it that is multiplied at a time; a row is sent to as many tiles as there are blocks.
BLOCK, PART = 8192, 1024
SPARSE_BLOCK = 1024
#: Rows and columns of the part of a tile whose distances are there at a time.
ROWS, COLUMNS, SPARSE_ROWS = 256, 512, 32
#: Rows whose columns have at most so many different values on average share their minima with the other side's, which a matrix product adds up.
SHARED = 25
#: Rows of a block of author means by Manhattan distance. Authors' counts by value are multiplied instead of rows if that takes at most so many products for each difference.
MEANS_BLOCK, CHEAPER = 2048, 15
#: A column that so many times the squared part of the rows have is multiplied as one of a matrix (that takes about so much less time a product).
DENSE = 150
#: Tasks that make labels; a label of more than one in so many rows is summed up as a matrix of its own; rows of a batch that leaves a task.
LABEL_TASKS, FREQUENT, ROWS_OUT = 24, 50, 50_000
#: Rows whose ranks are there at a time for all relabellings; a multiple of ROWS.
STRIP = 1024
#: A smaller table is cut into so many blocks, of at least PART / 2 rows, that its tiles spread evenly over some cores.
LEAST_BLOCKS = 12
#: Distances are counted in steps of 10**-PLACES. Manhattan distances are counted as means over the columns, those over
#: MOST as MOST, so that there are at most MOST * 10**PLACES + 1 steps.
PLACES, MOST = 4, 100


def unit_rows(rows: DataFrame) -> DataFrame:
    """vectors.unit() of vec, on arrays; as an expression it would take the length anew for each value."""

    def divide(batches):
        for batch in batches:
            vec = batch.column(at)
            flat, lengths = vec.flatten().to_numpy(zero_copy_only=False), np.diff(vec.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            n = np.sqrt(np.bincount(row, flat * flat, len(lengths)))
            flat = flat / np.where(n < V.EPS, 1.0, n)[row]
            ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat)) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    at = rows.columns.index("vec")
    return rows.mapInArrow(divide, rows.schema)


def _distances(a: pd.DataFrame, b: pd.DataFrame, metric: str) -> np.ndarray:
    x, y = np.stack(a["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
    return 1 - np.clip(x @ y.T, -1, 1) if metric == "cosine" else _manhattan(x, np.ascontiguousarray(y.T))


def _steps(d: np.ndarray, metric: str, columns: int) -> np.ndarray:
    """Steps of distances, half a step up; d is overwritten."""
    if metric != "cosine":
        np.divide(d, max(columns, 1), out=d)
        np.minimum(d, MOST, out=d)
    np.multiply(d, 10**PLACES, out=d)
    np.add(d, 0.5, out=d)
    return d.astype(np.int64)


def _many(n: int, block: int, part: int) -> int:
    return max(1, -(-n // block), min(LEAST_BLOCKS, -(-2 * n // part)))


def packed(rows: DataFrame | Made, block: int | None = None, ids: bool = False, names: bool = False) -> Blocks:
    """rows as blocks of arrays in the shared folder, made where the rows are; with ids, or with authors' names, if asked for."""
    made = rows if isinstance(rows, Made) else None
    rows, make = (made.texts, made.make) if made else (rows, iter)
    dense = "vec" in rows.columns
    if dense:
        block, part = _sizes(block)
        size = max(1, -(-(n := rows.count()) // _many(n, block, part)))
    else:
        size = block or SPARSE_BLOCK  # counting them would make them once more
    where = folder(rows.sparkSession, "blocks")
    cols = rows.select("id", F.col("author").alias("name"), F.xxhash64("author").alias("author"), F.xxhash64("doc").alias("doc"), *(["vec"] if dense else [made.value.alias("t")] if made else ["idx", "val"]))

    def put(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        author, doc = (t.column(c).to_numpy() for c in ("author", "doc"))
        vec = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(author), -1) if dense else None
        order = np.lexsort((doc, author)) if vec is None or names else _alike(vec)
        out = {"author": author[order], "doc": doc[order]}
        if ids:
            out["id"] = t.column("id").take(pa.array(order)).combine_chunks()
        there, first = np.unique(out["author"], return_index=True)
        if names:
            out["name"] = t.column("name").take(pa.array(order[first])).combine_chunks()
        if dense:
            out["vec"] = vec[order]
        else:
            out |= _by_column(t.column("idx").combine_chunks(), t.column("val").combine_chunks(), order)
        return pa.RecordBatch.from_pydict({"name": [save(where, out)], "n": [len(author)], "authors": [there.tobytes()]})

    def cut(batches):
        held, n = [], 0
        for batch in make(batches):
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, size - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == size:
                    yield put(held)
                    held, n = [], 0
        if held:
            yield put(held)

    out = sorted(cols.mapInArrow(cut, "name string, n long, authors binary").collect())  # a row a block
    return Blocks(rows.sparkSession, where, [r[0] for r in out], [r[1] for r in out], [bytes(r[2]) for r in out])


def _alike(vec: np.ndarray) -> np.ndarray:
    """An order of rows that brings together those that share values.

    Relative frequencies are counts by a text's words: the least ratio of a row's values to the least of their columns
    tells its number of words, whatever the columns are scaled by.
    """
    above = vec - vec.min(axis=0)
    above[above < V.EPS] = np.inf
    least = above.min(axis=0)
    return np.argsort((above / np.where(np.isfinite(least), least, 1.0)).min(axis=1), kind="stable")


def _by_column(idx: pa.ListArray, val: pa.ListArray, order: np.ndarray) -> dict:
    """Sparse rows, in the given order, as cols, the different columns, and for each from start on the rows that have it and their values."""
    lengths, place = np.diff(idx.offsets.to_numpy()), np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    cols, code = np.unique(idx.flatten().to_numpy(), return_inverse=True)
    by = np.argsort(code.astype(np.int32), kind="stable")
    return {"cols": cols, "start": np.r_[0, np.cumsum(np.bincount(code, minlength=len(cols)))], "row": np.repeat(place, lengths)[by], "val": val.flatten().to_numpy()[by]}


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each lo on, n of each."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _equal(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells in which x and y are equal."""
    order = np.argsort(y, kind="stable")
    lo, hi = (np.searchsorted(y, x, side, sorter=order) for side in ("left", "right"))
    return np.repeat(np.arange(len(x)), hi - lo), order[_runs(lo, hi - lo)]


def _dots(a: dict, b: dict) -> Iterator[tuple[np.ndarray, int]]:
    """(products of some rows of a with all of b, the first of them) of sparse rows.

    Columns that many rows of both sides have are multiplied as matrices, the others entry by entry.
    """
    na, nb = len(a["author"]), len(b["author"])
    _, ia, ib = np.intersect1d(a["cols"], b["cols"], assume_unique=True, return_indices=True)
    fa, fb = (s["start"][i + 1] - s["start"][i] for s, i in ((a, ia), (b, ib)))
    many = fa.astype(np.float64) * fb * DENSE > float(na) * nb
    full = []
    for s, i, n in ((a, ia[many], na), (b, ib[many], nb)):
        width, at = s["start"][i + 1] - s["start"][i], _runs(s["start"][i], s["start"][i + 1] - s["start"][i])
        m = np.zeros((n, len(i)))
        m[s["row"][at], np.repeat(np.arange(len(i)), width)] = s["val"][at]
        full.append(m)
    i, begin, width = ia[~many], b["start"][ib[~many]], fb[~many]
    at = _runs(a["start"][i], fa[~many])
    row, val, begin, width = a["row"][at], a["val"][at], np.repeat(begin, fa[~many]), np.repeat(width, fa[~many])
    order = np.argsort(row, kind="stable")
    row, val, begin, width = row[order], val[order], begin[order], width[order]
    for r0 in range(0, na, SPARSE_ROWS):
        r1 = min(r0 + SPARSE_ROWS, na)
        out = full[0][r0:r1] @ full[1].T
        e = slice(*np.searchsorted(row, [r0, r1]))
        if e.stop > e.start:
            at = _runs(begin[e], width[e])
            cell = np.repeat((row[e].astype(np.int64) - r0) * nb, width[e]) + b["row"][at]
            out += np.bincount(cell, np.repeat(val[e], width[e]) * b["val"][at], minlength=out.size).reshape(out.shape)
        yield out, r0


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of absolute differences: the sums of both less twice that of the lesser values, column by column."""
    out, lesser = np.empty((len(x), y.shape[1])), np.empty_like(y)
    one, total = np.ones(y.shape[0]), y.sum(axis=0)
    for i, row in enumerate(x):
        np.minimum(y, row[:, None], out=lesser)
        np.dot(one, lesser, out=out[i])
        out[i] = row.sum() + total - 2 * out[i]
    return np.maximum(out, 0, out=out)


def _shared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(column, value, rows that have it as a matrix of ones) of the different values over 0 of rows; None if they are too many."""
    columns, values, has = [], [], []
    for k in range(x.shape[1]):
        v, code = np.unique(x[:, k], return_inverse=True)
        skip = int(len(v) > 0 and v[0] <= 0)
        columns.append(np.full(len(v) - skip, k))
        values.append(v[skip:])
        has.append((code - skip, sum(map(len, values[:-1]))))
        if has[-1][1] + len(values[-1]) > SHARED * x.shape[1]:
            return None
    columns, values = np.concatenate(columns or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0)])
    ones = np.zeros((len(x), len(values)))
    for code, begin in has:
        row = np.flatnonzero(code >= 0)
        ones[row, begin + code[row]] = 1
    return columns, values, ones


def _manhattan_shared(x: np.ndarray, y: np.ndarray, column: np.ndarray, value: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """_manhattan() of values from 0 on by _shared(): the lesser of each value and the other side is taken once for all rows that have it."""
    lesser = y[column]
    np.minimum(lesser, value[:, None], out=lesser)
    out = ones @ lesser
    np.multiply(out, -2, out=out)
    out += x.sum(axis=1)[:, None]
    out += y.sum(axis=0)
    return np.maximum(out, 0, out=out)


def _parts_of(a: dict, b: dict, metric: str, same: bool) -> Iterator[tuple[np.ndarray, slice, slice]]:
    """(distances, rows of a, rows of b) of each part of a tile; of a block with itself those left of the diagonal's parts are left out."""
    if "vec" not in a:
        for d, r0 in _dots(a, b):
            yield np.clip(1 - d, 0, 2, out=d), slice(r0, r0 + len(d)), slice(0, d.shape[1])
        return
    x, y = a["vec"], np.ascontiguousarray(b["vec"].T)
    if metric != "cosine":  # differences stay, and most words' values are 0
        low = np.minimum(x.min(axis=0), y.min(axis=1))
        x, y = x - low, y - low[:, None]
    sides = [(c0, np.ascontiguousarray(y[:, c0 : c0 + COLUMNS])) for c0 in range(0, y.shape[1], COLUMNS)]
    for r0 in range(0, len(x), ROWS):
        rows = x[r0 : r0 + ROWS]
        shared = _shared(rows) if metric != "cosine" else None
        for c0, cols in sides:
            if same and c0 + cols.shape[1] <= r0:
                continue
            if metric == "cosine":
                d = rows @ cols
                np.subtract(1, d, out=d)
                np.clip(d, 0, 2, out=d)
            else:
                d = _manhattan(rows, cols) if shared is None else _manhattan_shared(rows, cols, *shared)
            yield d, slice(r0, r0 + len(rows)), slice(c0, c0 + cols.shape[1])


def _upper(r: slice, c: slice) -> np.ndarray | None:
    """Which cells are above the diagonal of a block with itself; None if all are."""
    return None if c.start >= r.stop else np.arange(c.start, c.stop)[None, :] > np.arange(r.start, r.stop)[:, None]


def _sizes(block: int | None) -> tuple[int, int]:
    return block or BLOCK, min(block or BLOCK, PART)


def _add(total: np.ndarray, new: np.ndarray, sign: int = 1) -> np.ndarray:
    if len(new) > len(total):
        total = np.concatenate([total, np.zeros(len(new) - len(total), total.dtype)])
    total[: len(new)] += sign * new
    return total


def _tile_histogram(a: dict, b: dict, same: bool, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by step, of one author and in all."""
    of_one, every = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d, r, c in _parts_of(a, b, metric, same):
        step = _steps(d, metric, a["vec"].shape[1] if "vec" in a else 1)
        upper = _upper(r, c) if same else None
        every = _add(every, np.bincount(step.ravel() if upper is None else step[upper]))
        i, j = _equal(a["author"][r], b["author"][c])
        k, m = _equal(a["doc"][r], b["doc"][c])
        if upper is not None:
            (i, j), (k, m) = ((p[ok], q[ok]) for p, q, ok in ((i, j, upper[i, j]), (k, m, upper[k, m])))
        of_one, every = _add(of_one, np.bincount(step[i, j])), _add(every, np.bincount(step[k, m]), -1)
        both = a["author"][r][k] == b["author"][c][m]
        of_one = _add(of_one, np.bincount(step[k[both], m[both]]), -1)
    return of_one, every


def pair_histogram(rows: DataFrame | Made | Blocks, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(step, n_self, n_cross): pairs of rows of different documents by distance in steps, of one or of two authors."""
    blocks = rows if isinstance(rows, Blocks) else packed(rows, block)
    read = blocks.reader()

    def count(tiles):
        of_one, every = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i, j in tiles:
            own, all_ = _tile_histogram(read(i), read(j), i == j, metric)
            of_one, every = _add(of_one, own), _add(every, all_)
        of_one = _add(of_one, np.zeros(len(every), np.int64))
        step = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"step": step, "n_self": of_one[step], "n_cross": every[step] - of_one[step]})

    each = over(blocks.spark, blocks.tiles(), count, "step long, n_self long, n_cross long")
    return each.groupBy("step").agg(F.sum("n_self").alias("n_self"), F.sum("n_cross").alias("n_cross"))


def _labels(blocks: Blocks, permutations: int, seed: int) -> tuple[list[str], list[int], int]:
    """Files of labels (one for some relabellings, int32, rows in the order of the blocks), the relabellings of each, and pairs of one label.

    Row i of the order of ids gets the author of the row whose place by id is i's place by md5 of seed, k and id. A task
    orders all rows, one relabelling after the other; rows are far fewer here than pairs.
    """
    if not blocks.names:
        return [], list(range(permutations)), 0
    groups = [[k for k in range(g, permutations, LABEL_TASKS)] for g in range(min(LABEL_TASKS, permutations))]
    where, names = blocks.where, blocks.names
    n_authors = np.unique(np.concatenate([np.frombuffer(a, np.int64) for a in blocks.authors] or [np.zeros(0, np.int64)]))

    def make(ks):
        ids, codes = [], []
        for name in names:
            b = load(where, name)
            ids += b["id"].to_pylist()
            codes.append(np.searchsorted(n_authors, b["author"]).astype(np.int32))
        codes = np.concatenate(codes)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        author, text = codes[order], [ids[i].encode() for i in order]
        out = np.empty((len(ks), len(ids)), np.int32)
        for row, k in enumerate(ks):
            key = np.frombuffer(b"".join([hashlib.md5(b"%d:%d:%s" % (seed, k, t)).digest() for t in text]), ">u8").reshape(-1, 2)
            at = np.lexsort((key[:, 1], key[:, 0]))  # stable, so that ids break ties
            own = np.empty(len(ids), np.int32)
            own[at] = author
            out[row, order] = own
        sizes = np.bincount(codes).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"group": [ks[0]], "name": [save(where, out.tobytes())], "pairs": [int((sizes * (sizes - 1) // 2).sum())]})

    made = sorted(over(blocks.spark, groups, make, "group long, name string, pairs long").collect())
    return [r[1] for r in made], [k for g in groups for k in g], made[0][2] if made else 0


def _sorted_labels(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the labels of a side in order, their rows, which labels are frequent, labels whose rows are summed up as a matrix); made once a tile."""
    order = np.argsort(y, kind="stable").astype(np.int32)
    often = np.bincount(y) * FREQUENT > len(y)
    return y[order], order, often, np.flatnonzero(often)


def _same_sums(ranks: np.ndarray, x: np.ndarray, side: tuple) -> float:
    """The sum of the cells in which the labels of row and column (side, of _sorted_labels()) are equal."""
    y, order, often, frequent = side
    total = 0.0
    for label in frequent:  # at most FREQUENT
        r = np.flatnonzero(x == label)
        if len(r):
            total += ranks[np.ix_(r, order[slice(*np.searchsorted(y, [label, label + 1]))])].sum()
    known = np.flatnonzero(x < len(often))
    row = known[~often[x[known]]]
    lo, hi = (np.searchsorted(y, x[row], side) for side in ("left", "right"))
    return total + ranks[np.repeat(row, hi - lo), order[_runs(lo, hi - lo)]].sum()


def permuted_ranks(blocks: Blocks, middle: dict[int, float], permutations: int, seed: int, metric: str = "cosine") -> DataFrame:
    """(k, rank_sum, n_self) of each relabelling k of blocks that have ids; middle: the mid-rank of each step."""
    rank_of = np.zeros(max(middle, default=0) + 1)
    rank_of[list(middle)] = list(middle.values())
    shared = blocks.spark.sparkContext.broadcast(rank_of)  # a bounded number of steps
    names, ks, pairs = _labels(blocks, permutations, seed)
    where, read, n, offset = blocks.where, blocks.reader(), sum(blocks.sizes), np.r_[0, np.cumsum(blocks.sizes)]
    counts = [len(range(g, permutations, LABEL_TASKS)) for g in range(len(names))]

    def labels(k: int) -> np.ndarray:
        size, at = int(offset[k + 1] - offset[k]), int(offset[k])
        return np.concatenate([np.frombuffer(b"".join(pieces(where, name, [((i * n + at) * 4, size * 4) for i in range(m)])), np.int32).reshape(m, size) for name, m in zip(names, counts)])

    def add(tiles):
        rank_of, total, less = shared.value, np.zeros(len(ks)), np.zeros(len(ks), np.int64)
        own: dict[int, np.ndarray] = {}
        for i, j in tiles:
            a, b = read(i), read(j)
            own = {k: own[k] if k in own else labels(k) for k in {i, j}}
            sides = [_sorted_labels(y) for y in own[j]]
            strip, first, stop = None, 0, 0

            def close():
                for k, side in enumerate(sides):  # noqa: B023
                    total[k] += _same_sums(strip[: stop - first], own[i][k, first:stop], side)  # noqa: B023

            for d, r, c in _parts_of(a, b, metric, i == j):
                if strip is None or r.stop > first + STRIP:
                    if strip is not None:
                        close()
                    strip, first = np.zeros((min(STRIP, len(a["author"]) - r.start), len(b["author"]))), r.start
                stop = max(stop, r.stop)
                part = rank_of[_steps(d, metric, a["vec"].shape[1] if "vec" in a else 1)]
                p, q = _equal(a["doc"][r], b["doc"][c])
                part[p, q] = 0
                if i == j and (upper := _upper(r, c)) is not None:
                    part *= upper
                    p, q = p[upper[p, q]], q[upper[p, q]]
                strip[r.start - first : r.stop - first, c] = part
                if len(p):
                    less += np.count_nonzero(own[i][:, r][:, p] == own[j][:, c][:, q], axis=1)
            if strip is not None:
                close()
        yield pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.int32()), "rank_sum": total, "less": less})

    each = over(blocks.spark, blocks.tiles(), add, "k int, rank_sum double, less long")
    return each.groupBy("k").agg(F.sum("rank_sum").alias("rank_sum"), (F.lit(pairs) - F.sum("less")).alias("n_self"))


def _levels(block: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different values of each column and each row's place among them; kept with the block."""
    if "levels" not in block:
        block["levels"] = [np.unique(v, return_inverse=True) for v in block["vec"].T]
    return block["levels"]


def _sums_by_value(a: dict, b: dict, ax: np.ndarray, by: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(sums of Manhattan distances, pairs of rows of different documents) of the authors ax and by of a tile's rows; None if the pairs take less.

    The sum over two authors' rows of the lesser value is, from each value of a column to the next, the product of how
    many rows of either reach it. So authors are multiplied, not rows. Pairs of one document are taken off.
    """
    na, nb = np.bincount(ax), np.bincount(by)
    columns = list(zip(_levels(a), _levels(b)))
    if len(na) * len(nb) * sum(len(v) + len(w) for (v, _), (w, _) in columns) > CHEAPER * len(ax) * len(by) * len(columns):
        return None
    s, n = np.zeros((len(na), len(nb))), np.outer(na, nb)

    def reach(author, many, place):
        out = np.bincount(author * len(grid) + place, minlength=many * len(grid)).reshape(many, -1)
        return out[:, :0:-1].cumsum(axis=1)[:, ::-1].astype(np.float64)

    for (v, code), (w, code_b) in columns:
        grid = np.union1d(v, w)
        up = np.diff(grid)
        left, right = reach(ax, len(na), np.searchsorted(grid, v)[code]), reach(by, len(nb), np.searchsorted(grid, w)[code_b])
        s += np.outer(left @ up, nb) + np.outer(na, right @ up)
        s -= (left * (2 * up)) @ right.T
    if same:
        at = np.diag_indices(len(na))
        s[at], n[at] = s[at] / 2, na * (na - 1) // 2
        s, n = np.triu(s), np.triu(n)
    p, q = _equal(a["doc"], b["doc"])
    if same:
        p, q = p[p < q], q[p < q]
    for i in range(0, len(p), ROWS_OUT):
        k, m = p[i : i + ROWS_OUT], q[i : i + ROWS_OUT]
        np.subtract.at(s, (ax[k], by[m]), np.abs(a["vec"][k] - b["vec"][m]).sum(axis=1))
        np.subtract.at(n, (ax[k], by[m]), 1)
    return s, n


def author_means(rows: DataFrame | Made, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(author_i, author_j, n_pairs, mean_distance) of every two authors, and each with itself, that have rows of different documents.

    Any metric will do, as the distances themselves are added up, tile by tile; both orders of two authors come out.
    Rows are put together by author (sparse rows should come so), and only authors of several blocks are added up after.
    """
    if not isinstance(rows, Made) and "vec" in rows.columns:
        rows = rows.repartitionByRange(F.xxhash64("author")).sortWithinPartitions(F.xxhash64("author"))
    by_value = metric != "cosine"
    blocks = packed(rows, block or (MEANS_BLOCK if by_value else SPARSE_BLOCK), names=True)
    there, times = np.unique(np.concatenate([np.frombuffer(a, np.int64) for a in blocks.authors] or [np.zeros(0, np.int64)]), return_counts=True)
    several, read = there[times > 1], blocks.reader()

    def add(tiles):
        for i, j in tiles:
            a, b, same = read(i), read(j), i == j
            (x, ax), (y, by) = (np.unique(s["author"], return_inverse=True) for s in (a, b))
            s, n = (_sums_by_value(a, b, ax, by, same) if by_value else None) or (np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), np.int64))
            for d, r, c in _parts_of(a, b, metric, same) if not n.any() else ():
                k, m = _equal(a["doc"][r], b["doc"][c])
                counts = np.ones(d.shape, np.int64) if len(k) or same else None
                if counts is not None:
                    counts[k, m] = 0
                    if same and (upper := _upper(r, c)) is not None:
                        counts *= upper
                    d *= counts
                u, v = ax[r], by[c]
                us, vs = (np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) for w in (u, v))
                cells = np.ix_(u[us], v[vs])
                fold = lambda t: np.add.reduceat(np.add.reduceat(t, us, axis=0), vs, axis=1)  # noqa: B023, E731
                s[cells] += fold(d)
                n[cells] += np.outer(np.diff(np.r_[us, len(u)]), np.diff(np.r_[vs, len(v)])) if counts is None else fold(counts)
            p, q = np.nonzero(n)
            swap, names = x[p] > y[q], pa.concat_arrays([a["name"], b["name"]])
            part = np.isin(x, several)[p] | np.isin(y, several)[q]
            q_ = q + len(x)
            left, right = np.where(swap, q_, p), np.where(swap, p, q_)
            for at in range(0, len(p), ROWS_OUT):
                o = slice(at, at + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(left[o])), names.take(pa.array(right[o])), pa.array(n[p[o], q[o]]), pa.array(s[p[o], q[o]]), pa.array(part[o])], ["x", "y", "n", "s", "part"])

    sums = written(over(blocks.spark, blocks.tiles(), add, "x string, y string, n long, s double, part boolean"), "author-sums")
    cols = ("x", "y", "n", "s")
    both = sums.where("not part").select(*cols)
    if len(several):
        both = both.unionByName(written(sums.where("part").groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "author-means"))
    cell = lambda i, j: both.select(F.col(i).alias("author_i"), F.col(j).alias("author_j"), F.col("n").alias("n_pairs"), (F.col("s") / F.col("n")).alias("mean_distance"))
    return cell("x", "y").unionByName(cell("y", "x").where("author_i <> author_j"))


def cells(rows: DataFrame, value, schema: str, block: int = PART) -> DataFrame:
    """Rows made by value(a, b, same block?) from the two sides of every tile of a small table, such as one row an author."""

    def make(tile: pd.DataFrame) -> pd.DataFrame:
        lo, hi = tile["lo"].iloc[0], tile["hi"].iloc[0]
        return value(tile[tile["b"] == lo], tile[tile["b"] == hi], lo == hi)

    many = max(1, -(-rows.count() // block))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    return own.withColumn("lo", F.least("b", "t")).withColumn("hi", F.greatest("b", "t")).drop("t").groupBy("lo", "hi").applyInPandas(make, schema)


def nearest(rows: DataFrame | Made, queries: DataFrame | Made, metric: str = "cosine", top: int = 10, places: int = 6, block: int | None = None) -> DataFrame:
    """(query, id, d, rank): each query's top nearest rows of other documents, by distance rounded to places, then id.

    Queries and rows are both in blocks; a task takes a block of either and gives the nearest of its rows. So nothing is
    gathered, and a row is sent to as many tasks as there are blocks of queries.
    """
    if isinstance(rows, Made) or "vec" not in rows.columns:
        return _sparse_nearest(rows, queries, top, places, block)
    block, part = _sizes(block)
    cols = ["vec"]
    sides = []
    for side, other, df in ((1, 0, queries), (0, 1, rows)):
        sides.append((written(df.select("id", "doc", *cols), "nearest"), side, other))
    many = [_many(df.count(), block, part) for df, _, _ in sides]
    tiles = None
    for k, (df, side, _) in enumerate(sides):
        own, other = ("qb", "rb") if side else ("rb", "qb")
        placed = df.withColumn("side", F.lit(side)).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(many[k])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many[1 - k] - 1))))
        placed = placed.select("id", "doc", *cols, "side", "qb", "rb")
        tiles = placed if tiles is None else tiles.unionByName(placed)

    def find(tile: pd.DataFrame) -> pd.DataFrame:
        q, r = tile[tile["side"] == 1], tile[tile["side"] == 0].sort_values("id")
        out = [_top(q.iloc[i : i + part], r, metric, top, places, part) for i in range(0, len(q), part)] if len(r) else []
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), "d": np.zeros(0)})

    near = tiles.groupBy("qb", "rb").applyInPandas(find, "query string, id string, d double")
    order = Window.partitionBy("query").orderBy("d", "id")  # top rows a task
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _sparse_nearest(rows: DataFrame | Made, queries: DataFrame | Made, top: int, places: int, block: int | None) -> DataFrame:
    """nearest() of sparse rows: a task has a block of queries, reads the blocks of rows one by one and gives what is nearest of all."""
    blocks = packed(rows, block, ids=True)
    asked = blocks if queries is rows else packed(queries, block, ids=True)
    read, ask, many = blocks.reader(), asked.reader(), len(blocks.names)

    def find(own):
        for i in own:
            q = ask(i)
            found: list[tuple] = []
            for j in range(many):
                r = read(j)
                ids = np.array(r["id"].to_pylist(), dtype=object)
                place = np.empty(len(ids), np.int64)
                place[np.argsort(ids)] = np.arange(len(ids))
                for d, part, _ in _parts_of(q, r, "cosine", False):
                    d = np.round(d, places)
                    d[_equal(q["doc"][part], r["doc"])] = np.inf
                    k = min(top, d.shape[1]) - 1
                    query, at = np.nonzero((d <= np.partition(d, k, axis=1)[:, k, None]) & np.isfinite(d))  # with all ties
                    keep, _ = _first(query, d[query, at], place[at], top)
                    query, at = query[keep], at[keep]
                    found.append((query + part.start, d[query, at], ids[at]))
            query, far, ids = (np.concatenate(x) for x in zip(*found))
            _, name = np.unique(ids, return_inverse=True)
            keep, rank = _first(query, far, name, top)
            yield pa.RecordBatch.from_arrays([q["id"].take(pa.array(query[keep])), pa.array(ids[keep], pa.string()), pa.array(far[keep]), pa.array(rank, pa.int32())], ["query", "id", "d", "rank"])

    groups = dealt([(n, i) for i, n in enumerate(asked.sizes)], blocks.spark)
    return over(blocks.spark, groups, find, "query string, id string, d double, rank int")


def _first(query: np.ndarray, far: np.ndarray, place: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their query by distance and place, and their rank."""
    order = np.lexsort((place, far, query))
    at = query[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
    return order[rank <= top], rank[rank <= top]


def _top(q: pd.DataFrame, rows: pd.DataFrame, metric: str, top: int, places: int, part: int) -> pd.DataFrame:
    """The top nearest of rows, which are in the order of their ids, for each of q."""
    query, place, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for j in range(0, len(rows), part):
        r = rows.iloc[j : j + part]
        d = np.round(_distances(q, r, metric), places)
        d[q["doc"].to_numpy()[:, None] == r["doc"].to_numpy()[None, :]] = np.inf
        limit = np.partition(d, min(top, d.shape[1]) - 1, axis=1)[:, min(top, d.shape[1]) - 1]
        i, k = np.nonzero((d <= limit[:, None]) & np.isfinite(d))  # with all ties at the limit
        query, place, far = np.concatenate([query, i]), np.concatenate([place, k + j]), np.concatenate([far, d[i, k]])
        order = np.lexsort((place, far, query))
        query, place, far = query[order], place[order], far[order]
        begin = np.searchsorted(query, query)
        keep = np.arange(len(query)) - begin < top
        query, place, far = query[keep], place[keep], far[keep]
    ids = [np.asarray(x["id"], dtype=object) for x in (q, rows)]
    return pd.DataFrame({"query": pd.Series(ids[0][query], dtype=object), "id": pd.Series(ids[1][place], dtype=object), "d": far})
