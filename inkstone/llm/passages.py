"""Common ground of problems 6 and 7: places where a stored text may hold a passage of a query text.

A passage of 40 words with at most 4 changed words keeps a run of 8 words (36 kept words in 5 runs). Of its two runs
of 7 words the one of lesser hash is taken, in all texts alike. These are the patterns of a Wu-Manber search. Stored
texts are scanned by cursors that stand side by side: at each place the shift of a window's last block of words tells
how far the next window may be, and only windows of shift 0 are looked at. Those are tested by their hash in an
occupancy table, and what is left is matched to the patterns in a join by hash, which is the bucket of the method.

Longer passages may have a tenth of their words changed. One that holds no shorter
passage within its own limit has 50 words and 5 changes, 60 and 6, or 70 and 7: with fewer changes, or a length
between, its last word could go, and from 80 words on its first 40 have over 4 changes, so that the rest is within the
limit. All sets of so many changed words were tried: each leaves two patterns in a row in one kept run, both with at
most 4 changes in the 16 words on one side, so what is said here of 40 words holds for these.

The tables have a fixed size whatever the data, so they may be broadcast, and the driver gets them as bits; when they
fill up, they only rule out less.

Around every place stand two 64-bit sets of the 16 words before and after it. A passage reaches 16 words beyond its
kept run on at least one side (12 in the stored text, if words are missing there), and 4 changes take at most 4 bits
from either set, so other places are dropped inside the join, before any row is made of them.

A run that very many query texts have (boilerplate) would pair all of them with all stored texts that have it. The
occupancy table counts the runs; those of crowded entries are not matched by themselves, but together with each
triple of words in the 20 words before or after: of the 16 words of a passage on one side, at most 4 are changed, so 3
in a row are kept. Both sides do the same, so no passage is lost, and copies of the run in other surroundings part.

A run that one text has more than REPEATS times comes as a single row without a place, so that two repetitive texts
don't pair their places; such pairs are searched whole when they are confirmed.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import _words as W
from inkstone.plans.lineage import written

#: Words of a pattern, and consecutive patterns of which the least is taken.
PATTERN, LEAST_OF = 7, 2
CONTEXT = 16
LOST_BITS = 4
SHIFT_BLOCK = 3
#: Entries of the occupancy table (two bits each for the tasks) and of the shift table (a byte each): 16 MB and 1 MB.
HASH_BITS, SHIFT_BITS = 26, 20
#: Parts, by slot, in which the tables are added up.
PARTS_BITS = 6
#: An entry is crowded from CROWD runs more than CROWD_TIMES the mean.
CROWD, CROWD_TIMES = 256, 8
TRIPLE, REACH = 3, CONTEXT + LOST_BITS
#: Places of one run in one text from which they come as one row, at ANYWHERE.
REPEATS, ANYWHERE = 8, -1
#: Windows between the cursors of a scan.
STRIDE = 512
#: Shingles of short texts, and the least and most words of these; see cross_split.
SHINGLE, SHORT_FROM, SHORT_TO = 5, 9, 45
#: Pairs up to which the ids of their texts may be sent to every task; more are joined.
MOST_IDS = 1_000_000
#: Texts whose words a worker remembers.
CACHE_TEXTS = 512

_CACHE = W.PlainHashes()
SEED = "g long, id long, pos int, n int, before long, after long"


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _patterns(hashes, room):
    """Hashes of the words from each position, and the positions of those taken as patterns."""
    gram = W.grams(hashes, PATTERN)
    return gram, W.winnow(gram, room[: len(gram)] >= PATTERN, LEAST_OF)


def _whole(hashes, ends):
    """One hash for all words of each row that has any: (hashes, rows)."""
    lengths = np.diff(ends, prepend=0)
    row = np.flatnonzero(lengths)
    begin = (ends - lengths)[row]
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(begin, lengths[row]).astype(np.uint64)
    mixed = W.mix(hashes ^ W.mix(place + np.uint64(1)))
    return (W.mix(np.add.reduceat(mixed, begin) + lengths[row].astype(np.uint64)) if len(row) else mixed[:0]), row


def _short(hashes, ends):
    """Hashes of short rows' shingles, and their rows."""
    gram = W.grams(hashes, SHINGLE)
    row, _ = W.rows_of(ends)
    n = np.diff(ends, prepend=0)
    ok = W.room(ends, len(hashes))[: len(gram)] >= SHINGLE
    ok &= (n[row[: len(gram)]] >= SHORT_FROM) & (n[row[: len(gram)]] < SHORT_TO)
    at = np.flatnonzero(ok)
    return W.mix(gram[at] + np.uint64(SHINGLE)), row[at]


def _table_rows(batches, short: bool):
    """(kind, part, slots, n), packed: kind 0 the number of patterns in entries of the occupancy table, kind 1 the least shift of blocks."""
    for batch in batches:
        for _, ends, hashes in W.blocks(batch.column(1), True, _CACHE):
            gram, at = _patterns(hashes, W.room(ends, len(hashes)))
            keys = [gram[at], *((_whole(hashes, ends)[0], _short(hashes, ends)[0]) if short else ())]
            slot, n = np.unique(_slots(np.concatenate(keys), HASH_BITS), return_counts=True)
            yield _table_batch(0, slot, n, HASH_BITS)
            block, most = W.grams(hashes, SHIFT_BLOCK), PATTERN - SHIFT_BLOCK
            slots = np.concatenate([_slots(block[at + d], SHIFT_BITS) for d in range(most + 1)])
            shift = np.repeat(np.arange(most, -1, -1), len(at))
            order = np.lexsort((shift, slots))
            new = np.flatnonzero(np.diff(slots[order], prepend=-1))
            yield _table_batch(1, slots[order][new], shift[order][new], SHIFT_BITS)


def _table_batch(kind, slot, n, bits):
    """A row for each part that has slots; they are in order."""
    edge = np.searchsorted(slot, np.arange((1 << PARTS_BITS) + 1) << (bits - PARTS_BITS))
    part = np.flatnonzero(np.diff(edge))
    packed = lambda x: pa.array([x[edge[p] : edge[p + 1]].astype(np.int32).tobytes() for p in part], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.astype(np.int32)), packed(slot & ((1 << bits - PARTS_BITS) - 1)), packed(n)], ["kind", "part", "slots", "n"])


def _add_up(batches, crowd: int, times: int):
    """(kind, part, bits, crowded) of the parts in a task: packed bits, or a byte for each shift."""
    counts, shifts = {}, {}
    for batch in batches:
        for kind, part, slots, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            slot, n = np.frombuffer(slots, np.int32), np.frombuffer(n, np.int32)  # a slot stands in a row once
            if kind:
                table = shifts.setdefault(part, np.full(1 << SHIFT_BITS - PARTS_BITS, PATTERN - SHIFT_BLOCK + 1, np.uint8))
                table[slot] = np.minimum(table[slot], n)
            else:
                if part not in counts:
                    counts[part] = np.zeros(1 << HASH_BITS - PARTS_BITS, np.int64)
                counts[part][slot] += n
    for p, c in counts.items():
        bits = [np.packbits(x).tobytes() for x in (c > 0, c > crowd + times * c.mean())]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([p], pa.int32()), *(pa.array([b]) for b in bits)], ["kind", "part", "bits", "crowded"])
    for p, s in shifts.items():
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([p], pa.int32()), pa.array([s.tobytes()]), pa.array([b""])], ["kind", "part", "bits", "crowded"])


class Tables:
    """The fixed-size tables of a set of query texts: occupied and crowded entries, and the shifts of blocks."""

    def __init__(self, queries: DataFrame, short: bool = False):
        rows = queries.select("id", "text").where("text is not null").mapInArrow(lambda it: _table_rows(it, short), "kind byte, part int, slots binary, n binary")
        crowd, times = CROWD, CROWD_TIMES
        parts = rows.repartition(1 << PARTS_BITS, "part").mapInArrow(lambda it: _add_up(it, crowd, times), "kind byte, part int, bits binary, crowded binary").toArrow()  # the tables' own size
        size = (1 << HASH_BITS - PARTS_BITS) >> 3
        self.held, self.crowded = (np.zeros(size << PARTS_BITS, np.uint8) for _ in range(2))
        self.shift = np.full(1 << SHIFT_BITS, PATTERN - SHIFT_BLOCK + 1, np.uint8)
        for kind, part, bits, crowded in zip(*(parts.column(i).to_pylist() for i in range(4))):
            if kind:
                step = 1 << SHIFT_BITS - PARTS_BITS
                self.shift[part * step : (part + 1) * step] = np.frombuffer(bits, np.uint8)
            else:
                self.held[part * size : (part + 1) * size] = np.frombuffer(bits, np.uint8)
                self.crowded[part * size : (part + 1) * size] = np.frombuffer(crowded, np.uint8)

    @staticmethod
    def _in(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
        slot = _slots(gram, HASH_BITS)
        return table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1

    def occupied(self, gram: np.ndarray) -> np.ndarray:
        return self._in(self.held, gram)

    def is_crowded(self, gram: np.ndarray) -> np.ndarray:
        return self._in(self.crowded, gram)

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        """Starts of windows that the scan stops at, in order: those whose last block has shift 0. The others are passed over or skipped."""
        last = W.grams(hashes, SHIFT_BLOCK)[PATTERN - SHIFT_BLOCK :]
        at = np.arange(0, len(last), STRIDE)
        stop, found = np.minimum(at + STRIDE, len(last)), []
        while len(at):
            shift = self.shift[_slots(last[at], SHIFT_BITS)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matching(self, hashes: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the patterns at `at` that the scan stops at and that are occupied."""
        seen = np.zeros(len(gram) + 1, bool)
        seen[self.windows(hashes)] = True
        at = at[seen[at]]
        return at[self.occupied(gram[at])]


def _neighbourhood(hashes, row):
    """Bit sets of the CONTEXT words before and from each position, within the row."""
    bit = np.uint64(1) << (hashes >> np.uint64(58))
    before, after = np.zeros(len(bit), np.uint64), np.zeros(len(bit), np.uint64)
    for d in range(1, min(CONTEXT + 1, len(row))):
        same = row[d:] == row[:-d]
        before[d:] |= np.where(same, bit[:-d], np.uint64(0))
    for d in range(min(CONTEXT, len(row))):
        same = row[d:] == row[: len(row) - d]
        after[: len(row) - d] |= np.where(same, bit[d:], np.uint64(0))
    return before, after


def _once_a_text(g, row, pos):
    """Which seeds stay, and their places: a run with more than REPEATS places in a row stays once, at ANYWHERE."""
    key = W.mix(g ^ W.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    if len(k) <= REPEATS or not (k[REPEATS:] == k[:-REPEATS]).any():
        return np.ones(len(g), bool), pos
    group = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
    many = (np.bincount(group) > REPEATS)[group]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    stay, at = np.ones(len(g), bool), pos.copy()
    at[order[many]] = ANYWHERE
    stay[order[many & ~first]] = False
    return stay, at


def _seed_rows(batches, tables, select: bool, plain: int, short: bool):
    held = tables.value
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, ends, hashes in W.blocks(batch.column(1), True, _CACHE):
            if not len(hashes):
                continue
            row, pos = W.rows_of(ends)
            length = np.diff(ends, prepend=0)
            parts = []  # g, row, pos, before, after
            if short:
                for g, of in (_whole(hashes, ends), _short(hashes, ends)):
                    keep = held.occupied(g) if select else np.ones(len(g), bool)
                    none = np.zeros(keep.sum(), np.uint64)
                    parts.append((g[keep], of[keep], np.full(len(none), ANYWHERE), none, none))
            gram, at = _patterns(hashes, W.room(ends, len(hashes)))
            if select and len(at):
                at = held.matching(hashes, gram, at)
            if len(at):
                before, after = _neighbourhood(hashes, row)
                beyond = np.minimum(at + PATTERN, len(hashes) - 1)
                right = np.where((at + PATTERN < len(hashes)) & (row[beyond] == row[at]), after[beyond], np.uint64(0))
                n, crowded = length[row[at]], held.is_crowded(gram[at])
                seed = lambda k, g: parts.append((g, row[at[k]], pos[at[k]], before[at[k]], right[k]))
                alone = np.flatnonzero(~crowded | (n < plain))
                seed(alone, gram[at[alone]])
                far = np.flatnonzero(crowded & (n >= plain * 8 // 9))
                if len(far):
                    triple = W.grams(hashes, TRIPLE)
                    for side, starts in ((1, range(PATTERN, PATTERN + REACH - TRIPLE + 1)), (2, range(-REACH, -TRIPLE + 1))):
                        for d in starts:
                            b = at[far] + d
                            inside = (b >= 0) & (b + TRIPLE <= len(hashes))
                            k, b = far[inside], b[inside]
                            same = (row[b] == row[at[k]]) & (row[b + TRIPLE - 1] == row[at[k]])
                            k, b = k[same], b[same]
                            seed(k, W.mix(gram[at[k]] + np.uint64(side) * triple[b]))
            if not parts:
                continue
            g, of, place, b, a = (np.concatenate(x) for x in zip(*parts))
            stay, place = _once_a_text(g, of, place)
            g, of, place, b, a = g[stay], of[stay], place[stay], b[stay], a[stay]
            cols = [g.view(np.int64), ids[of + first], place.astype(np.int32), length[of].astype(np.int32), b.view(np.int64), a.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "id", "pos", "n", "before", "after"])


def seeds(docs: DataFrame, tables, select: bool, plain: int = 0, short: bool = False) -> DataFrame:
    """Rows SEED of all patterns of docs (id, text), or, on select, of those that the broadcast tables let through.

    plain: texts of fewer words give crowded runs by themselves too; those of fewer than 8/9 of it only so. short: give
    a hash of the whole text, and the shingles of short texts, too.
    """
    return docs.select("id", "text").where("text is not null").mapInArrow(lambda it: _seed_rows(it, tables, select, plain, short), SEED)


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, key, text) of rows with a key and a text; equal texts have equal ids (of 64 bits)."""
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(text).alias("id"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))


def unique(docs: DataFrame) -> DataFrame:
    """(id, text) of docs, each id once. Only texts that stand in several rows are moved, if their ids may go to every task."""
    rows = docs.select("id", "text")
    again = written(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if again.count() > MOST_IDS:
        return rows.dropDuplicates(["id"])
    ids = F.broadcast(again)
    return rows.join(ids, "id", "left_anti").unionByName(rows.join(ids, "id", "left_semi").dropDuplicates(["id"]))


def candidates(queries: DataFrame, stored: DataFrame, plain: int = 0, short: bool = False) -> DataFrame:
    """Places (q, c, q_pos, c_pos, q_n, c_n) at which a stored text may hold 40 words of a query text.

    queries, stored: id and text, each id once (see unique); so a run that very many stored texts have is a plain side
    of the join, which may be split. plain: for two texts of fewer words a common pattern is enough, whatever stands
    around it.
    """
    tables = queries.sparkSession.sparkContext.broadcast(Tables(queries, short))  # of a fixed size
    side = lambda df, x: df.select("g", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "pos", "n", "before", "after")))
    a = side(seeds(queries, tables, False, plain, short), "q")
    b = side(seeds(stored, tables, True, plain, short), "c")
    like = lambda s: f"bit_count(q_{s} & ~c_{s}) <= {LOST_BITS} and bit_count(c_{s} & ~q_{s}) <= {LOST_BITS}"
    left = f"q_pos >= {CONTEXT} and c_pos >= {CONTEXT - LOST_BITS} and {like('before')}"
    right = f"q_n - q_pos >= {PATTERN + CONTEXT} and c_n - c_pos >= {PATTERN + CONTEXT - LOST_BITS} and {like('after')}"
    kept = f"({left}) or ({right}) or q_pos < 0 or c_pos < 0 or greatest(q_n, c_n) < {plain}"
    return a.join(b, "g").where(kept).select(F.col("q_id").alias("q"), F.col("c_id").alias("c"), "q_pos", "c_pos", "q_n", "c_n")


def paired(pairs: DataFrame, queries: DataFrame, stored: DataFrame) -> DataFrame:
    """pairs, a written table of q, c and more, with q_text and c_text; queries, stored: id and text, each id once.

    The ids of up to MOST_IDS pairs go to the tasks that read the stored texts, so that only texts in pairs are moved.
    """
    ids = pairs.select(F.col("c").alias("id")).distinct()
    wanted = stored.join(F.broadcast(ids) if pairs.count() <= MOST_IDS else ids, "id", "left_semi")
    one = lambda df, x: df.select(F.col("id").alias(x), F.col("text").alias(f"{x}_text"))
    return pairs.join(one(queries, "q"), "q").join(one(wanted, "c"), "c")


def keys_of(found: DataFrame, side: str, docs: DataFrame, name: str) -> DataFrame:
    """found with the keys of its texts: a row for each record that has the text. docs: id, key."""
    return found.join(docs.select(F.col("id").alias(side), F.col("key").alias(name)).distinct(), side)


class Texts(OrderedDict):
    """id -> word hashes of the texts met last; a text in many pairs is split once."""

    def of(self, key: int, cell) -> list[int]:
        if (got := self.get(key)) is None:
            got = [h for w in W.plain_words(cell.as_py()) if (h := _CACHE[w])]
            self[key] = got
            if len(self) > CACHE_TEXTS:
                self.popitem(last=False)
        else:
            self.move_to_end(key)
        return got
