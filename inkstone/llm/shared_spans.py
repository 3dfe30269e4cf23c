"""Problem 1: long exact spans shared between records, by a relative Lempel-Ziv parse.

Every record is at once a reference and a text to be parsed. The reference index holds blocks of BLOCK words at
content-defined places (the least block hash of each MIN_WORDS - BLOCK + 1 consecutive ones), so any stretch of
MIN_WORDS shared words holds an indexed block in all records that have it, wherever it stands. Only around blocks
that another record has too are the phrases of MIN_WORDS words looked up; the index gives each phrase two places, in
the first and the last record that hold it, so every record finds at least one in another record.

A record's parse is greedy: from a phrase that has a place, a factor follows that place word by word, in the reference
as in the record, for as long as the phrases go on there, and of the two places the one that goes on longer is taken.
So a factor is a stretch of the record that its reference holds whole, at ref_word. At a factor's end the parse goes on
with the next phrase, which reaches back over the boundary; so no shared word is missed there. Factors that touch or
overlap are joined at their boundaries into maximal duplicate spans.

Hot blocks and phrases (one passage in a third of all records) are reduced map-side to two places each; no group is
gathered and no pairs of records are made. A phrase is known by 96 bits of hashes, a record by 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm import _words as W
from inkstone.plans.lineage import written

MIN_WORDS = 50
BLOCK = 25

_CACHE = W.ExactHashes()


def _block_rows(batches, block: int, least: int):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, ends, hashes in W.blocks(batch.column(1), False, _CACHE):
            gram = W.grams(hashes, block)
            at = W.winnow(gram, W.room(ends, len(hashes))[: len(gram)] >= block, least - block + 1)
            if len(at):
                row, pos = W.rows_of(ends)
                yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(ids[row[at] + first]), pa.array(pos[at].astype(np.int32))], ["block", "rec", "pos"])


def _phrase_rows(batches, block: int, least: int):
    for batch in batches:
        ids, held = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        edges = held.offsets.to_numpy()
        places = held.values.to_numpy(zero_copy_only=False)
        for first, ends, hashes in W.blocks(batch.column(1), False, _CACHE):
            gram = W.grams(hashes, least)
            if not len(gram):
                continue
            begins = np.concatenate([[0], ends[:-1]])
            counts = np.diff(edges[first : first + len(ends) + 1])
            at = places[edges[first] : edges[first + len(ends)]] + np.repeat(begins, counts)
            # starts from at - (least - block) to at, as the difference of two counts
            change = np.zeros(len(hashes) + 2, np.int64)
            np.add.at(change, np.maximum(at - (least - block), np.repeat(begins, counts)), 1)
            np.add.at(change, at + 1, -1)
            wanted = np.cumsum(change)[: len(gram)] > 0
            starts = np.flatnonzero(wanted & (W.room(ends, len(hashes))[: len(gram)] >= least))
            row, pos = W.rows_of(ends)
            check = (W.grams(W.mix(hashes), least)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(gram[starts].view(np.int64)), pa.array(check), pa.array(ids[row[starts] + first]), pa.array(pos[starts].astype(np.int32))], ["phrase", "check", "rec", "start"])


def parse(starts: np.ndarray, refs: np.ndarray, places: np.ndarray, owner: np.ndarray, least: int) -> list[np.ndarray]:
    """Owner, first word, words, ref and ref word of the greedy factors of one or more records.

    starts: of the phrases that have a place, ascending within each owner; refs and places: two columns, the second of
    which may repeat the first. A phrase goes on at a place if the next one stands one word on in both texts.
    """
    n, text = len(starts), np.tile(owner, 2)
    start, ref, shift = np.tile(starts, 2), refs.T.ravel(), (places - starts[:, None]).T.ravel()
    order = np.lexsort((start, shift, ref, text))
    same = [x[order][1:] == x[order][:-1] for x in (text, ref, shift)]
    cut = ~(same[0] & same[1] & same[2] & (np.diff(start[order]) <= 1))
    run, last = np.concatenate([[0], np.cumsum(cut)]), np.append(np.flatnonzero(cut), 2 * n - 1)
    end = np.empty(2 * n, np.int64)  # the start of the last phrase of the run that each place belongs to
    end[order] = start[order][last[run]]
    first, second = end.reshape(2, n)
    which, far = (second > first).astype(np.int64), np.maximum(first, second)
    after = np.searchsorted(owner * (1 << 33) + starts, owner * (1 << 33) + far, "right").tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = after[i]
    at = np.array(at)
    return [x[at] for x in (owner, starts, far - starts + least, refs[np.arange(n), which], places[np.arange(n), which])]


def _factor_rows(batches, least: int):
    """Rows (rec, phrases): all phrases of a record, of at most its length."""
    for batch in batches:
        cell = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(cell.offsets.to_numpy()))
        start, lo, lo_at, hi, hi_at = (x.to_numpy(zero_copy_only=False) for x in cell.flatten().flatten())
        order = np.lexsort((start, owner))
        pair = lambda x, y: np.stack([x[order], y[order]], axis=1)
        if len(order):
            of, *rest = parse(start[order].astype(np.int64), pair(lo, hi), pair(lo_at, hi_at), owner[order], least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(x.astype(np.int64)) for x in rest)], ["rec", "first_word", "n_words", "ref", "ref_word"])


def factors(records: DataFrame, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """Greedy factors of at least min_words words: (rec_table, rec_key, first_word, n_words, ref_table, ref_key, ref_word).

    records: rec_table, rec_key, text; further columns are ignored. Words are maximal runs of characters other than
    space, tab, CR and LF. Rows of one key are one record, if their texts are the same. A null key or text has no
    factors, an empty table none. The n_words from first_word on stand in the reference record from ref_word on.
    """
    records = records.where(F.col("rec_key").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("rec_table", "rec_key").alias("rec"), "rec_table", "rec_key", "text")
    texts = records.select("rec", "text")
    index = written(texts.mapInArrow(lambda it: _block_rows(it, block, min_words), "block long, rec long, pos int"), "p1-blocks")
    shared = index.groupBy("block").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("block")
    held = index.join(shared, "block", "left_semi").groupBy("rec").agg(F.collect_list("pos").alias("held"))  # at most a record's length
    phrases = written(texts.join(held, "rec").select("rec", "text", "held").mapInArrow(lambda it: _phrase_rows(it, block, min_words), "phrase long, check int, rec long, start int"), "p1-phrases")
    place = F.struct("rec", "start")
    known = phrases.groupBy("phrase", "check").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.rec <> hi.rec")
    lo, hi = (F.when(F.col("rec") == F.col(f"{a}.rec"), F.col(b)).otherwise(F.col(a)) for a, b in (("lo", "hi"), ("hi", "lo")))
    found = phrases.join(known, ["phrase", "check"]).select("rec", F.struct("start", lo.rec.alias("lo"), lo.start.alias("lo_at"), hi.rec.alias("hi"), hi.start.alias("hi_at")).alias("p"))
    each = found.groupBy("rec").agg(F.collect_set("p").alias("phrases"))  # at most a record's length
    made = each.mapInArrow(lambda it: _factor_rows(it, min_words), "rec long, first_word long, n_words long, ref long, ref_word long")
    return _named(written(made, "p1-factors"), records)


def _named(factor: DataFrame, records: DataFrame) -> DataFrame:
    name = records.select("rec", "rec_table", "rec_key").distinct()
    ref = name.select(F.col("rec").alias("ref"), F.col("rec_table").alias("ref_table"), F.col("rec_key").alias("ref_key"))
    return factor.join(name, "rec").join(ref, "ref").select("rec_table", "rec_key", "first_word", "n_words", "ref_table", "ref_key", "ref_word")


def spans(factor: DataFrame) -> DataFrame:
    """Maximal runs of shared words of each record: factors that touch or overlap, joined."""
    order = Window.partitionBy("rec_table", "rec_key").orderBy("first_word", "n_words")
    reach = F.max(F.col("first_word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first_word") > reach, F.lit(True))
    runs = factor.withColumn("run", F.sum(new.cast("int")).over(order))
    ends = F.max(F.col("first_word") + F.col("n_words"))
    return runs.groupBy("rec_table", "rec_key", "run").agg(F.min("first_word").alias("first_word"), (ends - F.min("first_word")).alias("n_words")).drop("run")


def shared_amount(span: DataFrame, records: DataFrame) -> DataFrame:
    """Each record with its words, the words that stand elsewhere too, and their share; a record without words has share 0."""
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.expr(r"filter(split(text, '[ \t\r\n]+'), w -> w <> '')")))
    words = records.where(F.col("rec_key").isNotNull()).groupBy("rec_table", "rec_key").agg(F.max(count).cast("long").alias("words"))
    total = span.groupBy("rec_table", "rec_key").agg(F.sum("n_words").alias("n"))
    both = words.join(total, ["rec_table", "rec_key"], "left").withColumn("shared_words", F.coalesce("n", F.lit(0)).cast("long"))
    return both.select("rec_table", "rec_key", "words", "shared_words", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).otherwise(F.lit(0.0)).alias("share"))
