"""Problem 7: same or near-same records across splits, by word n-gram hashes and containment.

The n-gram hashes of the evaluation records are partitioned by hash; training records are scanned for hits (see
passages.py for the two fixed-size tables that rule out most of their n-grams). For each pair of texts with a hit,
the containment of five-word shingles is computed on the whole texts, and pairs that reach what a tenth of changed
words leaves of them are settled by their word edit distance.

The n-grams are of 7 words, chained five-word shingles, every other one (see passages.py): a tenth of changed words
leaves a run of 8 words, and so a pattern, in any text of 40 words. From 160 words on, one of a text's stretches of 40
words has at most 4 of the changes, so that the words around a hit rule out most others; below, every hit is followed. A hit must stand at the same place, give or
take the edits, in texts of like lengths. Texts under 45 words use single five-word shingles from nine words on, as ten
words may lack one. One hash of all its words stands for each text, so that texts of the same words always meet.
Texts that are equal byte for byte are one class; classes are compared and then named by their records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import passages
from inkstone.llm._align import distance, shared_shingles
from inkstone.plans.lineage import written

SHINGLE = passages.SHINGLE
CHANGED = 0.1
#: Words from which the surroundings of a hit decide; 160, and a tenth more for the longer text of a pair.
LONG = 180


def _compare(batches, changed: float):
    q_texts, c_texts = passages.Texts(), passages.Texts()
    for batch in batches:
        good, contained, edits = [], [], []
        for q, c, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            a, b = q_texts.of(q, x), c_texts.of(c, y)
            most = int(changed * max(len(a), len(b)))
            total = max(1, len(a) - SHINGLE + 1)
            shared = shared_shingles(a, b, SHINGLE)
            d = distance(a, b, most) if abs(len(a) - len(b)) <= most and shared >= len(a) - SHINGLE + 1 - SHINGLE * most else None
            good.append(d is not None)
            contained.append(shared / total)
            edits.append(d or 0)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), pa.array(contained, pa.float64()), pa.array(edits, pa.int32()))], ["q", "c", "containment", "edits"])


def overlaps(evaluation: DataFrame, training: DataFrame, key: str = "article_id", text: str = "text") -> DataFrame:
    """(eval_key, train_key, containment, edits) of records that are the same or differ in at most a tenth of their words.

    Words are compared without case, punctuation, accents and markup; edits are counted against the longer text.
    Texts without words and rows with a null key or text overlap nothing; repeated rows count once.
    """
    q, c = passages.texts(evaluation, key, text), passages.texts(training, key, text)
    one, stored = written(passages.unique(q), "p7-evaluation"), passages.unique(c)
    most = f"{CHANGED} * greatest(q_n, c_n)"
    alike = f"abs(q_n - c_n) <= {most} and (q_pos < 0 or c_pos < 0 or abs(q_pos - c_pos) <= {most})"  # an edit moves what follows by one word
    pairs = written(passages.candidates(one, stored, LONG, short=True).where(alike).select("q", "c").distinct(), "p7-pairs")
    both = passages.paired(pairs, one, stored).select("q", "c", "q_text", "c_text")
    found = written(both.mapInArrow(lambda it: _compare(it, CHANGED), "q long, c long, containment double, edits int"), "p7-found")
    return passages.keys_of(passages.keys_of(found, "q", q, "eval_key"), "c", c, "train_key").select("eval_key", "train_key", "containment", "edits").distinct()
