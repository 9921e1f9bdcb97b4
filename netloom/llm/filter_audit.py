"""Filter interaction audit by wide packed counters.

Every document has a mask: one bit for each filter that it fails. A mask decides what happens to the
document at each step of each filter order, so it stands for one big integer whose 64-bit fields
hold the outcomes of all steps: kept, removed, redundant and sole failure, 4 x 600 fields for five
filters. The integers of a part's documents are added up and the sum is unpacked into the counters.
A field never carries into the next one, as no part holds 2**64 documents.

Equal masks are counted before anything is shuffled, and an integer is added as often as its mask
occurs: a part is at most 128 rows in one task, however many documents it has.

Edge cases: a null text is empty and has no words; a null language is the part ''; of equal texts
all but those with the least id fail E, null ids counting as the largest, so repeated rows of one id
do not fail for each other; labels may repeat (any 1 counts) or be missing; an empty table gives no
rows. Extra columns, whatever their names, are not read.
"""

from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import raw
from netloom.session import cut

FILTERS = "ABCDE"
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): the filters that each text fails by itself, A to D."""
    def work(batches):
        for b in batches:
            mask, digest = [], []
            sizes = pc.utf8_length(b.column("text")).fill_null(0).to_pylist()
            for t, size in zip(raw(b, "text"), sizes):
                words = t.split()
                n = len(words)
                mask.append((n < 100) | (100 * len(set(words)) < 80 * n) << 1
                            | (100 * (len(t) - len(t.translate(None, UPPER))) > 10 * size) << 2
                            | (len(t.translate(None, SYMBOLS)) < len(t)) << 3)
                digest.append(sha256(t).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())],
                                             ["doc_id", "part", "mask", "digest"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and by their labels.

    A text's first holder is looked up by digest and id together, so a text that a third of all
    documents share is no hot key.
    """
    rows = cut(measured(docs), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of")
    rows = rows.join(first, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("of").isNull(), 16).otherwise(0)).alias("mask")).join(marked, "doc_id", "left")
    return rows.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


class Counters:
    """Packed outcomes of all steps of all orders of ``k`` filters."""

    def __init__(self, k: int):
        self.orders = list(permutations(range(k)))
        self.filter = np.array(self.orders).ravel()
        bits = 1 << np.array(self.orders)
        self.bit, self.before = bits.ravel(), (np.cumsum(bits, axis=1) - bits).ravel()
        self.packed = [self._pack(m) for m in range(1 << k)]

    def _pack(self, mask: int) -> int:
        fails, gone = (mask & self.bit) != 0, (mask & self.before) != 0
        fields = np.concatenate([~fails & ~gone, fails & ~gone, fails & gone, mask == self.bit])
        return int.from_bytes(fields.astype("<u8").tobytes(), "little")

    def unpack(self, total: int) -> dict:
        """Outcome -> counts of all steps, as Python integers: their sum over all orders may pass 64 bits."""
        fields = np.frombuffer(total.to_bytes(len(OUTCOMES) * len(self.bit) * 8, "little"), "<u8").astype(object)
        return dict(zip(OUTCOMES, fields.reshape(len(OUTCOMES), -1)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters of each (part, filter_order, step), zeros included."""
    k = len(FILTERS)

    def work(pdf):
        c = Counters(k)
        sums = {"all": 0, "good": 0, "toxic": 0}
        for mask, good, toxic, n in zip(pdf["mask"], pdf["good"], pdf["toxic"], pdf["n"]):
            x = c.packed[mask] * int(n)
            sums["all"] += x
            sums["good"] += x if good else 0
            sums["toxic"] += x if toxic else 0
        got = c.unpack(sums["all"])
        shapley = np.array([got["removed"][c.filter == f].sum() for f in range(k)])
        return pd.DataFrame({
            "part": pdf["part"].iloc[0], "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in c.orders], k),
            "step": np.tile(np.arange(1, k + 1), len(c.orders)), **got, "good_lost": c.unpack(sums["good"])["removed"],
            "toxic_lost": c.unpack(sums["toxic"])["removed"], "shapley": shapley[c.filter]})

    return masks(docs, labels).groupBy("part").applyInPandas(
        work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
