"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Words are runs without ASCII white space. Features are hashed word unigrams and bigrams, the same
n-grams over word shapes (case, digits, marks), and whether a word repeats its predecessor; each
family is normalised by its length, so a score does not depend on how long a text is. Scoring is a
sparse dot product: one gather from the weight vector per n-gram.

Training takes at most ``max_rows`` labelled rows (those with the smallest hash of their id), dealt
to ``shards`` tasks. Every shard runs the sequential updates over its own rows and the weights are
averaged; a shard sends one vector of 2**bits floats, so what the driver gets is bounded.

Edge cases: null or empty text has no n-grams and scores the bias alone; a label that is null or
belongs to no document is not used; several labels of one id count as their largest; with no usable
labels, or labels of one class only, the score is that class's share (0.5 without any); repeated
documents and repeated ids are scored row by row; other columns pass through untouched.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import Cache, crc, raw, trim

BITS, MAX_ROWS, SHARDS, EPOCHS = 18, 24_000, 8, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(w: bytes) -> int:
    s = w.decode("utf-8", "replace")
    case = 3 if len(s) > 1 and s.isupper() else 2 if s[:1].isupper() else 1 if s[:1].isalpha() else 0
    end = s[-1:]
    mark = 0 if end.isalnum() else 1 if end in ",." else 2 if end in "!?" else 3
    doubled = len(s) > 1 and not end.isalnum() and s[-1] == s[-2]
    return case * 64 + mark * 16 + doubled * 8 + any(c.isdigit() for c in s) * 4 + min(len(s) // 8, 3)


def _word(w: bytes) -> int:
    return crc(w) << 10 | _shape(w)


def features(text: bytes, codes: Cache, bits: int):
    """Hashed n-gram positions and their values: (idx, val), unsorted, repeats allowed."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    shape = (h & np.uint64(1023)) + np.uint64(1 << 50)
    pair, shapes = h[:-1] * MIX + h[1:], shape[:-1] * MIX + shape[1:]
    same = (h[1:] == h[:-1]).astype(np.uint64) + np.uint64(1 << 52)
    parts = [h, pair, shape, shapes, same]
    idx = np.concatenate([(p * MIX + np.uint64(k)) * MIX >> np.uint64(64 - bits) for k, p in enumerate(parts)])
    val = np.concatenate([np.full(len(p), s / max(len(p), 1), np.float32) for p, s in zip(parts, (2, 2, 4, 4, 4))])
    return idx.astype(np.int64), val


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows, bits=BITS, epochs=EPOCHS):
    """Weights after ``epochs`` passes over (features, label) rows; the last entry is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    data = []
    for (idx, val), y in rows:
        u, inv = np.unique(idx, return_inverse=True)
        data.append((np.append(u, size - 1), np.append(np.bincount(inv, val, len(u)) if len(u) else [], 1.0), y))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in data:
            w = weight(z[i], n[i])
            g = (_sigmoid(w @ x) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weight(z, n)


def train(docs: DataFrame, labels: DataFrame, max_rows=MAX_ROWS, shards=SHARDS, bits=BITS, id_col="doc_id", text_col="text",
          label_col="quality") -> np.ndarray:
    """Averaged weights from at most ``max_rows`` labelled rows."""
    y = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
         .agg(F.max(label_col).cast("double").alias("_y")).withColumn("_u", F.xxhash64("_id", F.lit(7)) / F.lit(2.0 ** 64) + 0.5))
    total = y.count()
    if total > max_rows:
        y = y.where(F.col("_u") < 1.3 * max_rows / total).orderBy("_u", "_id").limit(max_rows)
    # at most ``max_rows`` labels: sent to the documents, so that only labelled texts are shuffled
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(y), "_id")
            .select("_t", "_y", "_u", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(shards)).alias("_s")))

    def fit(pdf):
        pdf = pdf.sort_values("_u", kind="stable").head(2 * max_rows // shards)
        codes = Cache(_word)
        w = ftrl([(features((t or "").encode(), codes, bits), v) for t, v in zip(pdf["_t"], pdf["_y"])], bits)
        import pandas as pd
        return pd.DataFrame({"n": [float(len(pdf))], "pos": [pdf["_y"].sum()], "w": [w.astype("<f4").tobytes()]})

    got = rows.groupBy("_s").applyInPandas(fit, "n double, pos double, w binary").collect()
    n, pos = sum(r.n for r in got), sum(r.pos for r in got)
    if not n or pos in (0, n):
        w = np.zeros((1 << bits) + 1, np.float32)
        w[-1] = np.log((pos + 1) / (n - pos + 1))
        return w
    return sum(np.frombuffer(r.w, "<f4").astype(float) * r.n for r in got).astype(np.float32) / np.float32(n)


def score(docs: DataFrame, weights: np.ndarray, text_col="text", out="score") -> DataFrame:
    """``docs`` with a column of P(label 1). Needs no shuffle; the weights are a fixed-size broadcast."""
    bits = int(len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def work(batches):
        trim()
        w, codes = shared.value, Cache(_word)
        for b in batches:
            s = np.empty(b.num_rows)
            for k, t in enumerate(raw(b, text_col)):
                idx, val = features(t, codes, bits)
                s[k] = w[idx] @ val + w[-1] if len(idx) else w[-1]
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(b.columns, b.schema) if f.name != out), pa.array(_sigmoid(s))],
                                             [*(f.name for f in b.schema if f.name != out), out])

    kept = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(work, f"{fields}, `{out}` double")
