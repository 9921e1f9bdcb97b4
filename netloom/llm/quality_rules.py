"""Quality rules with risk-controlled cutoffs.

Every rule has a cutoff that tightens with one strictness level 0..LEVELS. A document's level is the
lowest one at which some rule rejects it. Labelled good documents of a stratum (language) show how
many would be lost at each level; levels are tested from lenient to strict, each with the exact
binomial tail P(Bin(n, risk) <= lost), and the walk stops at the first level whose tail exceeds
delta / strata. Testing in a fixed order needs no further correction within a stratum, and dividing
by the number of strata (Bonferroni) makes the statement hold for all of them at once: with
probability 1 - delta no stratum loses more than ``risk`` of its good documents. A stratum with too
few labels certifies no level and loses nothing.

Edge cases: null or empty text has no words and fails the base rule; null language is a stratum of
its own; labels that are null or unmatched are not used; repeated rows are judged one by one; an
empty table gives an empty result; other columns pass through.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import raw, trim
from netloom.session import cut

LEVELS, RISK, DELTA, MAX_BROADCAST = 24, 0.01, 0.05, 100_000
#: rule -> (cutoff at level 0, cutoff at the last level); a document whose value exceeds it is rejected
RULES = {"symbols_per_word": (2.0, 0.05), "dup_line_share": (0.95, 0.15), "repeat_share": (0.9, 0.1),
         "upper_share": (0.95, 0.2), "marks_per_word": (1.5, 0.1)}
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, level int"


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = a[:-1] * v + a[1:]
    if v >= 1 << 20:  # three codes would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, inv, count = np.unique(pair[:-1] * v + a[2:], return_inverse=True, return_counts=True)
    twice, hit = count[inv] >= 2, np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, strictness level that rejects it)."""
    words = text.split()
    n = len(words)
    in_words = sum(map(len, words))
    chars = len(text.decode("utf-8", "replace"))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        seen = set()
        for x in lines:
            if x in seen:
                dup += bool(x.strip())
            else:
                seen.add(x)
    rep = repeat_words(words)
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    lower = len(text) - len(text.translate(None, bytes(range(97, 123))))
    value = {"symbols_per_word": symbols / max(n, 1), "dup_line_share": dup / max(len(lines), 1), "repeat_share": rep / max(n, 1),
             "upper_share": upper / max(upper + lower, 1), "marks_per_word": (text.count(b"!") + text.count(b"?")) / max(n, 1)}
    level = LEVELS + 1
    for name, (hi, lo) in RULES.items():
        x = value[name]
        if x > lo:  # cutoff(level) = hi * (lo / hi) ** (level / LEVELS)
            level = min(level, 0 if x > hi else math.floor(LEVELS * math.log(hi / x) / math.log(hi / lo)) + 1)
    return n, chars - (len(text) - in_words), symbols, dup, rep, level


def measured(docs: DataFrame, text_col="text", keep_text=False) -> DataFrame:
    """``docs``, with or without its text, and the metrics of each whole text. One narrow pass."""
    names = [m.split()[0] for m in METRICS.split(", ")]
    keep = [c for c in docs.columns if c not in names and (keep_text or c != text_col)]

    def work(batches):
        trim()
        for b in batches:
            got = [measure(t) for t in raw(b, text_col)]
            cols = [pa.array(x, pa.int64()) for x in zip(*got)] if got else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols[:5], cols[5].cast(pa.int32())], [*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(work, ", ".join([*fields, METRICS]))


def binomial_tail(lost: int, n: int, risk: float) -> float:
    """P(Bin(n, risk) <= lost), summed from exact log terms."""
    if n == 0:
        return 1.0
    k = np.arange(min(lost, n) + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    t = math.lgamma(n + 1) - lg(k + 1.0) - lg(n - k + 1.0) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    return float(min(1.0, np.exp(t - t.max()).sum() * math.exp(t.max())))


def certify(counts, n: int, risk: float, level: float) -> int:
    """Strictest level whose loss is certified below ``risk``; -1 if none. counts[k]: good documents rejected from level k on."""
    best, lost = -1, 0
    for k in range(LEVELS + 1):
        lost += counts.get(k, 0)
        if binomial_tail(lost, n, risk) > level:
            break
        best = k
    return best


def thresholds(values: DataFrame, labels: DataFrame, strata="lang", risk=RISK, delta=DELTA, id_col="doc_id") -> DataFrame:
    """(stratum, n_good, cut): the certified level of each stratum from documents labelled good."""
    good = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("_q"))
            .where("_q = 1").select(id_col))
    hist = (values.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(good, id_col)
            .groupBy(F.coalesce(F.col(strata).cast("string"), F.lit("\0")).alias("stratum"), "level").agg(F.count("*").alias("n")))
    hist = hist.withColumn("strata", hist.select(F.count_distinct("stratum")).scalar())  # the Bonferroni divisor

    def fit(pdf):
        counts = dict(zip(pdf["level"].astype(int), pdf["n"].astype(int)))
        n = int(pdf["n"].sum())
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "n_good": [n],
                             "cut": [certify(counts, n, risk, delta / int(pdf["strata"].iloc[0]))]})

    return hist.groupBy("stratum").applyInPandas(fit, "stratum string, n_good long, cut int")


def judge(docs: DataFrame, labels: DataFrame, strata="lang", text_col="text", id_col="doc_id", risk=RISK, delta=DELTA, keep_text=False) -> DataFrame:
    """``docs`` with metrics, ``base_failed``, ``cut`` and ``kept``; its text only with ``keep_text``.

    The metrics are written once, without texts; calibration joins them with the labels, so no text
    is shuffled. With ``keep_text`` a second narrow pass measures again instead of joining texts.
    The cutoff table has a row per stratum and is broadcast only if its counted size is at most
    ``MAX_BROADCAST`` rows, else joined by key.
    """
    values = cut(measured(docs.select(*dict.fromkeys([id_col, strata, text_col])) if keep_text else docs, text_col), "metrics")
    cuts = thresholds(values, labels, strata, risk, delta, id_col)
    rows = cuts.limit(MAX_BROADCAST + 1).collect()  # strata, not documents: bounded before use
    small = len(rows) <= MAX_BROADCAST
    cuts = docs.sparkSession.createDataFrame(rows, "stratum string, n_good long, cut int") if small else cuts
    cuts = cuts.select(F.col("stratum").alias("_stratum"), F.col("cut").alias("_cut"))
    v = measured(docs, text_col, True) if keep_text else values
    v = v.withColumn("_stratum", F.coalesce(F.col(strata).cast("string"), F.lit("\0")))
    v = v.join(F.broadcast(cuts) if small else cuts, "_stratum", "left").drop("_stratum")
    return (v.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
            .withColumn("cut", F.coalesce("_cut", F.lit(-1)))
            .withColumn("kept", F.expr("not base_failed and level > cut")).drop("_cut"))
