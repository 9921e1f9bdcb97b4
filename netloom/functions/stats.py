"""Ranks, running totals, multiple testing and distribution tails.

Everything here first folds ties into a histogram (map-side combined) and then scans the
distinct values. A scan splits each key over value bins, so a key that owns a large share of
the rows is spread over many tasks instead of being sorted in one.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from netloom.session import cut

BINS = 16  # slices per octave


def value_bin(c, bins=BINS):
    """Monotone bin number of a double: sign, binary exponent, slice of the octave."""
    x = F.col(c).cast("double")
    mag = F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-300))) * bins) + 1000 * bins
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * mag).cast("bigint")


def scan(hist: DataFrame, keys, order, value, out, how="sum", reverse=False, inclusive=True,
         bins=BINS) -> DataFrame:
    """Running ``sum`` or ``min`` along a numeric ``order`` within ``keys``; ``value`` and ``out``
    may be lists. The (keys, order) pairs must be unique.

    Two levels: totals per (key, value bin) are scanned first, then the rows of each bin are
    scanned on their own and shifted. A bin is a slice of an octave of the value, so it needs no
    pass over the data and a recomputed stage lands on the same bins.
    """
    keys = list(keys)
    value, out = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    agg = F.sum if how == "sum" else F.min
    binned = hist.withColumn("_bin", value_bin(order, bins))
    totals = binned.groupBy(*keys, "_bin").agg(*[agg(v).alias(f"_t{i}") for i, v in enumerate(value)])
    by = F.col("_bin").desc() if reverse else F.col("_bin").asc()
    w_bin = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    offset = totals.select(*keys, "_bin", *[agg(f"_t{i}").over(w_bin).alias(f"_off{i}") for i in range(len(value))])
    by = F.col(order).desc() if reverse else F.col(order).asc()
    w_row = W.partitionBy(*keys, "_bin").orderBy(by).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    res = {}
    for i, (v, o) in enumerate(zip(value, out)):
        off, inner = F.col(f"_off{i}"), agg(v).over(w_row)
        res[o] = (F.coalesce(off, F.lit(0)) + F.coalesce(inner, F.lit(0)) if how == "sum"
                  else F.least(off, inner))
    drop = ["_bin", *[f"_off{i}" for i in range(len(value))]]
    return binned.join(offset, [*keys, "_bin"]).withColumns(res).drop(*drop)


def following(df: DataFrame, keys, order, cols, out, first=None, bins=BINS) -> DataFrame:
    """``out``: struct of ``cols`` of the next row along ``order`` within ``keys``, null for the last one;
    ``first`` marks each key's first row. The (keys, order) pairs must be unique.

    Two levels, as in ``scan``: rows look ahead inside their value bin, the last one of a bin at the first
    row of the next bin in use.
    """
    keys, row = list(keys), F.struct(*cols)
    binned = df.withColumn("_bin", value_bin(order, bins))
    heads = binned.groupBy(*keys, "_bin").agg(F.min_by(row, order).alias("_h"))
    w = W.partitionBy(*keys).orderBy("_bin")
    heads = heads.select(*keys, "_bin", F.lead("_h").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_top"))
    w = W.partitionBy(*keys, "_bin").orderBy(order)
    d = binned.join(heads, [*keys, "_bin"]).withColumn(out, F.coalesce(F.lead(row).over(w), F.col("_next")))
    if first:
        d = d.withColumn(first, F.col("_top") & (F.row_number().over(w) == 1))
    return d.drop("_bin", "_next", "_top")


def rank_table(hist: DataFrame, keys, value, n="n") -> DataFrame:
    """Average-tie rank of every distinct value of a histogram (keys, value, n)."""
    s = scan(hist, keys, value, n, "_before", inclusive=False)
    return s.withColumn("rank", F.col("_before") + (F.col(n) + 1) / 2.0).drop("_before")


def avg_rank(df: DataFrame, keys, value, out="rank") -> DataFrame:
    """Average-tie rank of every row; nulls are left out of the ranking and stay null."""
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranks = rank_table(hist, keys, value).select(*keys, value, F.col("rank").alias(out))
    return df.join(ranks, [*keys, value], "left")


def pct_rank(df: DataFrame, keys, value, out="pct") -> DataFrame:
    """Average-tie rank divided by the number of non-null rows of the key."""
    keys = list(keys)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    return (avg_rank(df, keys, value, "_r").join(n, keys, "left")
            .withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n"))


def bh(df: DataFrame, keys, p, out="padj") -> DataFrame:
    """Benjamini-Hochberg adjustment of ``p`` within ``keys``."""
    keys = list(keys)
    df = cut(df, "pvalues")  # the p-values often come from a Python kernel: compute them once
    hist = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_m"))
    n = hist.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    up = scan(hist, keys, p, "_m", "_rank").join(n, keys)
    up = up.withColumn("_q", F.col(p) * F.col("_n") / F.col("_rank")).select(*keys, p, "_q")
    adj = scan(up, keys, p, "_q", "_adj", how="min", reverse=True)
    adj = adj.select(*keys, p, F.least(F.lit(1.0), "_adj").alias(out))
    return df.join(adj, [*keys, p], "left")


def top_k(df: DataFrame, by, order, k, salt_key, salts=16, out=None) -> DataFrame:
    """Best ``k`` rows per group. ``k`` is a number or a column of ``df``.

    The group is first cut in ``salts`` slices by the hash of ``salt_key``; each slice keeps its
    own best ``k``, which cannot lose a winner, and only the survivors meet in one task.
    """
    k = F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_key]), F.lit(salts))
    w1 = W.partitionBy(*by, "_salt").orderBy(*order)
    w2 = W.partitionBy(*by).orderBy(*order)
    part = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
            .where(F.col("_rn") <= k).drop("_salt", "_rn"))
    return (part.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= k)
            .withColumnRenamed("_rn", out) if out else
            part.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= k).drop("_rn"))


def weighted_percentile(value, q, n="n"):
    """Exact percentile with linear interpolation over a histogram."""
    qs = F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, (list, tuple)) else F.lit(float(q))
    return F.percentile(F.col(value), qs, F.col(n))


# --- tails -----------------------------------------------------------------------------------

def _betacf(a, b, x):
    tiny, c = 1e-300, np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        step = d * c
        h *= step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return h


def _lgamma(x):
    """log Gamma once per distinct argument: degrees of freedom repeat over many rows."""
    u, inv = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in u])[inv].reshape(np.shape(x))


_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx))
        part = np.where(xx <= 0, 0.0, front * _betacf(aa, bb, xx) / aa)
    return np.where(flip, 1 - part, part)


def t_tail(t, df):
    """Upper tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


def normal_tail(z):
    """Upper tail of the standard normal."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def _masked(fn, *series):
    vals = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
    ok = np.all([np.isfinite(v) for v in vals], axis=0)
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*[v[ok] for v in vals])
    return pd.Series(out).astype("Float64").where(pd.Series(ok), pd.NA)


@F.pandas_udf(DoubleType())
def t_p_two(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: 2 * t_tail(np.abs(a), b), t, df)


@F.pandas_udf(DoubleType())
def t_p_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(t_tail, t, df)


@F.pandas_udf(DoubleType())
def norm_p_two(z: pd.Series) -> pd.Series:
    return _masked(lambda a: 2 * normal_tail(np.abs(a)), z)


@F.pandas_udf(DoubleType())
def norm_p_greater(z: pd.Series) -> pd.Series:
    return _masked(normal_tail, z)


def ln_gamma(x):
    """log Gamma for x >= 1 as a plain column: shift by 8, then Stirling's series."""
    s = x + 8
    prod = x
    for i in range(1, 8):
        prod = prod * (x + i)
    inv = 1 / s
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + series - F.log(prod)


def ln_choose(n, k):
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def fisher_greater(a, b, c, d):
    """One-sided (greater) Fisher exact p-value of a 2x2 table, inside the JVM.

    One log-binomial start term, then the hypergeometric ratio walks the upper tail.
    """
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    first = F.exp(ln_choose(row.cast("double"), a.cast("double"))
                  + ln_choose((n - row).cast("double"), c.cast("double"))
                  - ln_choose(n.cast("double"), col.cast("double")))
    last = F.least(row, col)
    ks = F.when(last > a, F.sequence(a, last - 1)).otherwise(F.array().cast("array<bigint>"))

    def walk(acc, k):
        nxt = acc["term"] * (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1)).cast("double")
        return F.struct(nxt.alias("term"), (acc["sum"] + nxt).alias("sum"))

    tail = F.aggregate(ks, F.struct(first.alias("term"), first.alias("sum")), walk, lambda acc: acc["sum"])
    return F.when(a <= F.greatest(F.lit(0), row + col - n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def welch_t(m1, v1, n1, m0, v0, n0):
    """Welch's t statistic and its degrees of freedom."""
    se2 = v1 / n1 + v0 / n0
    t = (m1 - m0) / F.sqrt(se2)
    df = se2 * se2 / (F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v0 / n0, 2) / (n0 - 1))
    return t, df
