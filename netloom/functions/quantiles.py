"""Quantiles of large groups: a stored sketch per key that merges over batches, and exact values from it.

The sketch counts rows per value bin (a slice of an octave, see functions.stats), so estimates are off
by the width of a slice at most, whatever the number of rows. An exact quantile needs only the rows of
the one or two bins that hold its rank; no group is held or put in order as a whole.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.stats import BINS, value_bin


def sketch(df: DataFrame, keys, value, bins=BINS) -> DataFrame:
    """(keys, bin, n, lo, hi); nulls and NaN are left out."""
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, value_bin(value, bins).alias("bin"), x.alias("_x"))
    return d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))


def merge(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Sketch of both inputs, e.g. of the stored batches and a new one."""
    return a.unionByName(b).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranked(sk: DataFrame, keys, qs) -> DataFrame:
    """(keys, bin, lo, hi, before, q, part, rank): the bins that hold the lower and the upper rank of each quantile."""
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    d = sk.withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(by))
    at = [(F.lit(float(q)), part, f((F.col("all") - 1) * float(q)).cast("bigint")) for q in qs for part, f in (("low", F.floor), ("high", F.ceil))]
    want = F.array(*[F.struct(q.alias("q"), F.lit(part).alias("part"), r.alias("rank")) for q, part, r in at])
    inside = F.filter(want, lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("before") + F.col("n")))
    return d.select(*keys, "bin", "n", "lo", "hi", "before", "all", F.explode(inside).alias("_w")).select(*keys, "bin", "n", "lo", "hi", "before", "all", "_w.*")


def _joined(points: DataFrame, keys) -> DataFrame:
    """Linear interpolation between the values at the lower and the upper rank."""
    low, high = (F.max(F.when(F.col("part") == p, F.col("value"))) for p in ("low", "high"))
    share = (F.max("all") - 1) * F.col("q") - F.floor((F.max("all") - 1) * F.col("q"))
    return points.groupBy(*keys, "q").agg((low + (high - low) * share).alias("value"), F.max("all").alias("n"))


def approximate(sk: DataFrame, keys, qs) -> DataFrame:
    """(keys, q, value, n) from a sketch alone: a rank's place between the ends of its bin."""
    keys = list(keys)
    place = F.when(F.col("n") > 1, (F.col("rank") - F.col("before")) / (F.col("n") - 1)).otherwise(0.0)
    return _joined(_ranked(sk, keys, qs).withColumn("value", F.col("lo") + (F.col("hi") - F.col("lo")) * place), keys)


def exact(df: DataFrame, keys, value, qs, sk=None, bins=BINS) -> DataFrame:
    """(keys, q, value, n): exact quantiles with linear interpolation, of the rows behind ``sk`` if one is at hand."""
    keys = list(keys)
    ranks = _ranked(sketch(df, keys, value, bins) if sk is None else sk, keys, qs)
    asked = ranks.where("lo < hi").select(*keys, "bin").distinct()  # a bin of one value needs no rows
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, value_bin(value, bins).alias("bin"), x.alias("value"))
    on = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_a.{k}")) for k in [*keys, "bin"]]
    rows = rows.alias("_r").join(asked.alias("_a"), on, "left_semi").groupBy(*keys, "bin", "value").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys, "bin").orderBy("value"))
    rows = rows.withColumn("_to", upto).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bin").alias("_bin"), F.col("value").alias("_v"), "_to", (F.col("_to") - F.col("_c")).alias("_from"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "bin"]]
    place = F.col("rank") - F.col("before")
    found = ranks.join(rows, [*on, (place >= F.col("_from")) & (place < F.col("_to"))], "left")
    return _joined(found.withColumn("value", F.coalesce("_v", "lo")).drop("_v"), keys)
