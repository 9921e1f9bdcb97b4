"""Joins that stay even when one key owns a large share of the rows."""

from pyspark.sql import DataFrame, functions as F

PER_SLICE = 200_000
SIDE = 20_000  # rows of either side that one cell of a hot key's grid may hold


def spread_join(big: DataFrame, small: DataFrame, on, salt, per=PER_SLICE) -> DataFrame:
    """Inner join on ``on`` where each row of ``big`` may meet many rows of ``small``.

    A runtime skew split looks at input bytes, not at the rows a join emits, so hot keys are cut
    here: a key with more than ``per`` rows on the big side gets ceil(rows / per) slices by the
    hash of ``salt``, and only the small rows of such keys are repeated. There are at most
    rows / per hot keys.
    """
    on, salt = list(on), list(salt)
    hot = (big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > per)
           .select(*on, F.ceil(F.col("_n") / per).cast("int").alias("_k")))
    b = big.join(hot, on, "left").withColumn("_s", F.when(F.col("_k").isNull(), 0).otherwise(F.pmod(F.xxhash64(*salt), F.col("_k"))).cast("int")).drop("_k")
    s = small.join(hot, on, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    return b.join(s, [*on, "_s"]).drop("_s")


def grid_join(a: DataFrame, b: DataFrame, on, salt_a, salt_b, side=None) -> DataFrame:
    """Inner join on ``on`` where a key may have many rows on both sides.

    Keys with more than ``side`` rows squared as pairs become a grid: rows of ``a`` are dealt to
    ceil(n_a / side) slices and copied to every slice of ``b``, and the other way round. A task then
    emits at most side * side pairs of a key, and the copies are a ``side``-th of the pairs.
    """
    on, side = list(on), side or SIDE
    count = [d.groupBy(*on).agg(F.count("*").alias(n)) for d, n in ((a, "_na"), (b, "_nb"))]
    hot = (count[0].join(count[1], on).where(F.col("_na").cast("double") * F.col("_nb") > float(side) * side)
           .select(*on, F.ceil(F.col("_na") / side).cast("int").alias("_ka"), F.ceil(F.col("_nb") / side).cast("int").alias("_kb")))

    def dealt(df, salt, own, other, k_own, k_other):
        one = F.coalesce(F.col(k_own), F.lit(1))
        d = df.join(hot, on, "left").withColumn(own, F.pmod(F.xxhash64(*salt), one).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(k_other), F.lit(1)) - 1))).drop("_ka", "_kb")

    left = dealt(a, list(salt_a), "_sa", "_sb", "_ka", "_kb")
    right = dealt(b, list(salt_b), "_sb", "_sa", "_kb", "_ka")
    return left.join(right, [*on, "_sa", "_sb"]).drop("_sa", "_sb")
