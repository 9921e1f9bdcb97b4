"""Blocked pair products: balance, bounded pieces and values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import blocks as B


def sparse(table, x, prefix):
    return table([(f"o{i}", f"{prefix}{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "obs_id string, gene string, value double")


def grid(spark, rows, cols, share, prefix="g"):
    u = F.xxhash64("id", "c") / F.lit(2.0 ** 64) + 0.5
    return (spark.range(rows).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).where(u < share)
            .select(F.concat(F.lit("o"), "id").alias("obs_id"), F.concat(F.lit(prefix), "c").alias("gene"), F.lit(1.0).alias("value")))


def test_block_pairs_spread_over_partitions(spark):
    e = grid(spark, 500, 3000, 0.02)
    p = B.paired(e, e, "obs_id", "gene", "value", upper=True)
    per = p.select("_l", "_r").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) > 1 and sum(r["count"] for r in per) == 78  # 12 blocks: 78 pairs, one chunk


def test_a_side_with_few_items_does_not_make_the_other_one_row(spark):
    many, few = grid(spark, 40, 2000, 0.3, "cell"), grid(spark, 40, 3, 0.9, "true")
    p = B.paired(many, few, "obs_id", "gene", "value")
    size = p.select(F.aggregate("i", F.lit(0), lambda a, x: a + 1).alias("items"), F.size("i2").alias("few"))
    assert size.agg(F.max("items")).first()[0] < 2 * B.BLOCK and size.count() >= 8


@pytest.mark.parametrize("kernel", ["dot", "l1"])
@pytest.mark.parametrize("block,chunk", [(256, 1024), (2, 3)])
def test_values_in_any_blocking(table, kernel, block, chunk):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 4, (9, n)) * (rng.random((9, n)) < 0.6) for n in (7, 5))
    got = {(r.a, r.b): r.s for r in B.pair_sums(sparse(table, x, "a"), sparse(table, y, "b"), "obs_id", "gene", "value", kernel, block=block, chunk=chunk).collect()}
    for i in range(7):
        for j in range(5):
            p, q = x[:, i].astype(float), y[:, j].astype(float)
            want = p @ q if kernel == "dot" else (np.abs(p - q) - np.abs(p) - np.abs(q)).sum()
            assert got.get((f"a{i}", f"b{j}"), 0.0) == pytest.approx(want)
    same = {(r.a, r.b): r.s for r in B.pair_sums(sparse(table, x, "a"), sparse(table, x, "a"), "obs_id", "gene", "value", upper=True, block=block, chunk=chunk).collect()}
    assert all(a <= b for a, b in same)
    assert all(same.get((f"a{i}", f"a{j}"), 0.0) == pytest.approx(float(x[:, i] @ x[:, j])) for i in range(7) for j in range(i, 7))
