"""Ranking, sampling and top-k operators."""

from pyspark.sql import Window as W, functions as F

from netloom.functions import det
from netloom.functions.stats import scan, top_k


def number_rows(df, key, out, keys=(), tie=()):
    """0-based place of every row in the order of a hex digest, without one global sort: rows are
    numbered inside 256 digest slices and shifted by the sizes of the slices before."""
    keys = list(keys)
    d = df.withColumn("_h", key).withColumn("_s", F.substring("_h", 1, 2))
    size = d.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    off = size.select(*keys, "_s", F.coalesce(before, F.lit(0)).alias("_off"))
    rn = F.row_number().over(W.partitionBy(*keys, "_s").orderBy("_h", *tie)) - 1
    return d.withColumn("_rn", rn).join(off, [*keys, "_s"]).withColumn(out, F.col("_rn") + F.col("_off")).drop("_h", "_s", "_rn", "_off")


def null_percentile(values, null, keys, col, draws=None, seed=0):
    """Share of a background strictly below each value, per key. Exact by default; ``draws``
    samples that many background rows per key by hash, as a sampled null does."""
    keys = list(keys)
    if draws:
        extra = [c for c in null.columns if c not in (*keys, col)]
        null = top_k(null, keys, [det.hash_key(*keys, *extra, seed=seed), F.col(col)], draws, [col, *extra])
    bg = null.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    axis = bg.unionByName(values.select(*keys, col).distinct().withColumn("_n", F.lit(0).cast("bigint")))
    axis = axis.groupBy(*keys, col).agg(F.sum("_n").alias("_n"))
    below = scan(axis, keys, col, "_n", "_below", inclusive=False)
    n = bg.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    share = below.join(n, keys).select(*keys, col, (F.col("_below") / F.col("_all")).alias("percentile"))
    return values.join(share, [*keys, col])


def split_controls(obs, out="perturbation_split"):
    """Controls cut in row order into chunks of the median perturbation size."""
    size = obs.where("not is_control").groupBy("perturbation").agg(F.count("*").alias("n")).agg(F.floor(F.median("n"))).scalar()
    c = scan(obs.where("is_control").withColumn("_one", F.lit(1)), [], "row_no", "_one", "_i", inclusive=False, bins=256).drop("_one")
    c = c.withColumn(out, F.concat(F.lit("control_"), F.floor(F.col("_i") / size).cast("string"))).drop("_i")
    return obs.where("not is_control").withColumn(out, F.col("perturbation")).unionByName(c)


def fill_to(obs, n, required, by="donor_id"):
    """Required donors, then the smallest donors until ``n`` samples; the first is always taken."""
    size = obs.groupBy(by).agg(F.count("*").alias("_n")).join(required.select(by, F.lit(1).alias("_req")), by, "left")
    base = size.agg(F.coalesce(F.sum(F.when(F.col("_req") == 1, F.col("_n"))), F.lit(0))).scalar()
    rest = size.where("_req is null").withColumn("_base", base)
    w = W.orderBy("_n", by)  # one row per donor
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_base")
    pick = rest.withColumn("_b", before).withColumn("_i", F.row_number().over(w)).where((F.col("_b") < n) | (F.col("_i") == 1)).select(by)
    return obs.join(pick.unionByName(required.select(by)), by, "left_semi")


def sample_per_group(obs, by, n, seed=0, ident="obs_id"):
    """At most ``n`` rows per group by hash order."""
    return top_k(obs, [by], [det.hash_key(ident, seed=seed), F.col(ident)], n, [ident])


def cap(obs, n, seed=0, ident="obs_id"):
    """At most ``n`` rows in all, by hash order."""
    keep = top_k(obs.select(ident), [], [det.hash_key(ident, seed=seed), F.col(ident)], n, [ident], salts=64)
    return obs.join(keep, ident, "left_semi")


def latest_run(trace):
    """All completed tasks of the most recent run of each method."""
    t = trace.where("status = 'COMPLETED'").withColumn("method", F.regexp_extract("name", r"\(([^)]+)\)", 1)).where("method != ''")
    last = t.groupBy("method").agg(F.max(F.struct("file_date", "source_file")).alias("_r"))
    last = last.select("method", F.col("_r.file_date").alias("file_date"), F.col("_r.source_file").alias("source_file"))
    return t.join(last, ["method", "file_date", "source_file"], "left_semi")


def top_features(expr, n, feature="gene", group=None):
    """Features with the largest total, over all cells or per group."""
    keys = [group] if group else []
    tot = expr.groupBy(*keys, feature).agg(F.sum("value").alias("total"))
    order = [F.round("total", 6).desc(), F.col(feature)]
    return top_k(tot, keys, order, n, [feature]) if group else tot.orderBy(*order).limit(n)


def first_per_group(df, by, order):
    """Row with the smallest ``order`` of each group, by aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in (by, order)]
    g = df.groupBy(by).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return g.select(by, "_r.*")


def recovery_auc(rankings, sets, auc_share=0.05, nes_min=None):
    """Recovery of each gene set at the top of each ranking, with its z-score over rankings.

    ``rankings`` is (motif, gene, rank from 0). The area below the recovery curve up to the cut
    is a sum over the hits."""
    n = rankings.select(F.count_distinct("gene")).scalar()
    r = rankings.withColumn("cut", F.round(n * auc_share) - 1)
    k = sets.groupBy("set_name").agg(F.count_distinct("gene").alias("k"))
    hit = r.join(sets.select("set_name", "gene").distinct(), "gene").join(k, "set_name")
    a = hit.groupBy("set_name", "motif").agg(
        (F.sum(F.greatest(F.lit(0.0), F.col("cut") - F.col("rank"))) / F.max((F.col("cut") + 1) * F.col("k"))).alias("auc"))
    s = a.groupBy("set_name").agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"))
    out = a.join(s, "set_name").select("set_name", "motif", "auc", F.try_divide(F.col("auc") - F.col("m"), F.nullif("s", F.lit(0.0))).alias("nes"))
    return out if nes_min is None else out.where(F.col("nes") >= nes_min)
