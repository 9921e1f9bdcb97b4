"""Genomic interval joins. An inequality join would compare every row with every row; here an interval
lies in at most two or three bins of a width that suits its own length, bins are nested, and the
shorter interval of a pair is looked up in the bins of the longer one's level. A pair is kept in the
bin where its overlap begins, so it appears once. Two intervals that share such a bin lie within one
bin's width of each other, so the candidates follow the result and no bin is much fuller than its
overlaps make it; what is still hot is spread over a grid of slices."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.functions.skew import grid_join
from netloom.functions.stats import bh, t_p_two
from netloom.operators.blocks import sparse_product
from netloom.operators.filters import parse_peak
from netloom.session import cut

LEAST_LEVEL = 3  # bins of level k are 4**k wide


def _level(start, end) -> Column:
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.col(end) - F.col(start) + 1) / 2)).cast("int")


def _levels(df, start, end) -> list:
    """Levels that occur: at most 64 numbers."""
    return sorted(df.where(F.col(end) >= F.col(start)).agg(F.collect_set(_level(start, end))).first()[0])


def _binned(df, start, end, others, own_side):
    """Rows with (_level, _side, _bin): the bins of the own level, and those of the longer levels of the other side."""
    level, other_side = _level(start, end), "b" if own_side == "a" else "a"
    longer = F.filter(F.array(*[F.lit(x) for x in others]), (lambda x: x > level) if own_side == "a" else (lambda x: x >= level))

    def bins(lv, side):
        width = F.pow(F.lit(4.0), lv)
        run = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
        return F.transform(run, lambda k: F.struct(lv.cast("int").alias("_level"), F.lit(side).alias("_side"), k.alias("_bin")))

    places = F.concat(bins(level, own_side), F.flatten(F.transform(longer, lambda x: bins(x, other_side))))
    return df.where(F.col(end) >= F.col(start)).withColumn("_at", F.explode(places)).select(*df.columns, "_at._level", "_at._side", "_at._bin")


def overlap_join(a: DataFrame, b: DataFrame, closed=True, side=None) -> DataFrame:
    """Pairs of overlapping intervals. ``a`` has (chrom, a_start, a_end, ...), ``b`` has
    (chrom, b_start, b_end, ...). ``closed`` counts touching ends as overlap.

    Of a pair the longer level decides: ``a``'s if equal. Rows that end before they start meet nothing.
    """
    x = _binned(a, "a_start", "a_end", _levels(b, "b_start", "b_end"), "a")
    y = _binned(b, "b_start", "b_end", _levels(a, "a_start", "a_end"), "b")
    if closed:
        hit = (F.col("b_end") >= F.col("a_start")) & (F.col("b_start") <= F.col("a_end"))
    else:
        hit = (F.col("b_end") > F.col("a_start")) & (F.col("b_start") < F.col("a_end"))
    home = F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / F.pow(F.lit(4.0), F.col("_level")))
    met = grid_join(x, y, ["chrom", "_level", "_side", "_bin"], a.columns, b.columns, side)
    return met.where(hit & home).drop("_level", "_side", "_bin")


def merged(df: DataFrame, by, start, end, closed=True, width=4096) -> DataFrame:
    """Unions (by, start, end) of overlapping intervals of the same ``by``, run by run inside bins of ``width``.

    An interval overlaps a union exactly where it overlaps one of its members, so what asks only whether
    two names meet can join unions: a crowded stretch is then a few rows per name and bin. ``closed`` also
    unites intervals that touch; half-open ones that only touch stay apart, or an empty one between them would meet.
    """
    by = list(by)
    d = df.where(F.col(end) >= F.col(start)).select(*by, F.floor(F.col(start) / width).alias("_bin"), start, end)
    d = d.repartition(*by, "_bin").groupBy(*by, "_bin", start).agg(F.max(end).alias(end))  # one shuffle for all that follows
    order = W.partitionBy(*by, "_bin").orderBy(start)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) > reach if closed else F.col(start) >= reach
    d = d.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    d = d.groupBy(*by, "_bin", "_run").agg(F.min(start).alias(start), F.max(end).alias(end))
    return cut(d.select(*by, start, end), "unions")


def tss_window(tss, up=1000, down=100):
    """Strand-aware window around each start site, clipped at 0."""
    lo = F.when(F.col("strand") == "+", F.col("tss") - up).otherwise(F.col("tss") - down)
    hi = F.when(F.col("strand") == "+", F.col("tss") + down).otherwise(F.col("tss") + up)
    gene = F.trim("gene")
    return (tss.where(F.col("chrom").startswith("chr") & (gene != ""))
            .select("chrom", F.greatest(F.lit(0), lo).cast("bigint").alias("a_start"), hi.cast("bigint").alias("a_end"), gene.alias("gene")))


def peaks_near_tss(peaks, tss, up=1000, down=100, extra=()):
    """Distinct (source, target): a binding peak of the factor touches the window of the gene."""
    extra = list(extra)
    w = tss_window(tss, up, down).distinct()
    p = peaks.where("start >= 0 and stop >= 0").select(*extra, "chrom", F.col("start").alias("b_start"), F.col("stop").alias("b_end"), "tf")
    p = merged(p, [*extra, "chrom", "tf"], "b_start", "b_end")
    return overlap_join(w, p).select(*extra, F.col("tf").alias("source"), F.col("gene").alias("target")).distinct()


def promoter_skeleton(tss, motifs, flank=1000):
    """Motif hits in the flank around each start site, half-open intervals."""
    g = tss.select("chrom", (F.col("tss") - flank).alias("a_start"), (F.col("tss") + 1 + flank).alias("a_end"), "gene").distinct()
    m = motifs.select("chrom", F.col("start").alias("b_start"), F.col("stop").alias("b_end"), "tf")
    return overlap_join(g, merged(m, ["chrom", "tf"], "b_start", "b_end", closed=False), closed=False).select(F.col("tf").alias("source"), F.col("gene").alias("target")).distinct()


def peak2gene(tss, peaks, reach=150_000):
    """Accessible peaks within reach of a gene: (gene, peak, dist)."""
    g = tss.select("chrom", F.greatest(F.lit(0), F.col("tss") - reach).alias("a_start"), (F.col("tss") + reach).alias("a_end"), "gene", "tss").distinct()
    p = parse_peak(peaks.select("peak").distinct()).select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "peak")
    mid = F.greatest(F.lit(0), F.col("b_start") - F.col("tss"), F.col("tss") - F.col("b_end"))
    return (overlap_join(g, p).groupBy("gene", "peak").agg(F.min(mid).alias("dist")))


def peak2tf(peaks, motifs):
    p = parse_peak(peaks.select("peak").distinct()).select("chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "peak")
    m = motifs.select("chrom", F.col("start").alias("b_start"), F.col("stop").alias("b_end"), "tf")
    return overlap_join(p, merged(m, ["chrom", "tf"], "b_start", "b_end", closed=False), closed=False).select(F.col("tf").alias("source"), "peak").distinct()


def bridge(gene_links, tf_links):
    """Factor -> peak -> gene, the peak dropped."""
    return (gene_links.select("peak", F.col("gene").alias("target")).join(tf_links, "peak")
            .select("source", "target").distinct())


def skeleton(tss, motifs, peaks=None, flank=1000, reach=150_000):
    """Prior edges from promoters and, with a chromatin table, from reachable peaks."""
    out = promoter_skeleton(tss, motifs, flank)
    if peaks is not None:
        out = out.unionByName(bridge(peak2gene(tss, peaks, reach), peak2tf(peaks, motifs)))
    return out.distinct()


def annotate(genes, loc):
    """Genes with coordinates; unknown genes are dropped."""
    return genes.join(loc, "gene", "left").where(F.col("chrom").isNotNull())


def drop_blacklisted(peaks, black):
    """Peaks that touch no blacklist region."""
    p = peaks.select("event_id", "chrom", F.col("start").alias("a_start"), F.col("stop").alias("a_end"))
    b = black.select("chrom", F.col("start").alias("b_start"), F.col("stop").alias("b_end"))
    bad = overlap_join(p, b, closed=False).select("event_id").distinct()
    return peaks.join(bad, "event_id", "left_anti")


def peak_gene_corr(access, expr, obs, links, method="pearson"):
    """Correlation over samples for linked (peak, gene) pairs, with t, p and FDR."""
    from netloom.operators.expression import gene_moments, rank_transform
    a = access.withColumnRenamed("peak", "gene")
    if method == "spearman":
        a, expr = cut(rank_transform(a, obs), "ranks"), cut(rank_transform(expr, obs), "ranks")
    links = cut(links.select("peak", "gene").join(expr.select("gene").distinct(), "gene", "left_semi"), "links")
    ma = gene_moments(a, obs).select(F.col("gene").alias("peak"), F.col("s").alias("sa"), F.col("q").alias("qa"))
    mb = gene_moments(expr, obs).select("gene", F.col("s").alias("sb"), F.col("q").alias("qb"), "n")
    # only linked pairs are wanted: peaks meet genes inside stretches of the genome, blocks of one with blocks of the other
    stretch = F.concat_ws(":", F.substring_index("peak", ":", 1), F.floor(F.regexp_extract("peak", r":(\d+)-", 1).try_cast("bigint") / 2 ** 20).cast("string"))
    near = links.withColumn("_k", stretch)
    x = a.select("obs_id", F.col("gene").alias("peak"), F.col("value").alias("x")).join(near.select("peak", "_k").distinct(), "peak")
    y = expr.select("obs_id", "gene", F.col("value").alias("y")).join(near.select("gene", "_k").distinct(), "gene")
    cross = sparse_product(x, y, "obs_id", "peak", "gene", "x", "y", "sxy", keys=["_k"])
    d = links.select("peak", "gene").join(ma, "peak").join(mb, "gene").join(cross, ["peak", "gene"], "left")
    n = F.col("n")
    va, vb = n * F.col("qa") - F.pow("sa", 2), n * F.col("qb") - F.pow("sb", 2)
    r = (n * F.coalesce("sxy", F.lit(0.0)) - F.col("sa") * F.col("sb")) / F.nullif(F.sqrt(va * vb), F.lit(0.0))
    d = d.select("peak", "gene", "n", r.alias("r"))
    return d.withColumn("t", F.col("r") * F.sqrt((n - 2) / (1 - F.col("r") * F.col("r"))))


def peak_gene_fdr(corr):
    """Two-sided p of the correlation and its FDR over each chromosome-wide test family."""
    p = corr.withColumn("p", t_p_two("t", (F.col("n") - 2).cast("double")))
    return bh(p.withColumn("chrom", F.substring_index("peak", ":", 1)), ["chrom"], "p", "fdr")


def gene_activity(access, tss, reach=100_000, scale=5000.0, decay=1.0, gap=500):
    """Mean accessibility near each gene, weighted by exp(-distance / scale * decay)."""
    link = cut(peak2gene(tss, access, reach), "links")
    w = F.exp(-F.greatest(F.lit(0), F.col("dist") - gap) / scale * decay)
    n = link.groupBy("gene").agg(F.count("*").alias("n_peaks"))
    return sparse_product(access, link.join(n, "gene").withColumn("weight", w / F.col("n_peaks")), "peak", "obs_id", "gene")


def consensus_peaks(peaks, half=250):
    """Fixed-width peaks around summits; overlapping ones form an island that keeps its best
    scored peak.

    All peaks are equally wide, so two peaks that start in the same bin of that width overlap and
    an island is a run of bins. Bins are summed up first; only they are put in order.
    """
    width = 2 * half
    mid = F.floor((F.col("start") + F.col("stop")) / 2)
    p = peaks.select("chrom", (mid - half).alias("start"), (mid + half).alias("stop"), "score", "event_id")
    best = F.max_by(F.struct("start", "stop", "score", "event_id"), F.struct("score", -F.col("event_id")))
    bins = p.groupBy("chrom", F.floor(F.col("start") / width).alias("_bin")).agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"), best.alias("b"), F.count("*").alias("n"))
    w = W.partitionBy("chrom").orderBy("_bin")
    new = F.when(F.col("lo") - F.lag("hi").over(w) <= width, 0).otherwise(1)
    isl = bins.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    top = F.max_by("b", F.struct("b.score", -F.col("b.event_id")))
    return isl.groupBy("chrom", "island").agg(top.alias("b"), F.sum("n").alias("n")).select("chrom", "b.*", "n")
