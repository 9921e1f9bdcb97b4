"""Splits, folds, null networks and noise. Every draw is hash-ordered (see functions.det); numpy
streams of other implementations are matched in distribution, not draw by draw."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from netloom.functions import det
from netloom.functions.stats import top_k
from netloom.operators.blocks import attach_all
from netloom.operators.edges import by_weight
from netloom.operators.ranking import number_rows
from netloom.session import cut


def split_perturbations(obs, share=0.5, tfs=None, seed=32):
    """Train/test sides of the perturbations: a share of each stratum (factor or not) goes to
    train, controls go to both. Returns (split, perturbation)."""
    p = obs.where("not is_control").select("perturbation").distinct()
    if tfs is not None:
        p = p.join(tfs.select(F.col("tf").alias("perturbation"), F.lit(True).alias("is_tf")), "perturbation", "left").fillna(False, ["is_tf"])
    else:
        p = p.withColumn("is_tf", F.lit(False))
    w = W.partitionBy("is_tf").orderBy(det.hash_key("perturbation", seed=seed), "perturbation")
    n = F.count("*").over(W.partitionBy("is_tf"))
    p = p.select("perturbation", F.when(F.row_number().over(w) <= F.floor(n * share), "train").otherwise("test").alias("split"))
    c = obs.where("is_control").select("perturbation").distinct().withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    return p.unionByName(c).select("split", "perturbation")


def rule_split(obs, rules, cols):
    """Rows matching a rule table go to train, all others to test."""
    r = rules.select(*cols).distinct().withColumn("_t", F.lit(1))
    return obs.join(r, cols, "left").withColumn("split", F.when(F.col("_t") == 1, "train").otherwise("test")).drop("_t")


def group_shuffle(obs, group, share=0.5, seed=42, ident="obs_id"):
    """Half of the groups to test; with fewer than two groups, half of the rows."""
    g = obs.select(group).distinct()
    n = g.select(F.count("*")).scalar()
    s = number_rows(g, det.hash_key(group, seed=seed), "_i", tie=[group]).withColumn("_n", n)
    s = s.select(group, (F.col("_i") >= F.ceil(F.col("_n") * share)).alias("_by_group"), F.col("_n"))
    out = obs.join(s, group)
    row = det.fold(ident, seed=seed, k=2) == 0
    return out.withColumn("is_train", F.when(F.col("_n") >= 2, F.col("_by_group")).otherwise(row)).drop("_by_group", "_n")


def group_kfold(obs, group, k=5):
    """Fold of each group, balanced by rows: groups in order of size are dealt in rounds of ``k``, in turn
    from the first and from the last fold.

    Folds differ by at most the size of the largest group: within a pair of rounds what one deal
    gives too much the next takes back. Groups are numbered inside (size, hash) parts and shifted by
    the parts before, so there is no list of all groups, whatever their number.
    """
    g = obs.groupBy(group).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(group), F.lit(64)).cast("int")
    g = g.withColumn("_p", part)
    size = g.groupBy("n", "_p").agg(F.count("*").alias("_c"))
    # as many rows as there are different group sizes, times 64 at most
    before = size.select("n", "_p", F.coalesce(F.sum("_c").over(W.orderBy(F.col("n").desc(), "_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.row_number().over(W.partitionBy("n", "_p").orderBy(group)) - 1
    i = g.join(before, ["n", "_p"]).select(group, at.alias("_i"))
    turn, place = F.floor(F.col("_i") / k) % 2, F.col("_i") % k
    return i.select(group, F.when(turn == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))


def folds(obs, column=None, k=5, seed=0xCAFE, min_rows=200, ident="obs_id"):
    """Cross-validation folds: one per group of a column with enough rows, or ``k`` random ones."""
    if column is None:
        return obs.select(ident, det.fold(ident, seed=seed, k=k).cast("string").alias("fold"))
    keep = obs.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(column)
    return obs.join(keep, column, "left_semi").select(ident, F.col(column).cast("string").alias("fold"))


FEW = 1_000_000  # draws of a random network that are rows before they meet their genes
DRAWS = 4_000_000  # of a task beyond that
BOX, PIECE = 1 << 21, 1 << 16  # names of genes that such a task holds, and that are stored as one row


def negative_control(genes, tfs, share=0.01, n_tfs=None, seed=0):
    """Random signed network of all factors, or the first ``n_tfs`` by name: each sign with probability ``share``.

    A factor walks the genes, numbered in hash order, by gaps of geometric length: the same chances as
    a draw for every (factor, gene), but only the edges are formed. Twelve deviations more gaps than
    expected are drawn, so that the walk reaches the last gene. A long network is walked in tasks (``_walked``).
    """
    t = tfs.select(F.col("tf").alias("source")).distinct()
    t = t if n_tfs is None else t.orderBy("source").limit(n_tfs)
    t, g = cut(t, "factors"), cut(genes.select(F.col("gene").alias("target")).distinct(), "genes")
    numbered = number_rows(g, det.hash_key("target", seed=f"{seed}g"), "_i", tie=["target"])
    (n, rows), p = g.agg(F.count("target"), F.count("*")).first(), 2 * share
    draws = math.ceil(n * p + 12 * math.sqrt(n * p) + 12)
    factors = t.count()
    if factors * draws > FEW:
        return _walked(t, numbered, rows, p, draws, factors, seed)
    walk = t.withColumn("_n", F.lit(draws)).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    skip = F.floor(F.log(F.greatest(det.uniform("source", "_j", seed=f"{seed}a"), F.lit(1e-12))) / math.log(1 - p)) if p < 1 else F.lit(0).cast("bigint")
    gap = 1 + skip
    walk = walk.withColumn("_i", F.sum(gap).over(W.partitionBy("source").orderBy("_j")) - 1)
    # the planner takes the walk for as small as the table it is exploded from, and would collect it for a broadcast
    e = walk.select("source", "_j", "_i").join(numbered.hint("merge"), "_i")
    return e.select("source", "target", F.when(det.uniform("source", "_j", seed=f"{seed}b") < 0.5, -1.0).otherwise(1.0).alias("weight"))


def _walked(t, numbered, rows, p, draws, factors, seed):
    """The edges of ``negative_control``, each formed where its draw is made.

    Factors are dealt to slices, numbered names to boxes. A task reads one slice and one box, walks its factors inside the box
    and emits edges: nothing is sorted or shuffled but factors and names, once each. Beyond one box a first pass finds where
    each factor's walk enters it.
    """
    slices, boxes = min(factors, max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-factors * draws // DRAWS))), max(1, -(-rows // BOX))
    kind, kind2, width, piece = t.schema["source"].dataType.simpleString(), numbered.schema["target"].dataType.simpleString(), BOX, PIECE
    gap_seed, sign_seed = (f":{seed}{x}".encode() for x in "ab")

    def steps(source, j, at):
        """(first draw, places before and after each draw) in runs, from draw ``j`` at place ``at`` on."""
        prefix = b"" if source is None else source.encode() + b":"
        while j <= draws and at < rows:
            end = min(draws + 1, j + (1 << 16))
            u = np.maximum(det.heads(prefix, j, end, gap_seed) / 4294967296.0, 1e-12)
            gap = 1 + (np.floor(np.log(u) / math.log(1 - p)).astype(np.int64) if p < 1 else np.zeros(len(u), np.int64))
            place = np.concatenate([[at], at + np.cumsum(gap)])
            yield prefix, j, place
            j, at = end, int(place[-1])

    def entered(batches):
        for batch in batches:
            for source in batch.column("source").to_pylist():
                seen = -1
                for _, j, place in steps(source, 1, -1):
                    first = np.flatnonzero(np.diff(np.concatenate([[seen], np.minimum(place[1:], rows) // width])))
                    first = first[place[1:][first] < rows]
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(first), pa.string()), pa.array(place[1:][first] // width, pa.int32()), pa.array(j + first, pa.int64()), pa.array(place[first], pa.int64())],
                                                     names=["source", "_b", "_j", "_at"])
                    seen = place[-1] // width

    t = t.select(F.col("source").cast("string").alias("source")).repartition(slices, "source")
    if boxes > 1:
        begun = t.mapInArrow(entered, "source string, _b int, _j long, _at long")
    else:
        begun = t.select("source", F.lit(0).alias("_b"), F.lit(1).cast("bigint").alias("_j"), F.lit(-1).cast("bigint").alias("_at"))
    slice_ = F.pmod(F.xxhash64("source"), F.lit(slices)).cast("int").alias("_s")
    begun = begun.groupBy(slice_, "_b").agg(F.collect_list(F.struct("source", "_j", "_at")).alias("w"))
    named = numbered.select(F.floor(F.col("_i") / piece).cast("int").alias("_k"), "_i", F.col("target").cast("string").alias("target"))
    named = named.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "target")))["target"].alias("e")).withColumn("_b", F.floor(F.col("_k") / (width // piece)).cast("int"))
    met = begun.repartitionById(slices, F.col("_s")).hint("shuffle_replicate_nl").join(named.repartitionById(boxes, F.col("_b")), "_b")

    def work(batches):
        held, left = {}, {}
        for batch in batches:
            for k in range(batch.num_rows):
                b, s, piece_no = (batch.column(c)[k].as_py() for c in ("_b", "_s", "_k"))
                lo, hi = b * width, min(rows, (b + 1) * width)
                names = held.setdefault(b, {})
                if piece_no not in names:
                    names[piece_no] = batch.column("e")[k].values
                left[s, b] = left.get((s, b), -(-(hi - lo) // piece)) - 1
                if left[s, b] == 0:  # the box is whole
                    yield from edges(batch.column("w")[k].values, pa.concat_arrays([names[x] for x in sorted(names)]), lo, hi)

    def edges(begun, names, lo, hi):
        out, count = [], 0
        for source, j0, at0 in zip(*(begun.field(c).to_pylist() for c in ("source", "_j", "_at"))):
            for prefix, j, place in steps(source, j0, at0):
                place = place[1:]
                n = int(np.searchsorted(place, hi))
                sign = np.where(det.heads(prefix, j, j + n, sign_seed) < 1 << 31, -1.0, 1.0)
                out.append([pa.repeat(pa.scalar(source, pa.string()), n), names.take(pa.array(place[:n] - lo)), pa.array(sign, pa.float64())])
                count += n
                if count >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], names=["source", "target", "weight"])
                    out, count = [], 0
                if n < len(place):
                    break
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], names=["source", "target", "weight"])

    found = met.select("_b", "_s", "_k", "w", "e").mapInArrow(work, "source string, target string, weight double")
    return found.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind2).alias("target"), "weight")


def next_prime(n):
    """Least prime of at least ``n``."""
    p = max(n, 2)
    while any(p % d == 0 for d in range(2, int(p ** 0.5) + 1)):
        p += 1
    return p


def draw(groups, items, by, item, wanted, seed):
    """At least ``wanted`` different items for each row of ``groups`` (all, if there are no more), in order ``_j``.

    Items are numbered in hash order; a row walks their numbers modulo a prime with a start and a
    stride of its own, so draws never repeat and nothing but the draws is formed.
    """
    items = items.distinct()
    n = items.count()
    p = next_prime(n)
    numbered = number_rows(items, det.hash_key(item, seed=f"{seed}g"), "_i", tie=[item])
    start = F.floor(det.uniform(by, seed=f"{seed}a") * p)
    stride = 1 + F.floor(det.uniform(by, seed=f"{seed}s") * (p - 1))
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(wanted.cast("bigint") + (p - n), F.lit(p).cast("bigint")) - 1)
    at = groups.where(wanted > 0).withColumn("_j", F.explode(steps)).withColumn("_i", (start + F.col("_j") * stride) % p)
    return at.join(numbered.hint("merge"), "_i").drop("_i")  # the draws are many more than their size estimate tells


def random_partners(edges, genes, by="source", seed=42, extra=(), allow_self=False):
    """Null network: every source (or target) keeps its number of edges and its weights, its
    partners become random genes, its own gene only with ``allow_self``. Weights go from strongest
    to the first drawn partner on."""
    other, extra = ("target" if by == "source" else "source"), list(extra)
    k = edges.groupBy(*extra, by).agg(F.count("*").alias("k"))
    w = W.partitionBy(*extra, by).orderBy(*by_weight())
    ranked = edges.select(*extra, by, "weight", F.row_number().over(w).alias("rn"))
    spare = F.lit(0 if allow_self else 1)
    pool = draw(k, genes.select(F.col("gene").alias(other)), by, other, F.col("k") + spare, seed)
    if not allow_self:
        pool = pool.where(F.col(by) != F.col(other))
    drawn = pool.withColumn("rn", F.row_number().over(W.partitionBy(*extra, by).orderBy("_j"))).where("rn <= k")
    return drawn.select(*extra, by, other, "rn").join(ranked, [*extra, by, "rn"]).select(*extra, "source", "target", "weight")


def degree_null(edges, seed=7, extra=()):
    """Degree-preserving null by stub matching: the target stubs are shuffled against the source
    stubs, self-loops and repeats fall out, and each source's weights go by size to its new
    targets in order of their in-degree."""
    extra = list(extra)
    e = edges.where("source != target and weight != 0").select(*extra, "source", "target", "weight")
    tie = ["source", "target"]
    left = number_rows(e, det.hash_key("source", "target", seed=f"{seed}a"), "_i", extra, tie).select(*extra, "_i", "source")
    right = number_rows(e, det.hash_key("source", "target", seed=f"{seed}b"), "_i", extra, tie).select(*extra, "_i", "target")
    pairs = left.join(right, [*extra, "_i"]).where("source != target").select(*extra, "source", "target").distinct()
    deg = e.groupBy(*extra, "target").agg(F.count("*").alias("_d"), F.sum(F.abs("weight")).alias("_s"))
    by = W.partitionBy(*extra, "source")
    new = pairs.join(deg, [*extra, "target"]).withColumn(
        "_rn", F.row_number().over(by.orderBy(F.col("_d").desc(), F.round("_s", 6).desc(), "target")))
    old = e.withColumn("_rn", F.row_number().over(by.orderBy(F.abs("weight").desc(), "weight", "target"))).select(*extra, "source", "_rn", "weight")
    return new.join(old, [*extra, "source", "_rn"]).select(*extra, "source", "target", "weight")


NOISE = ("direction", "sign", "weight", "net")


def _mix(s, t, rows, cols, seed, back=False):
    """Pseudo-random permutation of the places (s, t) of a rows x cols grid, or its inverse: each of four
    rounds moves one coordinate by a hash of the other, so no place is ever listed."""
    for r in (range(4) if not back else reversed(range(4))):
        move = (lambda c, n: F.floor(det.uniform(c, seed=f"{seed}{r}") * n))  # noqa: B023, E731
        sign = -1 if back else 1
        if r % 2 == 0:
            t = F.pmod(t + sign * move(s, cols), cols)
        else:
            s = F.pmod(s + sign * move(t, rows), rows)
    return s, t


def _sizes(edges, keys, *aggs):
    """One row of totals per key next to the edges of the key."""
    return edges.groupBy(*keys).agg(*aggs) if keys else edges.agg(*aggs)


def _with(df, sizes, keys):
    return df.join(sizes, list(keys)) if keys else attach_all(df, sizes)


def add_noise(edges, noise, degree, seed=0, keys=()):
    """Edges with one kind of noise: swapped direction, flipped sign, gaussian weight noise or a
    shuffled share of the whole source x target grid, per key.

    Of the grid, a share of the places in a pseudo-random order is shuffled: the edges among these
    places, in hash order, move to the first places of that order. Places without an edge stay implied.
    """
    keys = list(keys)
    e = edges.select(*keys, "source", "target", "weight")
    tie = ["source", "target"]
    if noise in ("direction", "sign"):
        d = number_rows(e, det.hash_key("source", "target", seed=f"{seed}{noise}"), "_i", keys, tie)
        d = _with(d, _sizes(e, keys, F.count("*").alias("_n")), keys)
        hit = F.col("_i") < F.floor(F.col("_n") * degree)
        if noise == "sign":
            return d.select(*keys, "source", "target", F.when(hit, -F.col("weight")).otherwise(F.col("weight")).alias("weight"))
        return d.select(*keys, F.when(hit, F.col("target")).otherwise(F.col("source")).alias("source"),
                        F.when(hit, F.col("source")).otherwise(F.col("target")).alias("target"), "weight")
    if noise == "weight":
        d = _with(e, _sizes(e, keys, F.stddev_samp("weight").alias("_sd")), keys)
        return d.select(*keys, "source", "target", (F.col("weight") + det.gaussian("source", "target", seed=f"{seed}w") * degree * F.col("_sd")).alias("weight"))
    if noise != "net":
        raise ValueError(f"unknown noise {noise}")
    if degree <= 0:
        return e
    e = e.groupBy(*keys, "source", "target").agg(F.avg("weight").alias("weight"))
    size = _sizes(e, keys, F.count_distinct("source").alias("_rows"), F.count_distinct("target").alias("_cols"))
    names = [number_rows(e.select(*keys, c).distinct(), det.hash_key(c, seed=f"{seed}{c}"), i, keys, [c]) for c, i in (("source", "_row"), ("target", "_col"))]
    e = _with(e.where("weight != 0").join(names[0], [*keys, "source"]).join(names[1], [*keys, "target"]), size, keys)
    e = e.withColumn("_m", F.floor(F.col("_rows") * F.col("_cols") * degree))
    s, t = _mix(F.col("_row"), F.col("_col"), F.col("_rows"), F.col("_cols"), f"{seed}n")
    e = cut(e.withColumn("_at", s * F.col("_cols") + t), "places")
    moved = number_rows(e.where("_at < _m").drop("_row", "_col"), det.hash_key("source", "target", seed=f"{seed}v"), "_i", keys, tie)
    s, t = _mix(F.floor(F.col("_i") / F.col("_cols")), F.col("_i") % F.col("_cols"), F.col("_rows"), F.col("_cols"), f"{seed}n", back=True)
    moved = moved.select(*keys, s.alias("_row"), t.alias("_col"), "weight").join(names[0], [*keys, "_row"]).join(names[1], [*keys, "_col"])
    return moved.select(*keys, "source", "target", "weight").unionByName(e.where("_at >= _m").select(*keys, "source", "target", "weight"))


def noise_sweep(edges, degrees=(0.0, 0.2, 0.5, 1.0), kinds=NOISE, keys=()):
    """All noise kinds at all degrees as one table (noise, level, edges)."""
    out = None
    for k in kinds:
        for d in degrees:
            part = add_noise(edges, k, d, keys=keys).select(F.lit(k).alias("noise"), F.lit(float(d)).alias("level"), *keys, "source", "target", "weight")
            out = part if out is None else out.unionByName(part)
    return out


def shrink(expr, obs, loc, donor, chrom, n_cells, n_features):
    """Small copy of a data set: one donor, one contig, first cells, top features."""
    o = obs.where(F.col("donor_id") == donor).orderBy("row_no").limit(n_cells)
    e = expr.join(o.select("obs_id"), "obs_id", "left_semi").join(loc.where(F.col("chrom") == chrom).select("gene"), "gene", "left_semi")
    top = e.groupBy("gene").agg(F.sum("value").alias("_t")).orderBy(F.round("_t", 6).desc(), "gene").limit(n_features).select("gene")
    return e.join(top, "gene", "left_semi")
