"""Blocked pairwise kernels: sums over a shared dimension for pairs of items.

Items (genes, profiles, cells) are hashed into blocks and the summed dimension into chunks. A
(chunk, block) cell holds a bounded piece of the matrix; cells meet by an equi-join on (chunk,
block, block), numpy multiplies the two pieces inside the task, and Spark adds the partial sums.
No task sees a whole row, column or group.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.functions.stats import top_k

CHUNK, BLOCK = 1024, 256
DIMS, ITEMS = 4096, 1024  # of a piece of a sparse product
COPIED = 16  # pairs of blocks of a sparse product up to which pieces are copied to their partners
GROUP = 4  # blocks of neighbours that a part meets in one task


MOST = 50_000  # rows of a lookup that may travel as one array


def attach_all(df: DataFrame, small: DataFrame, most=None) -> DataFrame:
    """Every row of ``df`` with every row of ``small``, where each of these pairs is a result.

    A counted lookup of at most ``most`` rows travels as one array. A longer one is cut in boxes of
    that size; rows of ``df`` are dealt to slices, and a slice meets each box by an equi-join.
    """
    most = most or MOST
    n = small.count()
    entry = F.struct(*small.columns)
    if n <= most:
        out = df.withColumn("_x", F.explode(small.agg(F.collect_list(entry)).scalar()))
    else:
        boxes, slices = -(-n // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        box = F.pmod(F.xxhash64(*small.columns), F.lit(boxes)).cast("int").alias("_b")
        packed = small.groupBy(box).agg(F.collect_list(entry).alias("_e")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        cut_ = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(slices)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(boxes - 1))))
        out = cut_.join(packed, ["_s", "_b"]).withColumn("_x", F.explode("_e"))
    return out.select(*df.columns, *[F.col(f"_x.{c}").alias(c) for c in small.columns])


def _pack(df, dim, item, value, keys, n_chunks, n_blocks, partners, tag, side):
    """Pieces of at most ``CHUNK`` dims x ``BLOCK`` items, one copy per partner block.

    Dims are 64-bit hashes and an item's name stands once, so a full piece holds
    CHUNK * BLOCK * 16 bytes (4 MB).
    """
    keyed = df.select(*keys, F.pmod(F.xxhash64(dim, F.lit(1)), F.lit(n_chunks)).cast("int").alias("_c"),
                      F.pmod(F.xxhash64(item), F.lit(n_blocks)).cast("int").alias("_b"),
                      F.col(item).cast("string").alias("_i"), F.xxhash64(dim).alias("_d"), F.col(value).cast("double").alias("_v"))
    rows = keyed.repartition(*keys, "_c", "_b").groupBy(*keys, "_c", "_b", "_i").agg(F.collect_list("_d").alias("d"), F.collect_list("_v").alias("v"))
    packed = rows.groupBy(*keys, "_c", "_b").agg(F.collect_list(F.struct("_i", "d", "v")).alias("_e"))
    copy = F.sequence(*[F.lit(x) if isinstance(x, int) else x for x in partners(F.col("_b"))])
    own, other = ("_l", "_r") if side == "left" else ("_r", "_l")
    return packed.select(*keys, "_c", F.col("_b").alias(own), F.explode(copy).alias(other),
                         *[F.col(f"_e.{f}").alias(f"{n}{tag}") for f, n in (("_i", "i"), ("d", "d"), ("v", "v"))])


def _dense(items, dims, values, axis):
    m = np.zeros((len(axis), len(items)))
    for k, (d, v) in enumerate(zip(dims, values)):
        np.add.at(m, (np.searchsorted(axis, d), k), v)
    return np.asarray(items, dtype=object).astype(str), m


def pair_sums(left: DataFrame, right: DataFrame, dim, item, value, kernel="dot", keys=(), upper=False,
              block=BLOCK, chunk=CHUNK) -> DataFrame:
    """(keys, a, b, s) with s = sum over ``dim`` of l*r (``dot``), or of |l-r|-|l|-|r| (``l1``).

    Both terms vanish where either side is zero, so only stored values travel. ``left`` and
    ``right`` hold (keys, dim, item, value); ``upper`` pairs a table with itself and returns each
    unordered pair once, a <= b. Keys are strings. Both sides are sized, and a piece is copied to
    each partner block, so the pieces meet by an equi-join on (keys, chunk, block, block) that
    spreads over as many tasks as there are block pairs.
    """
    joined = paired(left, right, dim, item, value, keys, upper, block, chunk)
    keys = list(keys)
    schema = ", ".join([*(f"{k} string" for k in keys), "a string", "b string", "s double"])

    def work(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                axis = np.unique(np.concatenate([*r["d"], *r["d2"]]))
                ai, a = _dense(r["i"], r["d"], r["v"], axis)
                bi, b = _dense(r["i2"], r["d2"], r["v2"], axis)
                if kernel == "dot":
                    s = a.T @ b
                else:
                    s = np.stack([(np.abs(a[:, [k]] - b) - np.abs(a[:, [k]]) - np.abs(b)).sum(0) for k in range(a.shape[1])])
                same = upper and r["_l"] == r["_r"]
                p, q = np.nonzero((s != 0) & (ai[:, None] <= bi[None, :]) if same else s != 0)
                left_name, right_name, val = ai[p], bi[q], s[p, q]
                if upper:
                    left_name, right_name = np.where(left_name <= right_name, left_name, right_name), np.where(left_name <= right_name, right_name, left_name)
                yield pd.DataFrame({**{k: r[k] for k in keys}, "a": left_name, "b": right_name, "s": val})

    return joined.mapInPandas(work, schema).groupBy(*keys, "a", "b").agg(F.sum("s").alias("s"))


def paired(left, right, dim, item, value, keys=(), upper=False, block=BLOCK, chunk=CHUNK) -> DataFrame:
    """The pieces of both sides that belong together, one row per (keys, chunk, block pair)."""
    keys = list(keys)
    sizes = [d.agg(F.approx_count_distinct(dim), F.approx_count_distinct(item)).first() for d in ((left,) if upper else (left, right))]
    n_chunks = max(1, -(-max(s[0] for s in sizes) // chunk))
    lb, rb = (max(1, -(-s[1] // block)) for s in (sizes[0], sizes[-1]))
    lp = _pack(left, dim, item, value, keys, n_chunks, lb, lambda b: (b if upper else 0, rb - 1), "", "left")
    rp = _pack(right, dim, item, value, keys, n_chunks, rb, lambda b: (0, b if upper else lb - 1), "2", "right")
    # a product costs far more than its bytes tell, so the partitions follow the number of block pairs
    pairs, on = n_chunks * lb * rb, [*keys, "_c", "_l", "_r"]
    n = min(pairs, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 8))
    return lp.repartition(n, *on).join(rp.repartition(n, *on), on).drop("_c")


def _pieces(df, dim, item, value, keys, n_chunks, n_blocks, tag, own):
    """One row per (keys, chunk, block): names ``i``, entries of each ``n``, hashes of the dims ``x``, and of the entries the place in ``x``,
    the value and (where there are any) the nulls, ``d``, ``v``, ``z``, as bytes."""
    keyed = df.where(F.col(dim).isNotNull()).select(
        *keys, F.xxhash64(F.col(dim).cast("string")).alias("_d"), F.col(item).cast("string").alias("_i"), F.col(value).cast("double").alias("_v"))
    keyed = keyed.withColumn("_c", F.pmod(F.xxhash64("_d"), F.lit(n_chunks)).cast("int")).withColumn("_b", F.pmod(F.xxhash64("_i"), F.lit(n_blocks)).cast("int"))
    rows = keyed.repartition(*keys, "_c", "_b").groupBy(*keys, "_c", "_b", "_i").agg(
        F.collect_list("_d").alias("d"), F.collect_list(F.coalesce("_v", F.lit(0.0))).alias("v"), F.collect_list(F.col("_v").isNull()).alias("z"))
    packed = rows.groupBy(*keys, "_c", "_b").agg(F.collect_list(F.struct("_i", "d", "v", "z")).alias("_e"))
    packed = packed.select(*keys, "_c", F.col("_b").alias(own), F.col("_e._i").alias(f"i{tag}"), F.transform("_e", lambda e: F.size(e["d"])).alias("n"),
                           *[F.flatten(F.col(f"_e.{f}")).alias(f) for f in "dvz"])
    kept = packed.columns[:-4]

    def pack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n, d, v, z = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in "ndvz")
                axis, place = np.unique(d, return_inverse=True)
                made = [n.astype(np.int32), axis, place.astype(_places(axis)), v, z if z.any() else z[:0]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in kept], *[pa.array([x.tobytes()], pa.binary()) for x in made]],
                                                 names=[*kept, *[f"{c}{tag}" for c in "nxdvz"]])

    kinds = ", ".join([f"{k} {packed.schema[k].dataType.simpleString()}" for k in kept] + [f"{c}{tag} binary" for c in "nxdvz"])
    return packed.mapInArrow(pack, kinds)


def _places(axis):
    return np.uint16 if len(axis) <= 1 << 16 else np.int32


def _matrix(row, tag, common, shared):
    """A piece as dense matrices over the dims that both pieces have: values, entries, entries that are not null, and what is not finite."""
    n, x, z = (np.frombuffer(row[f"{c}{tag}"].as_buffer(), t) for c, t in (("n", np.int32), ("x", np.int64), ("z", bool)))
    d, v = (np.frombuffer(row[f"{c}{tag}"].as_buffer(), t) for c, t in (("d", _places(x)), ("v", float)))
    to = np.full(len(x), -1)
    to[shared] = np.arange(len(common))
    dims, items = to[d], np.repeat(np.arange(len(n)), n)
    use = dims >= 0
    dims, items, v, z = dims[use], items[use], v[use], z[use] if len(z) else None
    odd = ~np.isfinite(v)
    shape = (len(common), len(n))
    m = [np.zeros(shape), np.zeros(shape, np.float32)]
    at = dims * shape[1] + items
    np.add.at(m[0].reshape(-1), at[~odd], v[~odd])
    m[1].reshape(-1)[at] = 1
    m.append(m[1])
    if z is not None and z.any():
        m[2] = np.zeros(shape, np.float32)
        m[2].reshape(-1)[at[~z]] = 1
    return m, (dims[odd], items[odd], v[odd])


def _product(row):
    """Of a left and a right piece: sums of products, whether a pair meets, and whether a product of it is not null (None: as it meets)."""
    axes = [np.frombuffer(row[c].as_buffer(), np.int64) for c in ("x", "x2")]
    common, *shared = np.intersect1d(*axes, assume_unique=True, return_indices=True)
    ((a, ap, an), a_odd), ((b, bp, bn), b_odd) = (_matrix(row, tag, common, at) for tag, at in zip(("", "2"), shared))
    rough = np.unique(np.concatenate([a_odd[0], b_odd[0]]))
    if len(rough):
        # a product with a value that is not finite is added where both sides are stored, not where one is absent
        for o, m in ((a_odd, a), (b_odd, b)):
            np.add.at(m, o[:2], o[2])
        keep = np.setdiff1d(np.arange(len(common)), rough)
        s = a[keep].T @ b[keep]
        for x in rough:
            p, q = np.nonzero(an[x])[0], np.nonzero(bn[x])[0]
            s[np.ix_(p, q)] += np.outer(a[x, p], b[x, q])
    else:
        s = a.T @ b
    return s, ap.T @ bp > 0, None if an is ap and bn is bp else an.T @ bn > 0


def sparse_product(left: DataFrame, right: DataFrame, dim, item, other, value="value", weight="weight", out="value", keys=()) -> DataFrame:
    """(item, other, out): sums over ``dim`` of value * weight, as a join on ``dim`` with a grouped sum gives them.

    ``left`` holds (keys, dim, item, value), ``right`` (keys, dim, other, weight). The joined rows are never formed: pieces of
    at most ``DIMS`` x ``ITEMS`` entries are multiplied in tasks. A pair is a row if it meets at all, also with sum 0; its sum
    is null if all its products are.

    Without keys each block of many is one partition, stored once: a task reads one block of either side, so no piece is
    copied, and adds up its chunks itself. With keys, or up to ``COPIED`` pairs of blocks, pieces are copied to their partner blocks and meet by an equi-join, and
    partial sums are shuffled.
    """
    keys = list(keys)

    def sized(df, name):
        per = df.groupBy(*keys).agg(F.approx_count_distinct(dim).alias("d"), F.approx_count_distinct(name).alias("i"))
        return [x or 0 for x in per.agg(F.max("d"), F.max("i"), F.count("*")).first()]

    (ld, li, lk), (rd, ri, rk) = sized(left, item), sized(right, other)
    n_chunks, lb, rb = max(1, -(-max(ld, rd) // DIMS)), max(1, -(-li // ITEMS)), max(1, -(-ri // ITEMS))
    lp = _pieces(left, dim, item, value, keys, n_chunks, lb, "", "_l")
    rp = _pieces(right, dim, other, weight, keys, n_chunks, rb, "2", "_r")
    crossed = not keys and lb * rb > COPIED
    if not crossed:
        lp, rp = (p.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) for p, c, n in ((lp, "_r", rb), (rp, "_l", lb)))
        pairs, on = n_chunks * lb * rb * max(1, min(lk, rk)), [*keys, "_c", "_l", "_r"]
        n = min(pairs, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 4))
        joined = lp.repartition(n, *on).join(rp.repartition(n, *on), on)
    else:
        joined = lp.repartitionById(lb, F.col("_l")).hint("shuffle_replicate_nl").join(rp.repartitionById(rb, F.col("_r")), "_c")
    joined = joined.select("_l", "_r", *[f"{c}{t}" for t in ("", "2") for c in "inxdvz"])
    whole = n_chunks == 1 or not crossed  # the product of two pieces is passed on as it is

    def rows(names, names2, s, met, some):
        for lo in range(0, len(s), 64):
            p, q = np.nonzero(met[lo:lo + 64])
            none = ~some[lo:lo + 64][p, q] if some is not None else None
            yield pa.RecordBatch.from_arrays([names.take(pa.array(p + lo)), names2.take(pa.array(q)), pa.array(s[lo:lo + 64][p, q], mask=none)], names=[item, other, out])

    def work(batches):
        blocks = {}  # a task has one pair of blocks
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                s, met, some = _product(row)
                if whole:
                    yield from rows(row["i"].values, row["i2"].values, s, met, some)
                    continue
                at = blocks.setdefault((row["_l"].as_py(), row["_r"].as_py()), [{}, {}, *(np.zeros((0, 0), t) for t in (float, bool, bool))])
                p, q = ([a.setdefault(x, len(a)) for x in row[c].values.to_pylist()] for a, c in zip(at, ("i", "i2")))
                more = [(0, len(a) - n) for a, n in zip(at, at[2].shape)]
                at[2:] = (np.pad(m, more) for m in at[2:])
                for m, x in zip(at[2:], (s, met, met if some is None else some)):
                    m[np.ix_(p, q)] += x
        for names, names2, s, met, some in blocks.values():
            yield from rows(pa.array(list(names), pa.string()), pa.array(list(names2), pa.string()), s, met, some)

    sums = joined.mapInArrow(work, f"{item} string, {other} string, {out} double")
    return sums if crossed or n_chunks == 1 and not keys else sums.groupBy(item, other).agg(F.sum(out).alias(out))


def knn(emb: DataFrame, k: int, ident="obs_id", vec="vec", block=16384, part=2048, tasks=64) -> DataFrame:
    """Exact k nearest neighbours by Euclidean distance: (obs_id, neighbor, dist, rn).

    Parts of ``part`` rows meet blocks of ``block`` rows, and a part keeps its own k best per row of ``GROUP`` blocks before
    anything is shuffled, so the n x n distances never leave a task. Parts and blocks are stored once: a task reads
    a slice of the parts and a group of the blocks. A product in single precision
    leaves the rows that lie within its rounding of the k-th; these are measured by differences.
    """
    n = emb.count()
    n_blocks, n_parts = max(1, -(-n // block)), max(1, -(-n // part))
    groups = -(-n_blocks // GROUP)
    slices = min(n_parts, max(1, -(-tasks // groups)))
    kind = emb.schema[vec].dataType.simpleString()
    e = emb.select(F.col(ident).cast("string").alias("i"), F.col(vec).cast(kind if kind == "array<float>" else "array<double>").alias("v"), F.xxhash64(ident).alias("h"))

    def packed(count):
        g = e.groupBy(F.pmod("h", F.lit(count)).cast("int").alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("e"))
        return g.select("b", F.col("e.i").alias("i"), F.flatten("e.v").alias("v"))

    left = packed(n_parts).select("i", "v", F.col("b").alias("p")).repartitionById(slices, F.pmod("p", F.lit(slices)))
    right = packed(n_blocks).select(F.col("i").alias("i2"), F.col("v").alias("v2"), "b").repartitionById(groups, F.pmod("b", F.lit(groups)))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right).select("p", "i", "v", "i2", "v2")

    def work(batches):
        at, found = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                p, row = batch.column("p")[r].as_py(), [batch.column(c)[r].values for c in ("i", "v", "i2", "v2")]
                if p != at and found:  # a part meets the blocks of its group one after the other
                    yield best(found)
                    found = []
                at = p
                found.extend(near(*row))
        if found:
            yield best(found)

    def best(found):
        ids, names = found[0][0], pa.concat_arrays([x[2] for x in found])
        at, dist = (np.concatenate([x[c] for x in found]) for c in (1, 3))
        order = np.lexsort((dist, at))
        rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        edge = np.full(len(ids), np.inf)  # the k-th least of each row that has as many
        edge[at[order][rank == k - 1]] = dist[order][rank == k - 1]
        keep = np.nonzero(dist <= edge[at])[0]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at[keep])), names.take(pa.array(keep)), pa.array(dist[keep])], names=["obs_id", "neighbor", "dist"])

    def near(ids, v, ids2, v2):
        a, b = (x.to_numpy().astype(float).reshape(len(y), -1) for x, y in ((v, ids), (v2, ids2)))
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        good, good2 = np.isfinite(aa), np.isfinite(bb)
        most = max(aa[good].max(initial=0), bb[good2].max(initial=0))
        kind = np.float32 if 1e-20 < most < 1e30 else float
        # |b|^2 - 2ab in one product; what is not finite is nobody's neighbour
        y = np.vstack([np.where(good2, b.T, 0), np.where(good2, bb, 0)]).astype(kind)
        slack = 4 * (a.shape[1] + 8) * np.finfo(kind).eps * (aa + 2 * most)
        place = {}
        for at, name in enumerate(ids2.to_pylist()):
            place.setdefault(name, []).append(at)
        names, m = ids.to_pylist(), min(k, len(b))
        groups = len(b) // 8 if len(b) // 8 >= 4 * k else 0
        for lo in range(0, len(a), 256):
            x = np.column_stack([np.where(good[lo:lo + 256, None], -2 * a[lo:lo + 256], 0), np.ones(len(a[lo:lo + 256]))]).astype(kind)
            d = x @ y
            d[:, ~good2] = np.inf
            d[~good[lo:lo + 256]] = np.inf
            for j, name in enumerate(names[lo:lo + 256]):
                if name in place:
                    d[j, place[name]] = np.inf
            # the k-th least of the least of disjoint groups is no less than the k-th least of all
            top = d[:, :groups * 8].reshape(len(d), 8, groups).min(1) if groups else d
            edge = np.partition(top, m - 1, axis=1)[:, m - 1] + slack[lo:lo + 256]
            p, q = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
            dist = np.sqrt(((b[q] - a[lo + p]) ** 2).sum(1))
            yield ids, lo + p, ids2.take(pa.array(q)), dist

    return top_k(pairs.mapInArrow(work, "obs_id string, neighbor string, dist double"), ["obs_id"], [F.col("dist"), F.col("neighbor")], k, ["neighbor"], out="rn")
