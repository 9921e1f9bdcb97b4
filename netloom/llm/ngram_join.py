"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal sets are
one node. Candidates come from prefixes: a pair whose similarity reaches t shares one of the first
n - ceil(t n) + 1 n-grams of each set in any fixed order. The order puts n-grams that are frequent in
a sample of the documents last; the sample steers cost alone, every order gives the same links.

Nodes that share a prefix n-gram form tiles of at most ``TILE`` nodes and ``TILE_WEIGHT`` n-grams, cut in
order of set size, and only nodes within the size band of each other are compared. Their bitmaps (one bit per n-gram, about two
bits of room for each) bound the overlap from above: n-grams of one set whose bit the other lacks
cannot be shared. Pairs that survive join tiles that go on to the exact step, where sorted arrays are
intersected; pairs already connected inside a tile are skipped, as components ask only whether
documents are connected. Tiles with the same members are compared once.

N-grams with more nodes than a tile holds are first compared in runs of like size. When the components
of the links found are known, the n-grams that still hold nodes of several components are compared in
full: in bands of set size, dealt to blocks that meet the blocks of their own band and of the two
beside it, except inside components. So a large group of near copies costs about as much as its size,
sets too unlike in size never meet, and nothing is dropped.

Edge cases: null, empty or blank text has the empty set, is linked with nothing and is its own
component; texts of fewer words than n are one n-gram; null ids are judged like others, and
component ids ignore them unless a component has no other; repeated rows share a component; an empty
table gives no rows; extra columns, whatever their names, are not read.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import LOWER, Cache, raw, trim
from netloom.llm.graph import components
from netloom.session import cut

N, PERCENT, TILE, MAX_BROADCAST = 4, 85, 512, 2_000_000
TILE_WEIGHT = 4_000_000  # n-grams of a tile: 32 MB of sorted arrays, unless a single set is longer
SAMPLE, FREQUENT, MAX_FREQUENT = 5_000, 5, 1_000_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: bytes, codes: Cache, n=N) -> np.ndarray:
    """Sorted distinct hashes (int64) of the word n-grams."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64).view(np.int64)
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    m = len(h) - n + 1
    s = np.zeros(m, np.uint64)
    for k in range(n):
        s = (s ^ (s >> np.uint64(29))) * ODD[k % len(ODD)] + h[k:k + m]
    return np.unique(s.view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    bits = min(max(256, 1 << int(2 * len(s) - 1).bit_length()), 1 << 16)
    b = np.zeros(bits, np.uint8)
    b[s & (bits - 1)] = 1
    return np.packbits(b).tobytes()


def _codes():
    return Cache(xxhash.xxh3_64_intdigest)


def prefix(s: np.ndarray, frequent: np.ndarray, percent=PERCENT) -> np.ndarray:
    """The first n - ceil(t n) + 1 n-grams, frequent ones last."""
    p = len(s) - -(-percent * len(s) // 100) + 1
    if not len(frequent):
        return s[:p]
    hot = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~hot], s[hot]])[:p]


def frequent(docs: DataFrame, text_col="text", n=N, sample=SAMPLE, least=FREQUENT, most=MAX_FREQUENT) -> np.ndarray:
    """N-grams that occur in at least ``least`` of the sampled texts, at most ``most``: sorted. Steers the order alone."""
    total = docs.count()
    share = min(1.0, max(sample, total // 100) / max(total, 1))

    def work(batches):
        codes = _codes()
        for b in batches:
            got = [shingles(t, codes, n) for t in raw(b, text_col)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.empty(0, np.int64))], ["s"])

    picked = docs.select(text_col).where(F.xxhash64(text_col, F.lit(3)) / 2.0 ** 64 + 0.5 < share).distinct()
    top = picked.mapInArrow(work, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    rows = top.orderBy(F.desc("c"), "s").limit(most).select("s").toArrow()
    return np.sort(rows.column(0).to_numpy())


def nodes(docs: DataFrame, hot: np.ndarray, n=N, percent=PERCENT, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n, node, text_key, bits, pre), written once: everything but the sets themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        trim()
        codes, order = _codes(), shared.value
        for b in batches:
            size, node, bits, pre = [], [], [], []
            for t in raw(b, text_col):
                s = shingles(t, codes, n)
                size.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
                pre.append(prefix(s, order, percent) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), b.column("key"),
                                              pa.array(bits, pa.binary()), pa.array(pre, pa.list_(pa.int64()))], ["id", "n", "node", "key", "bits", "pre"])

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("key"), text_col)
    return cut(src.mapInArrow(work, "id long, n long, node long, key long, bits binary, pre array<long>"), "nodes")


def _runs(batches, key):
    """Slices of batches sorted by ``key``: (value, {column: array}) with all rows of a value together."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(edges, edges[1:]):
            part = b.slice(s, e - s)
            if held and held[0].column(key)[0].as_py() != k[s]:
                yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)


class _Rows:
    """Collects rows of fixed integer columns and gives batches of them."""

    def __init__(self, names, size=50_000):
        self.names, self.size, self.parts, self.count = names, size, [], 0

    def add(self, *cols):
        self.parts.append(cols)
        self.count += max(len(c) if hasattr(c, "__len__") else 1 for c in cols)

    def batch(self):
        out = []
        for cols in zip(*self.parts):
            out.append(np.concatenate([np.atleast_1d(np.asarray(c, np.int64)) for c in cols]) if cols else np.empty(0, np.int64))
        self.parts, self.count = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], self.names)


def _tile_id(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.sort(members).tobytes()) - (1 << 63)


def tiles(reps: DataFrame, tile=TILE, weight=TILE_WEIGHT) -> DataFrame:
    """(kind, tile, node, n): kind 0, tiles of nodes that share a prefix n-gram, runs in order of set size ``n``
    of at most ``tile`` nodes and ``weight`` n-grams; kind 1, the n-gram's nodes where one tile was not enough."""

    def work(batches):
        trim()
        out, seen = _Rows(["kind", "tile", "node", "n"]), set()
        tok, full, none = None, False, np.empty(0, np.int64)
        pend, size = none, none

        def emit(members, sizes):
            if len(members) > 1:
                i = _tile_id(members)
                if i not in seen:  # the same members again: compared once
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(i)
                    out.add(np.zeros(len(members)), np.full(len(members), i), members, sizes)

        def shift(last):
            """Emits full tiles, with ``last`` the rest as well."""
            nonlocal pend, size, full
            while len(pend):
                most = max(1, min(tile, int(np.searchsorted(np.cumsum(size), weight, "right"))))
                if most >= len(pend) and not last:
                    return
                full = full or most < len(pend)
                emit(pend[:most], size[:most])
                if full:
                    out.add(np.ones(len(pend[:most])), np.full(len(pend[:most]), tok), pend[:most], size[:most])
                pend, size = pend[most:], size[most:]

        for b in batches:
            t, node, n = b.column("tok").to_numpy(), b.column("node").to_numpy(), b.column("n").to_numpy()
            if not len(t):
                continue
            start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            end = np.r_[start[1:], len(t)]
            last = len(start) - 1
            go = np.flatnonzero((end - start > 1) | (np.arange(len(start)) == 0) | (np.arange(len(start)) == last))  # lone rows inside a batch are done
            for k in go.tolist():
                s, e = start[k], end[k]
                if t[s] != tok:
                    shift(True)
                    tok, full, pend, size = int(t[s]), False, none, none
                pend, size = np.concatenate([pend, node[s:e]]), np.concatenate([size, n[s:e]])
                shift(False)
            if out.count > out.size:
                yield out.batch()
        shift(True)
        if out.parts:
            yield out.batch()

    rows = reps.select(F.explode("pre").alias("tok"), "node", F.col("n").cast("bigint").alias("n"))
    dealt = rows.repartition("tok").sortWithinPartitions("tok", "n", F.xxhash64("tok", "node"))
    return cut(dealt.mapInArrow(work, "kind long, tile long, node long, n long"), "tiles")


def _find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _fold(bits: np.ndarray, to: int) -> np.ndarray:
    while len(bits) > to:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def bounded_groups(n, bits, comp, percent=PERCENT):
    """Sets of rows connected by pairs whose bitmaps allow the similarity; ``comp``: pairs of one component are skipped."""
    order = np.argsort(n, kind="stable")
    n, comp = n[order], comp[order]
    maps = [np.frombuffer(bits[k], np.uint8) for k in order]
    size = np.array([len(m) for m in maps])
    parent = list(range(len(n)))
    for width in np.unique(size):
        # rows of this width, and wider ones folded to it, as far as the size band reaches
        lo = int(np.flatnonzero(size == width)[0])
        hi = int(np.flatnonzero(size == width)[-1]) + 1
        top = int(np.searchsorted(n, n[hi - 1] * 100 // percent, "right"))
        m = np.stack([_fold(x, width) for x in maps[lo:top]])
        m = np.pad(m, ((0, 0), (0, -m.shape[1] % 8))).view(np.uint64)
        for i in range(lo, hi):
            end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            if end <= i + 1:
                continue
            a, b = m[i - lo], m[i + 1 - lo:end - lo]
            only_a = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
            only_b = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
            most = np.minimum(n[i] - only_a, n[i + 1:end] - only_b)
            ok = (100 * most >= percent * (n[i] + n[i + 1:end] - most)) & (comp[i + 1:end] != comp[i])
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                x, y = _find(parent, i), _find(parent, j)
                parent[max(x, y)] = min(x, y)
    root = np.array([_find(parent, i) for i in range(len(n))])
    return [order[root == r] for r in np.unique(root) if (root == r).sum() > 1]


def _bounded(tile_rows: DataFrame, reps: DataFrame, percent=PERCENT) -> DataFrame:
    """(tile, node, comp) rows -> smaller tiles of rows that bitmaps connect."""

    def work(batches):
        trim()
        out = _Rows(["tile", "node", "comp"])
        for _, t in _runs(batches, "tile"):
            node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
            if len(node) < 2:
                continue
            for g in bounded_groups(t.column("n").to_numpy(), t.column("bits").to_pylist(), comp, percent):
                out.add(np.full(len(g), _tile_id(node[g])), node[g], comp[g])
            if out.count > out.size:
                yield out.batch()
        if out.parts:
            yield out.batch()

    joined = tile_rows.join(reps.select("node", "n", "bits"), "node").select("tile", "node", "comp", "n", "bits")
    got = joined.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(work, "tile long, node long, comp long")
    return got.distinct()


def links_in(node, sets, comp, percent=PERCENT):
    """Pairs that link, enough to connect what is connected: (a, b)."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable").tolist()
    parent, a, b = list(range(len(n))), [], []
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if 100 * n[i] < percent * n[j]:
                break
            if comp[i] == comp[j]:
                continue
            p, q = _find(parent, i), _find(parent, j)
            if p == q:
                continue
            s, t = sets[i], sets[j]
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[max(p, q)] = min(p, q)
                a.append(node[i]), b.append(node[j])
    return a, b


def _exact(docs, tile_rows: DataFrame, reps: DataFrame, n=N, percent=PERCENT, text_col="text") -> DataFrame:
    """Links (u, v) among the nodes of each tile; the sets of these nodes alone are made again from their texts."""
    tile_rows = cut(tile_rows, "pairs")
    wanted = tile_rows.select("node").distinct().join(reps.select("node", F.col("tkey").alias("key")), "node").select("key")
    wanted = cut(wanted, "wanted")
    small = wanted.count() <= MAX_BROADCAST

    def make(batches):
        trim()
        codes, seen = _codes(), set()
        for b in batches:
            node, sets = [], []
            for k, t in zip(b.column("key").to_pylist(), raw(b, text_col)):
                if k in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                s = shingles(t, codes, n)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"])

    src = docs.select(F.xxhash64(text_col).alias("key"), text_col)
    sets = src.join(F.broadcast(wanted) if small else wanted, "key", "left_semi").mapInArrow(make, "node long, s binary").dropDuplicates(["node"])

    def work(batches):
        trim()
        out = _Rows(["u", "v"])
        for _, t in _runs(batches, "tile"):
            if t.num_rows < 2:
                continue
            arrays = [np.frombuffer(x, np.int64) for x in t.column("s").to_pylist()]
            a, b = links_in(t.column("node").to_numpy(), arrays, t.column("comp").to_numpy(), percent)
            if a:
                out.add(np.array(a), np.array(b))
            if out.count > out.size:
                yield out.batch()
        if out.parts:
            yield out.batch()

    return tile_rows.join(sets, "node").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(work, "u long, v long")


def _rest(big: DataFrame, comp: DataFrame, tile=TILE, percent=PERCENT, weight=TILE_WEIGHT) -> DataFrame:
    """Tiles for n-grams whose nodes are still of several components.

    Linked sets differ in size by the threshold at most, so with size bands of that ratio they lie in
    one band or in two beside each other. A band's nodes are dealt to blocks of half a tile, in nodes
    and in n-grams; a block meets the blocks of its own band and of the two beside it.
    """
    rows = big.select(F.col("tile").alias("tok"), "node", "n").distinct().join(comp, "node", "left").select("tok", "node", "n", F.coalesce("root", "node").alias("comp"))
    per = rows.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-6))).cast("int")
    rows = rows.join(per, "tok").withColumn("band", band)
    size = rows.groupBy("tok", "band").agg(F.greatest(F.ceil(F.count("*") / (tile // 2)), F.ceil(F.sum("n") / (weight // 2))).cast("int").alias("own"))
    beside = lambda by, name: size.select("tok", (F.col("band") + by).alias("band"), F.col("own").alias(name))
    size = cut(size.join(beside(1, "below"), ["tok", "band"], "left").join(beside(-1, "above"), ["tok", "band"], "left"), "bands")
    rows = rows.join(size, ["tok", "band"]).withColumn("b", F.pmod(F.xxhash64("node", F.lit(5)), F.col("own")).cast("int"))
    block = F.col("b")

    def met(number, lower, left, right):
        """Tiles with each of ``number`` blocks; named by the lower band and both blocks' numbers."""
        run = F.when(F.col(number) > 0, F.sequence(F.lit(0), F.col(number) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(run, lambda o: F.struct(F.lit(number == "own").alias("same"), lower.alias("band"), left(o).alias("i"), right(o).alias("j")))

    at = F.concat(met("own", F.col("band"), lambda o: F.least(block, o), lambda o: F.greatest(block, o)),
                  met("above", F.col("band"), lambda o: block, lambda o: o), met("below", F.col("band") - 1, lambda o: o, lambda o: block))
    return rows.withColumn("x", F.explode(at)).select(F.xxhash64("tok", "x.same", "x.band", "x.i", "x.j").alias("tile"), "node", "comp")


def joined(docs: DataFrame, n=N, percent=PERCENT, id_col="doc_id", text_col="text", tile=TILE, sample=SAMPLE) -> DataFrame:
    """(id, n_shingles, component_id) of every document; documents link at ``percent`` % Jaccard similarity of their n-gram sets."""
    docs = docs.select(id_col, text_col)
    all_nodes = nodes(docs, frequent(docs, text_col, n, sample), n, percent, id_col, text_col)
    full = all_nodes.where("n > 0")
    # rows of a node are equal but for their ids: one partial aggregate per task, whatever the size of a group
    reps = cut(full.groupBy("node").agg(F.min("id").alias("low"), F.min("key").alias("tkey"), F.first("n").alias("n"), F.first("bits").alias("bits"),
                                        F.first("pre").alias("pre")), "reps")
    t = tiles(reps, tile)
    first = t.where("kind = 0").select("tile", "node", F.col("node").alias("comp")).distinct()
    edges = cut(_exact(docs, _bounded(first, reps, percent), reps, n, percent, text_col), "links")
    big = t.where("kind = 1")
    comp = components(edges)
    if not big.isEmpty():
        more = _exact(docs, _bounded(_rest(big, comp, tile, percent), reps, percent), reps, n, percent, text_col)
        comp = components(edges.union(cut(more, "links")))
    label = reps.select("node", "low").join(comp, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = label.groupBy("root").agg(F.min("low").alias("component_id"))
    label = label.join(least, "root").select("node", "component_id")
    return (all_nodes.select("id", "n", "node").join(label, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")))
