"""Exact top-k search by integer inner product with block-at-a-time pruning.

Rows are ordered by a code of random-projection signs and by their content, so near vectors and
copies lie next to each other, and cut into ranges: blocks of ``BLOCK`` rows in shards of ``SHARD``.
A block keeps the largest and smallest value of every term (component) and a forward index (its rows'
values). For a query, the sum over terms of weight times largest value, or smallest for a negative
weight, bounds all scores of a block. Blocks are taken in order of falling bounds and scored through
their forward indexes, in waves of doubling length, until the bounds fall below the k-th score.

1. Each shard searches for the queries it holds itself; the k-th score found is a query's threshold.
2. Pages of shard summaries are bounded against the queries; only (query, shard) pairs whose bound
   reaches the threshold go on, so a shard of far vectors is never read for a query.
3. The queries that are left visit the shards by a join; each visit returns at most k rows a query.

The order, blocks and thresholds change the cost, never the result. Scores are exact: values and
sums below 2**53 are multiplied as doubles, larger ones as Python integers without pruning.

Edge cases: rows with a null id, a null vector, or a null or non-finite component take no part;
vectors of different lengths are compared over the components both have; an empty vector scores 0; a
row never meets itself, but a repeated row meets its copies, each copy of a query being one; scores
beyond 64 bits saturate before they are ranked; an empty table gives no rows. Extra columns, whatever
their names, are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.stats import top_k
from netloom.session import cut

BLOCK, SHARD, QUERIES, PAGE = 64, 8192, 2048, 1024
PART_ROWS, LEAST_ROWS = 65_536, 4096
BITS = 16
EXACT = 2.0 ** 53
ROWS = "is_query boolean, shard long, dim int, ids binary, data binary, hi binary, lo binary, own_shard binary, own_row binary, score binary, after binary"
FOUND = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, is_query: Column, scale: int, ident="vec_id", vec="embedding") -> DataFrame:
    """(id, is_query, data, code): floor(scale * x) as doubles, with the sign code that orders rows."""
    def work(batches):
        for b in batches:
            v = b.column("v")
            size = pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(float))
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            ok = np.flatnonzero((bad[ends] == bad[ends - size]) & v.is_valid().to_numpy(zero_copy_only=False))
            plane = np.random.default_rng(0).standard_normal((max(size, default=0), BITS))
            code, data = [], []
            for k in ok.tolist():
                row = x[ends[k] - size[k]:ends[k]]
                with np.errstate(over="ignore", invalid="ignore"):
                    signs = (row @ plane[:len(row)]) > 0
                code.append(int(np.packbits(signs).view(">u2")[0]))
                data.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), b.column("is_query").take(pa.array(ok)), pa.array(data, pa.binary()), pa.array(code, pa.int32())],
                                             ["id", "is_query", "data", "code"])

    rows = vectors.select(F.col(ident).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vec).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").mapInArrow(work, "id long, is_query boolean, data binary, code int")


def _matrix(data: list) -> np.ndarray:
    out = np.zeros((len(data), max((len(d) // 8 for d in data), default=0)))
    for r, d in zip(out, data):
        r[:len(d) // 8] = np.frombuffer(d)
    return out


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


class Shard:
    """Blocks of consecutive rows: ids, forward index (matrix rows) and term maxima."""

    def __init__(self, ids, data, hi=None, lo=None):
        self.ids, self.data = ids, data
        self.cuts = range(0, len(ids), BLOCK)
        at = np.arange(0, len(ids), BLOCK)
        self.hi = np.maximum.reduceat(data, at) if hi is None else hi
        self.lo = np.minimum.reduceat(data, at) if lo is None else lo
        self.first = np.minimum.reduceat(ids, at)


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Largest score a block can hold, per query and block."""
    dim = max(q.shape[1], hi.shape[1])
    q = _wide(q, dim)
    return np.maximum(q, 0) @ _wide(hi, dim).T + np.minimum(q, 0) @ _wide(lo, dim).T


def _exact(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> bool:
    """Whether all sums of products stay in the whole numbers a double holds."""
    dim = max(q.shape[1], hi.shape[1])
    top = lambda m: np.abs(m).max(initial=0.0)
    return top(q) < EXACT and max(top(hi), top(lo)) < EXACT and top(q) * max(top(hi), top(lo)) * dim < EXACT


def _best(who, score, ids, k):
    """The k best (score, then least id) of each query, in order."""
    o = np.lexsort((ids, -score, who))
    who, score, ids = who[o], score[o], ids[o]
    start = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
    rank = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))
    return who[rank < k], score[rank < k], ids[rank < k]


def search(q, own, shard: Shard, k: int, floor, after):
    """Best rows of one shard: (query index, score, id), at most k a query.

    ``own`` is the row of the query in this shard or -1; scores below (``floor``, ``after``), a
    score and an id, are of no use.
    """
    dim = max(q.shape[1], shard.data.shape[1])
    q, x = _wide(q, dim), _wide(shard.data, dim)
    if not _exact(q, shard.hi, shard.lo):
        return _search_big(q, own, shard.ids, x, k)
    floor, after = floor.copy(), after.copy()
    bound = bounds(q, shard.hi, shard.lo)
    order = np.argsort(-bound, axis=1, kind="stable")
    who, score, ids = (np.zeros(0, t) for t in (np.int64, float, np.int64))
    at, width, n = 0, 1, len(shard.cuts)
    live = np.arange(len(q))
    while at < n and len(live):
        wave = order[live, at:at + width]
        b = bound[live[:, None], wave]
        use = (b > floor[live, None]) | ((b == floor[live, None]) & (shard.first[wave] <= after[live, None]))
        row, col = np.nonzero(use)
        block = wave[row, col]
        by = np.argsort(block, kind="stable")
        row, block = live[row[by]], block[by]
        new = [(who, score, ids)]
        for g in np.split(np.arange(len(block)), np.flatnonzero(block[1:] != block[:-1]) + 1) if len(block) else ():
            s, mine = int(block[g[0]]) * BLOCK, row[g]
            got = q[mine] @ x[s:s + BLOCK].T
            some = shard.ids[s:s + BLOCK]
            inside = np.flatnonzero((own[mine] >= s) & (own[mine] < s + len(some)))
            got[inside, own[mine[inside]] - s] = -np.inf
            i, j = np.nonzero((got > floor[mine, None]) | ((got == floor[mine, None]) & (some[None, :] <= after[mine, None]) & np.isfinite(got)))
            new.append((mine[i], got[i, j], some[j]))
        if len(new) > 1:
            who, score, ids = _best(*(np.concatenate(c) for c in zip(*new)), k)
            count = np.bincount(who, minlength=len(q))
            last = np.cumsum(count) - 1
            full = np.flatnonzero(count == k)
            floor[full], after[full] = score[last[full]], ids[last[full]]
        at += width
        width *= 2
        if at < n:
            live = live[bound[live, order[live, at]] >= floor[live]]
    return who, score, ids


def _search_big(q, own, ids, x, k):
    """As ``search``, with Python integers and without bounds."""
    rows = [[int(v) for v in r] for r in x]
    out = ([], [], [])
    for n, r in enumerate(q):
        r = [int(v) for v in r]
        got = [(-min(max(sum(a * b for a, b in zip(r, y)), -2 ** 63), 2 ** 63 - 1), i) for m, (y, i) in enumerate(zip(rows, ids.tolist())) if m != own[n]]
        for s, i in sorted(got)[:k]:
            out[0].append(n), out[1].append(-s), out[2].append(i)
    return np.array(out[0], np.int64), np.array(out[1], object), np.array(out[2], np.int64)


def _index(rows: DataFrame, k: int) -> DataFrame:
    """Shards with their blocks, and queries with the threshold that their own shard gives."""
    n = rows.count()
    parts = max(1, -(-n // PART_ROWS), min(-(-n // LEAST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))
    keys = ["code", "_hash", "id"]

    def work(batches):
        part, seq = TaskContext.get().partitionId() << 24, 0
        held = ([], [], [])
        asked = ([], [], [], [], [], [])

        def close():
            nonlocal seq
            ids, data = np.array(held[0], np.int64), _matrix(held[2])
            shard, name = Shard(ids, data), part + seq
            at = np.flatnonzero(held[1])
            if len(at):
                q, floor, after = data[at], np.full(len(at), -np.inf), np.full(len(at), 2 ** 63 - 1)
                who, score, found = search(q, at, shard, k, floor, after)
                count = np.bincount(who, minlength=len(at))
                if score.dtype == float:
                    last = np.cumsum(count) - 1
                    full = np.flatnonzero(count == k)
                    floor[full], after[full] = score[last[full]], found[last[full]]
                for c, v in zip(asked, (ids[at], q, np.full(len(at), name), at, floor, after)):
                    c.append(v)
            seq += 1
            for c in held:
                c.clear()
            return (False, name, data.shape[1], ids.tobytes(), data.tobytes(), shard.hi.tobytes(), shard.lo.tobytes(), None, None, None, None)

        def ask():
            ids, qs, name, at, floor, after = asked
            dim = max(m.shape[1] for m in qs)
            q = np.concatenate([_wide(m, dim) for m in qs])
            ids, name, at, floor, after = (np.concatenate(c) for c in (ids, name, at, floor, after))
            for c in asked:
                c.clear()
            for s in range(0, len(q), QUERIES):
                e = slice(s, s + QUERIES)
                yield (True, int(name[s]), dim, ids[e].tobytes(), q[e].tobytes(), None, None, name[e].astype("<i8").tobytes(), at[e].astype("<i8").tobytes(),
                       floor[e].tobytes(), after[e].astype("<i8").tobytes())

        for b in batches:
            for i, is_q, d in zip(b.column("id").to_pylist(), b.column("is_query").to_pylist(), b.column("data").to_pylist()):
                held[0].append(i), held[1].append(is_q), held[2].append(d)
                if len(held[0]) == SHARD:
                    yield _batch([close()])
                    if sum(map(len, asked[0])) >= QUERIES:
                        yield _batch(ask())
        if held[0]:
            yield _batch([close()])
        if asked[0]:
            yield _batch(ask())

    ranged = rows.withColumn("_hash", F.xxhash64("data")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return cut(ranged.select("id", "is_query", "data").mapInArrow(work, ROWS), "search-index")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int64(), pa.int32()] + [pa.binary()] * 8
    names = [f.split()[0] for f in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _array(data, kind=float, dim=None):
    a = np.frombuffer(data, kind)
    return a if dim is None else a.reshape(-1, dim) if dim else np.zeros((len(a), 0))


def top(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, ident="vec_id", vec="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every query row; ties go to the smaller id."""
    index = _index(cut(quantised(vectors, is_query, scale, ident, vec), "quantised"), k)
    queries, shards = index.where("is_query"), index.where("not is_query")
    pages = max(1, -(-shards.count() // PAGE))
    summary = shards.select(F.pmod(F.xxhash64("shard"), F.lit(pages)).cast("int").alias("page"), "shard", "dim", "hi", "lo")

    def shard_bounds(batches):
        """Largest and smallest value of every term of a shard."""
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("hi", "lo", "dim")]
            hi = [_array(h, float, d).max(0).tobytes() if d else b"" for h, _, d in zip(*cols)]
            lo = [_array(x, float, d).min(0).tobytes() if d else b"" for _, x, d in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("shard"), pa.array(hi, pa.binary()), pa.array(lo, pa.binary())], ["page", "shard", "hi", "lo"])

    summary = summary.mapInArrow(shard_bounds, "page int, shard long, hi binary, lo binary")
    summary = summary.groupBy("page").agg(F.collect_list(F.struct("shard", "hi", "lo")).alias("of"))
    fields = ["dim", "ids", "data", "own_shard", "own_row", "score", "after"]
    asked = queries.select(*fields, F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")).join(summary, "page")

    def visits(batches):
        """Queries that a shard may still serve, one row per shard."""
        for b in batches:
            for r in b.to_pylist():
                q, floor = _array(r["data"], float, r["dim"]), _array(r["score"])
                q = q if r["dim"] else np.zeros((len(floor), 0))
                hi, lo = _matrix([s["hi"] for s in r["of"]]), _matrix([s["lo"] for s in r["of"]])
                may = bounds(q, hi, lo) >= floor[:, None] if _exact(q, hi, lo) else np.ones((len(q), len(hi)), bool)
                out = []
                for n, s in enumerate(r["of"]):
                    keep = np.flatnonzero(may[:, n])
                    if len(keep):
                        out.append((s["shard"], r["dim"], q[keep].tobytes(), *(_array(r[c], np.int64)[keep].tobytes() for c in ("ids", "own_shard", "own_row", "after")), floor[keep].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32()] + [pa.binary()] * 6)],
                                                     ["shard", "q_dim", "q", "q_ids", "own_shard", "own_row", "after", "floor"])

    left = asked.mapInArrow(visits, "shard long, q_dim int, q binary, q_ids binary, own_shard binary, own_row binary, after binary, floor binary")
    met = left.join(shards.select("shard", "dim", "ids", "data", "hi", "lo"), "shard")

    def score(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, floor = _array(r["ids"], np.int64), _array(r["floor"])
                data = _array(r["data"], float, r["dim"]) if r["dim"] else np.zeros((len(ids), 0))
                q = _array(r["q"], float, r["q_dim"]) if r["q_dim"] else np.zeros((len(floor), 0))
                hi, lo = (_array(r[c], float, r["dim"]) if r["dim"] else None for c in ("hi", "lo"))  # as many blocks as the index was cut into
                own_shard, own_row, after, q_ids = (_array(r[c], np.int64) for c in ("own_shard", "own_row", "after", "q_ids"))
                own = np.where(own_shard == r["shard"], own_row, -1)
                who, got, found = search(q, own, Shard(ids, data, hi, lo), k, floor, after)
                key = own_shard * (2 * SHARD) + own_row
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(key[who]), pa.array(found), pa.array(np.array([int(x) for x in got], np.int64))],
                                                 ["query_id", "query_key", "vec_id", "score"])

    found = met.mapInArrow(score, FOUND)
    best = top_k(found, ["query_id", "query_key"], [F.col("score").desc(), F.col("vec_id")], k, ["vec_id"], out="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
