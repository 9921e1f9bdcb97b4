import math
import random
from collections import Counter
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import filter_audit as A, merkle as M, queries, topk_search as T
from netloom.llm.common import crc_mod
from tests.llm.helpers import DOCS, SF, docs, rows


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert got.columns == [d[0] for d in cur.description]
    assert Counter(rows(got)) == Counter(cur.fetchall())


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_topk_search"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)


# --- filter audit ----------------------------------------------------------------------------

def failures(text, later):
    words = text.encode().split()
    upper = sum("A" <= c <= "Z" for c in text)
    return {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text),
                                        bool(set(text) & set("#$%&*|")), later)) if x}


def brute_audit(table, labels):
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t, *_ in table:
        least[t or ""] = min(least.get(t or "", math.inf), key(i))
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    docs_ = [(lang or "", failures(t or "", key(i) > least[t or ""]), i in good, i in toxic) for i, t, lang, *_ in table]
    out = {}
    for part in {d[0] for d in docs_}:
        mine = [d[1:] for d in docs_ if d[0] == part]
        shap = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for s, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shap[f] += len(gone)
                out[part, "".join(order), s + 1] = [len(left), len(gone), sum(f in d[0] for d in mine) - len(gone), sum(d[0] == {f} for d in mine),
                                                   sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shap[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force_on_awkward_rows(spark):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, 1), (3, 1, 1), (None, 1, 1), (99, 1, 1)]
    got = A.audit(docs(spark, "part", "mask"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {tuple(r[:3]): tuple(r[3:]) for r in rows(got)}
    assert got == brute_audit(DOCS, [x for x in labels if x[0] is not None]) and len(got) == 3 * 600


def test_audit_counters_do_not_overflow_and_empty_tables_have_no_rows(spark):
    c = A.Counters(5)
    got = c.unpack(c.packed[31] * (2 ** 62) + c.packed[0] * 5)
    assert got["kept"].tolist() == [5] * 600 and got["removed"].sum() == 120 * 2 ** 62 and set(got["redundant"].tolist()) == {0, 2 ** 62}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs(spark, rows=[]), labels).count() == 0


# --- Merkle manifest -------------------------------------------------------------------------

def h(text):
    return sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root, and the list of (before, after) of each leaf, level by level."""
    nodes, at, path = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            s = p // 3 * 3
            path[k].append(("".join(nodes[s:p]), "".join(nodes[p + 1:s + 3])))
            at[k] = p // 3
        nodes = [h("".join(nodes[s:s + 3])) for s in range(0, len(nodes), 3)]
    return nodes[0], path


def brute_manifest(table):
    leaf = lambda r, t: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in table:
        odd = r[0] is not None and r[1] is not None and crc32(str(r[0]).encode()) % 2 == 0
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if odd else r[1]), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, tops = brute_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for x, path in zip(sorted(groups[s]), trees[s][1]):
            path, now = path + top, x[3]
            for a, b in path:
                now = h(a + now + b)
            out.append((x[4], x[2], trees[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return out


def manifest(df):
    return M.verified(M.manifest(df, F.col("doc_id").isNotNull() & (crc_mod("doc_id", 2) == 0)))


@pytest.mark.parametrize("small", [True, False])
def test_manifest_equals_brute_force_on_awkward_rows(spark, small, monkeypatch):
    if not small:  # every ancestor is joined by shuffle, every sorted part is short
        monkeypatch.setattr(M, "MAX_BROADCAST", 0)
        monkeypatch.setattr(M, "PART_ROWS", 7)
    rng = random.Random(1)
    table = [(*r[:3], None, *r[4:]) for r in DOCS]
    for source, n in (("a", 1), ("b", 2), ("B", 3), ("é", 4), ("", 28), ("big", 95)):
        table += [(rng.randrange(10 ** 6), rng.choice(["x\ny", "", None, "p\n\nq"]), None, source, k, "c", 0.0) for k in range(n)]
    table += [table[-1], table[-2]]  # whole rows that stand twice
    got = rows(manifest(docs(spark, "leaf", "path", table)))
    assert Counter(got) == Counter(brute_manifest(table))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = rows(manifest(docs(spark, rows=[(1, "a\nb", "en", "s", 3, "c", 0.0)])))
    assert one == brute_manifest([(1, "a\nb", "en", "s", 3)]) and one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")
    assert manifest(docs(spark, rows=[])).count() == 0


# --- top-k search ----------------------------------------------------------------------------

def brute_top(vectors, k=5, scale=256):
    ok = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v, *_) in enumerate(vectors)
          if i is not None and v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = Counter()
    for n, i, q in ok:
        if i % 50 == 0:
            got = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -2 ** 63), 2 ** 63 - 1), j) for m, j, v in ok if m != n)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(got))
    return out


def top(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int, shard string")
    return Counter(rows(T.top(df, F.col("vec_id") % 50 == 0)))


def small_blocks(monkeypatch):
    for name, v in (("BLOCK", 4), ("SHARD", 32), ("QUERIES", 2), ("PAGE", 2), ("PART_ROWS", 70), ("LEAST_ROWS", 50)):
        monkeypatch.setattr(T, name, v)


def test_search_equals_brute_force_on_awkward_rows(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 6))
    x = [(k, (centre[k % 5] + 0.1 * rng.standard_normal(6)).tolist(), 0, "s") for k in range(0, 300)]
    x += [(k, [0.5] * 6, 0, "s") for k in range(1000, 1130)]  # copies: ties go to the smaller id
    x += [(50, None, 0, "s"), (2000, [1.0, None], 0, "s"), (2050, [math.nan], 0, "s"), (2100, [math.inf], 0, "s"), (2150, [], 0, "s"), (None, [1.0] * 6, 0, "s"),
          (2200, [-3.0, 2.0], 0, "s"), (2250, [1e-9, -1e-9], 0, "s"), x[100], x[0]]
    assert top(spark, x) == brute_top(x)


def test_search_of_large_values_short_and_empty_tables(spark, monkeypatch):
    small_blocks(monkeypatch)
    x = [(k, [1e12 * (k % 7), -3e11 * k, 1.0], 0, "s") for k in range(120)] + [(200, [1e300, 1.0], 0, "s")]
    assert top(spark, x) == brute_top(x)
    assert top(spark, [(0, [1.0], 0, "s")]) == Counter() and top(spark, []) == Counter()
    assert top(spark, [(0, [1.0], 0, "s"), (1, [2.0], 0, "s")]) == Counter({(0, 1, 1, 256 * 512): 1})


def test_search_leaves_far_blocks_unread():
    rng = np.random.default_rng(0)
    centre = np.eye(16)[np.arange(2048) // 128] * 1000
    x = np.floor(centre + rng.standard_normal(centre.shape))
    shard, read = T.Shard(np.arange(2048), x), []

    class Seen(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, slice):
                read.append(k.start)
            return np.asarray(self)[k]

    shard.data = x.view(Seen)
    who, score, ids = T.search(x[:1], np.array([0]), shard, 5, np.array([-np.inf]), np.array([2 ** 63 - 1]))
    want = np.lexsort((np.arange(1, 2048), -(x[1:] @ x[0])))[:5] + 1
    assert ids.tolist() == want.tolist() and len(set(read)) <= 3 < len(shard.cuts)
