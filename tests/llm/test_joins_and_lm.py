import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import graph, katz_lm as L, ngram_join as J, queries, spot_signatures as P
from netloom.llm.common import crc_mod, table
from tests.llm.helpers import DOCS, SF, docs, rows, words


def linked(data, n=4, percent=85):
    """(id, text) rows -> sorted (id, set size, smallest id reachable)."""
    sets = []
    for _, t in data:
        w = words(t)
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)))
    group = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    low = {}
    for (i, _), g in zip(data, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return sorted(((i, len(s), low.get(g) if s else i) for (i, _), g, s in zip(data, group, sets)), key=repr)


def near_copies(seed, n=220):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice((30, 90, 150)))] for _ in range(4)]
    shared = "this passage stands in many of the documents word for word and tells them nothing new at all".split()
    out = []
    for k in range(n):
        w = [x if rng.random() > 0.004 * (k % 6) else f"z{rng.randint(0, 999)}" for x in base[k % 4]] if k % 3 else [f"q{rng.randint(0, 9999)}" for _ in range(60)]
        out.append((k, " ".join(w + shared * (k % 5 == 0)).upper() if k % 7 == 0 else " ".join(w + shared * (k % 5 == 0))))
    return out


@pytest.mark.parametrize("tile", [512, 16])
def test_join_equals_brute_force(spark, tile):
    data = near_copies(tile) + [(1000 + k, t) for k, (_, t, *_) in enumerate(DOCS) if t is None or len(t) < 9000]
    x = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(rows(J.joined(x, tile=tile)), key=repr) == linked(data)


def test_rest_of_a_frequent_ngram_stays_within_size_bands(spark):
    n = [int(10 * 1.0005 ** k) for k in range(20_000)]  # 10 to 220,000 n-grams
    big = spark.createDataFrame([(7, k, s) for k, s in enumerate(n)], "tile long, node long, n long")
    none = spark.createDataFrame([], "node long, root long")
    got = J._rest(big, none, 512, 85, 10 ** 9).select("tile", "node").toPandas()
    assert len(got) <= 20_000 * 9  # about 330 nodes a band, in two blocks: no block meets all others
    tiles = got.groupby("node")["tile"].agg(set)
    rng = random.Random(3)
    for _ in range(3000):
        a = rng.randrange(20_000)
        b = rng.randrange(20_000) if rng.random() < .3 else min(19_999, a + rng.randrange(330))
        if min(n[a], n[b]) * 100 >= 85 * max(n[a], n[b]):
            assert tiles[a] & tiles[b]
    assert got.groupby("tile").size().max() <= 700


@pytest.mark.parametrize("weight", [300, 40])
def test_tiles_are_bounded_in_ngrams(spark, weight, monkeypatch):
    data = near_copies(weight, 160)
    x = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(J, "TILE_WEIGHT", weight)
    monkeypatch.setattr(J.tiles, "__defaults__", (J.TILE, weight))
    monkeypatch.setattr(J._rest, "__defaults__", (J.TILE, J.PERCENT, weight))
    assert sorted(rows(J.joined(x)), key=repr) == linked(data)


def test_join_edge_cases(spark):
    got = rows(J.joined(docs(spark, "node", "n")))
    small = [(i, t) for i, t, *_ in DOCS if t is None or len(t) < 9000]
    want = linked(small)
    big = [r for r in got if r[1] > 20_000]
    assert len(big) == 2 and big[0][2] == big[1][2] == min(d[0] for d in DOCS if d[1] and len(d[1]) > 9000 and d[0] is not None)
    assert sorted((r for r in got if r[1] <= 20_000), key=repr) == want
    assert J.joined(docs(spark, rows=[])).count() == 0


def test_join_on_the_table(spark):
    data = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(rows(queries.op8_ngram_join(spark, SF)), key=repr) == linked(data)


def test_bitmaps_never_reject_a_link():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (3, 40, 600, 5000):
        s = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        t = s.copy()
        t[: max(1, n // 14)] = rng.integers(-1 << 62, 1 << 62, max(1, n // 14))
        t = np.unique(t)
        both = len(np.intersect1d(s, t))
        if 100 * both >= 85 * (len(s) + len(t) - both):
            assert J.bounded_groups(np.array([len(s), len(t)]), [J.bitmap(s), J.bitmap(t)], np.array([0, 1]))
        u = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        if n > 3:
            assert not J.bounded_groups(np.array([len(s), len(u)]), [J.bitmap(s), J.bitmap(u)], np.array([0, 1]))


def test_components_of_a_chain_and_a_star(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200)]
    got = dict(rows(graph.components(spark.createDataFrame(e, "u long, v long"))))
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 150)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def spots(text):
    text = text or ""
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    out = set()
    is_anchor = {x: x in P.ANCHORS or xxhash.xxh64_intdigest(x.encode(), seed=42) % P.EVERY == 0 for x in w}
    c = [y for y in w if not is_anchor[y]]
    seen = 0
    for x in w:
        if is_anchor[x]:
            if seen + 2 <= len(c):
                out.add((x, *c[seen:seen + 2]))
        else:
            seen += 1
    return out | {("^", *c[:k]) for k in (1, 2) if c} | {(".", *c[-k:]) for k in (1, 2) if c} or {("$", text)}


def like(a, b):
    return len(spots(a) & spots(b)) / len(spots(a) | spots(b))


def test_fingerprints_equal_brute_force(spark):
    data = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy(F.desc("doc_id")).select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op1_spot_signatures(spark, SF).collect()}
    for k, (i, t) in enumerate(data):
        nxt, n = data[(k + 1) % len(data)][1], len(t)
        e = t[:n - n // 3] + nxt[:n // 3]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert len(got[i].fingerprint) == 16 * len(spots(t))
        assert got[i].near_edited == pytest.approx(like(t, e)) and got[i].near_next == pytest.approx(like(t, nxt))


def test_neighbours_across_buckets_ties_and_nulls(spark):
    data = [(k * k * 10 ** 12, f"text {k} of the word list") for k in range(57)] + [(None, "n1"), (None, "n2"), (None, None), (4, "tie a"), (4, "tie b"), (-5, "minus")]
    x = spark.createDataFrame(data, "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("text"))
    got = rows(P.neighbours(x, per=3).select("id", "text", "next_text"))
    assert len(got) == len(data) and sorted(r[1] for r in got) == sorted(r[2] for r in got)  # one round through all
    after = {(r[0], r[1]): r[2] for r in got}
    ids = {t or "": i for i, t in data}
    for (i, _), t in after.items():
        j = ids[t]
        if i is not None and j is not None:
            assert j <= i or i == -5 or i == min(k for k, _ in data if k is not None)
    seen, at = [], (data[56][0], data[56][1])
    for _ in data:
        seen.append(at)
        at = (ids[after[at]], after[at])
    assert len(set(seen)) == len(data) and [s[0] for s in seen if s[0] is not None] == sorted((i for i, _ in data if i is not None), reverse=True)
    assert [s[0] for s in seen[-3:]] == [None] * 3


def test_fingerprint_edge_cases(spark):
    got = P.edited(docs(spark, "sigs", "text_next")).collect()
    assert len(got) == len(DOCS) and all(len(r.fingerprint) >= 16 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = P.edited(docs(spark, rows=DOCS[4:5])).first()
    assert one.near_next == 1.0 and P.edited(docs(spark, rows=[])).count() == 0
    plan = P.edited(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_fingerprints_cover_texts_without_common_words(spark):
    rng = random.Random(8)
    data = [" ".join(["red", "green", *(f"{c}{k}" for k in range(600))]) for c in "qz"]
    data += ["x " * 25, "1 | 2 | 3 | 4 | 5 " * 6, " ".join(rng.choice("ab") for _ in range(30)), " ".join(f"слово{k}" for k in range(40)), "x " * 400]
    got = {r.doc_id: r for r in P.edited(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()}
    assert got[0].fingerprint != got[1].fingerprint and got[1].near_next < 0.05 and got[1].near_edited < 0.9
    assert all(len(r.fingerprint) >= 3 * 16 for r in got.values())
    for i, t in enumerate(data):
        assert len(got[i].fingerprint) == 16 * len(spots(t))


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(("the", "of", "and") + tuple(f"w{k}" for k in range(300))) for _ in range(80)) for _ in range(6)]
    data = [(k, " ".join(x if rng.random() > 0.01 * (k % 3) else "new" for x in base[k % 6].split())) for k in range(60)]
    x = spark.createDataFrame(data, "doc_id long, text string")
    got = {(q, m) for q, m, _ in rows(P.search(x, x.where("doc_id % 20 = 0")))}
    assert got == {(q, m) for q, a in data if q % 20 == 0 for m, b in data if like(a, b) >= 0.8}


def katz(data):
    """(id, text) rows -> base score and score by the definitions, and the normalisation of some histories."""
    tok = [[*words(t), None] for _, t in data]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in data]
    c, pair, hist = Counter(), Counter(), Counter()
    for t, x in zip(tok, train):
        if x:
            c.update(t), pair.update(zip(["<s>", *t[:-1]], t)), hist.update(["<s>", *t[:-1]])
    size = sum(c.values()) + len(c) + 1
    d = L.discounts(Counter(pair.values()))
    p1 = lambda w: (c[w] + 1) / size
    mass, lower, after = Counter(), Counter(), defaultdict(list)
    for (h, w), k in pair.items():
        if k > 1:
            mass[h] += k * (d[k] if k <= L.K else 1)
            lower[h] += p1(w)
            after[h].append(w)
    left = {h: max(1 - mass[h] / hist[h], 0.5 / (hist[h] + 1)) for h in mass}

    def p(h, w):
        k = pair.get((h, w), 0)
        if k > 1:
            return (1 - left[h]) / mass[h] * k * (d[k] if k <= L.K else 1)
        return (left[h] / (1 - lower[h]) if h in left else 1) * p1(w)

    for h in list(left)[:20]:
        assert sum(p(h, w) for w in after[h]) + left[h] == pytest.approx(1)
    return [(i, not x, len(t), sum(c[w] > 0 for w in t), sum(c.values()), sum(math.log10(p1(w)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t)))
            for (i, _), t, x in zip(data, tok, train)]


@pytest.mark.parametrize("part_tokens", [3_000_000, 2_000])
def test_model_equals_brute_force(spark, part_tokens):
    data = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(rows(L.scores(table(spark, SF, "documents"), crc_mod("doc_id", 7) == 2, part_tokens=part_tokens, least=2)))
    for g, w in zip(got, sorted(katz(data)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_model_edge_cases(spark):
    got = sorted(rows(L.scores(docs(spark, "train", "h"), crc_mod("doc_id", 7) == 2, least=2)), key=repr)
    for g, w in zip(got, sorted(katz([(d[0], d[1]) for d in DOCS]), key=repr), strict=True):
        assert g[:5] == w[:5]
    assert L.scores(docs(spark, rows=[]), crc_mod("doc_id", 7) == 2).count() == 0
    none = rows(L.scores(docs(spark, rows=DOCS[1:3]), F.lit(True)))
    assert all(r[3] == r[4] == 0 and r[5] == r[6] == 0.0 for r in none)


def test_hot_words_after_unseen_histories(spark):
    passage = [f"p{k}" for k in range(20)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    # held-out texts deal each hot word to parts that have no training token of it
    data = [(i, " ".join(f"q{i} p{k} p{(k + i) % 20}" for k in range(20)) if i in held else " ".join(passage)) for i in range(400)]
    x = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(rows(L.scores(x, crc_mod("doc_id", 7) == 2, least=2)))
    for g, w in zip(got, sorted(katz(data)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def katz_whole(data):
    """(id, text) rows -> score by Katz's formulas with every seen bigram kept."""
    tok = [[*words(t), None] for _, t in data]
    c, pair = Counter(), Counter()
    for (i, _), t in zip(data, tok):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update(t), pair.update(zip(["<s>", *t[:-1]], t))
    size, n = sum(c.values()) + len(c) + 1, Counter(pair.values())
    cut_off = (L.K + 1) * n[L.K + 1] / n[1]
    d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - cut_off) / (1 - cut_off) for r in range(1, L.K + 1)}
    d = {r: x if 0 < x < 1 else (r - 0.5) / r for r, x in d.items()}
    hist, mass, lower = Counter(), Counter(), Counter()
    for (h, w), k in pair.items():
        hist[h] += k
        mass[h] += k * d.get(k, 1)
        lower[h] += (c[w] + 1) / size
    left = {h: max(1 - mass[h] / hist[h], 0.5 / (hist[h] + 1)) for h in mass}

    def p(h, w):
        if (h, w) in pair:
            return (1 - left[h]) / mass[h] * pair[h, w] * d.get(pair[h, w], 1)
        return (left[h] / (1 - lower[h]) if h in left else 1) * (c[w] + 1) / size

    return d, [(i, sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t))) for (i, _), t in zip(data, tok)]


@pytest.mark.parametrize("part_tokens", [3_000_000, 2_000])
def test_query_keeps_bigrams_seen_once(spark, part_tokens):
    x = table(spark, SF, "documents").select("doc_id", "text")
    d, want = katz_whole([tuple(r) for r in x.collect()])
    df = queries.op10_katz_lm(spark, SF) if part_tokens > 2_000 else L.scores(x, crc_mod("doc_id", 7) == 2, part_tokens=part_tokens, least=1)
    got = sorted((r.doc_id, r.score) for r in df.collect())
    assert 0 < d[1] < 1
    for g, w in zip(got, sorted(want), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-9)


def test_pipeline_stages(spark, tmp_path):
    names, x = [], table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in x.collect()}
        stage(spark, x, SF).write.parquet(f"{tmp_path}/{k}")
        x = spark.read.parquet(f"{tmp_path}/{k}")
        names.append(name)
        if k < 4:
            now = {r.doc_id: r.text for r in x.collect()}
            assert x.columns == list(corpus_pipeline.COLUMNS) and now.keys() <= before.keys()
        if name == "ngram_join":
            assert now.keys() == {i for i, _, c in linked(list(before.items()), 5, 80) if i == c}
        elif name == "secret_scans":
            assert now.keys() == before.keys() and all(("[SECRET]" in now[i]) == (now[i] != before[i]) for i in now)
        elif k < 4:
            assert all(now[i] == before[i] for i in now)
    last = x.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in last} == now.keys() and all(r.n == r.m for r in last)
    assert names == ["quality_classifier", "quality_rules", "ngram_join", "secret_scans", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == x.count()


def test_pipeline_stages_take_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, "score", "extra"), SF).count() >= 0, name
        assert stage(spark, docs(spark, rows=[]), SF).count() == 0, name


def test_drop_copies_judges_rows(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    data = [(1, a), (1, a), (2, b), (5, b), (5, c), (None, d), (None, d), (7, e), (None, e), (9, ""), (9, ""), (None, ""), (None, None), (6, c + " end")]
    x = docs(spark, rows=[(i, t, "en", "src", 1, "clash", 0.5) for i, t in data])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, x, SF).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (5, c), (None, d), (7, e), (9, ""), (None, ""), (None, None)], key=repr)
