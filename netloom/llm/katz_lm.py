"""Katz back-off language model over words, trained and evaluated in partitioned tables.

Order 2 over an open vocabulary. The lowest order is the add-one distribution over the training
tokens and one unknown token, P1(w) = (c(w) + 1) / (N + V + 1), which sums to one. Bigrams seen at
least ``least`` times (1: all of them) are kept with Good-Turing discounts d(c) for counts up to ``K``, so

    P(w | h) = s(h) d(c) c(h, w) / c(h)   if (h, w) is kept
             = alpha(h) P1(w)             else, evaluated recursively

with alpha(h) = left(h) / (1 - sum of P1 over the kept successors of h): every history sums to one
exactly. left(h) is the mass that discounting leaves, at least half a count; s(h) rescales for that.
A text starts from a start history and ends with an end token.

Tokens are dealt by word (very frequent words by word and history) into parts of bounded size: a
part holds all occurrences of its pairs, as compressed columns per block of documents. It is written
once as a bucketed table that both passes read without another shuffle. Pass one counts: unigrams,
kept bigrams, counts of counts, and per history the sums that alpha needs, which Spark adds up.
Pass two gets back the histories' weights that a part asks for and sends, per block, each document's
partial sums. log alpha of a history is added where the history's own word is, so no part needs more
than its own words and the histories of its kept pairs.

Words are 64-bit hashes, histories 48 bits of them. A sample of the documents tells which words get
short codes, by falling frequency, and which are split, which changes sizes alone, never results. In a
block and part the words, and the histories of each word, are ordered by code and stored as differences.

Edge cases: null or empty text is the end token alone; null ids are not held out by accident (crc32
of the empty text) and stay null; repeated rows are scored one by one; without training documents
every count is 0 and N = V = 0; an empty table gives no rows. Extra columns, whatever their names, are
not read.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from netloom.llm.common import LOWER, Cache, raw
from netloom.session import cut, scratch

END, START = np.uint64(1 << 16), 0  # the end token's hash; the start history's code
K, BLOCK_TOKENS, BLOCK_DOCS, PART_TOKENS = 5, 700_000, 60_000, 1_800_000
SAMPLE, CODES = 4_000, 200_000
RARE = np.uint64(1 << 50)  # added to a history without a code, to sort it behind those with one
BLOBS = ("wc", "wx", "wn", "hk", "hc", "hx", "pn", "d", "train", "ids")
TABLE = "part int, block long, docs int, " + ", ".join(f"{c} binary" for c in BLOBS)
STATS = "part int, h long, j int, c long, b long, " + ", ".join(f"n{r} long" for r in range(1, K + 3)) + ", total long, types long, ask boolean"


def _word(w: bytes) -> int:
    return max(xxhash.xxh3_64_intdigest(w), 2 << 16)


def _codes():
    return Cache(_word, 200_000)


def tokens(text: bytes, codes: Cache) -> np.ndarray:
    """Hashes of the words and the end token."""
    words = text.translate(LOWER).split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def sampled(docs: DataFrame, sample=SAMPLE):
    """(documents, tokens per document, frequent words by falling count, their shares) from a bounded sample."""
    n = docs.count()

    def work(batches):
        codes = _codes()
        for b in batches:
            u, c = np.unique(np.concatenate([tokens(t, codes) for t in raw(b, "text")] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c, pa.int64())], ["w", "c"])

    some = docs.where(F.xxhash64("text", F.lit(5)) / 2.0 ** 64 + 0.5 < sample / max(n, 1)).select("text").limit(4 * sample)
    counts = some.mapInArrow(work, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    got = counts.orderBy(F.desc("c"), "w").limit(CODES).toArrow()
    total = counts.agg(F.sum("c")).first()[0] or 0
    w, c = got.column("w").to_numpy().view(np.uint64), got.column("c").to_numpy()
    rows = max(1, int(c[w == END].sum()))
    return n, total / rows, w, c / max(total, 1)


def _zip(x) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(b, dtype):
    return np.frombuffer(zstandard.decompress(b), dtype)


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each number, byte by byte: like bytes lie together."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T


def _unplanes(b: bytes, width: int) -> np.ndarray:
    raw_ = _unzip(b, np.uint8).reshape(width, -1)
    out = np.zeros((raw_.shape[1], 8), np.uint8)
    out[:, :width] = raw_.T
    return out.reshape(-1).view(np.uint64)


def _steps(x: np.ndarray, width: int) -> bytes:
    """Differences of consecutive numbers, the first from 0, wrapped to ``width`` bytes."""
    return _zip(_planes(np.diff(x.astype(np.uint64), prepend=np.uint64(0)), width))


def _unsteps(b: bytes, width: int) -> np.ndarray:
    x = np.cumsum(_unplanes(b, width), dtype=np.uint64)
    return x if width == 8 else x & np.uint64((1 << 8 * width) - 1)


def part_of(w, h, hot, parts):
    """Part of each token: by word, for hot words by word and history."""
    is_hot = np.isin(w, hot)
    mix = (w ^ (h * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    return (np.where(is_hot, mix, w >> np.uint64(3)) % np.uint64(parts)).astype(np.uint32)


def dealt(docs: DataFrame, codes: np.ndarray, hot: np.ndarray, parts: int, keys: list) -> DataFrame:
    """(id, text, train) -> ``TABLE`` rows: the tokens of a block of documents that belong to a part."""
    shared = docs.sparkSession.sparkContext.broadcast((codes, hot, np.array(keys)))

    def work(batches):
        code_words, hot_, key = shared.value
        by_word = np.argsort(code_words)
        sorted_words = code_words[by_word]
        cache = _codes()
        block, toks, ids, train, held = TaskContext.get().partitionId() << 24, [], [], [], 0

        def flush():
            w = np.concatenate(toks)
            first = np.cumsum([0, *map(len, toks[:-1])])
            h = np.empty_like(w)
            h[1:] = w[:-1] >> np.uint64(16)
            h[first] = START
            d = np.repeat(np.arange(len(toks), dtype=np.uint16), [len(t) for t in toks])
            i = np.minimum(np.searchsorted(sorted_words, w), len(sorted_words) - 1)
            code = np.where(sorted_words[i] == w, by_word[i], -1)
            before = np.empty_like(code)
            before[1:] = code[:-1]
            before[first] = 0  # the start history has the first code
            p = part_of(w, h, hot_, parts)
            h = np.where(before >= 0, before.astype(np.uint64), h + RARE)
            o = np.lexsort((h, w))
            o = o[np.argsort(p[o].astype(np.uint16) if parts < 65536 else p[o], kind="stable")]
            w, h, d, p, code = w[o], h[o], d[o], p[o], code[o]
            cuts = np.searchsorted(p, np.arange(parts + 1))
            mine = block % parts
            rows = []
            for k in range(parts):
                s, e = cuts[k], cuts[k + 1]
                if s == e and k != mine:
                    continue
                W, H, D = w[s:e], h[s:e], d[s:e]
                new_w = np.r_[True, W[1:] != W[:-1]] if e > s else np.empty(0, bool)
                new_p = new_w | np.r_[True, H[1:] != H[:-1]] if e > s else new_w
                at_w, at_p = np.flatnonzero(new_w), np.flatnonzero(new_p)
                hp, wc = H[at_p], code[s:e][at_w]
                known = hp < RARE
                rows.append((int(key[k]), block, len(toks), _steps(np.sort(wc[wc >= 0]), 3), _steps(W[at_w][wc < 0], 8),
                             _zip(np.diff(np.r_[np.searchsorted(at_p, at_w), len(at_p)]).astype(np.uint32)),
                             _zip(np.packbits(known)), _steps(hp[known], 3), _zip(_planes(hp[~known] - RARE, 6)),
                             _zip(np.diff(np.r_[at_p, e - s]).astype(np.uint32)), _zip(_planes(D, 2)),
                             np.packbits(train).tobytes(), _zip(np.array([x if x is not None else 0 for x in ids], np.int64)) if k == mine else None,
                             np.packbits([x is None for x in ids]).tobytes() if k == mine else None))
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * (len(BLOBS) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "block", "docs", *BLOBS, "nulls"])

        for b in batches:
            for i, t, tr in zip(b.column("id").to_pylist(), raw(b, "text"), b.column("train").to_pylist()):
                x = tokens(t, cache)
                if toks and (held + len(x) > BLOCK_TOKENS or len(toks) >= BLOCK_DOCS):
                    yield flush()
                    toks, ids, train, held, block = [], [], [], 0, block + 1
                toks.append(x), ids.append(i), train.append(bool(tr))
                held += len(x)
        if toks:
            yield flush()

    return docs.mapInArrow(work, TABLE + ", nulls binary")


class Part:
    """The decoded rows of one part: pairs with their training counts, and tokens by block."""

    def __init__(self, t: pa.Table, codes: np.ndarray):
        w, h, self.rows, seen = [], [], [], []
        at, keep = 0, ("block", "docs", "train", "ids", "nulls")
        for i in range(t.num_rows):  # one block's columns at a time
            r = t.slice(i, 1).to_pylist()[0]
            W = np.sort(np.concatenate([codes[_unsteps(r["wc"], 3).astype(np.int64)], _unsteps(r["wx"], 8)]))
            wn, pn = _unzip(r["wn"], np.uint32), _unzip(r["pn"], np.uint32)
            known = np.unpackbits(_unzip(r["hk"], np.uint8), count=len(pn)).astype(bool)
            hp = np.empty(len(pn), np.uint64)
            hp[known], hp[~known] = codes[_unsteps(r["hc"], 3).astype(np.int64)] >> np.uint64(16), _unplanes(r["hx"], 6)
            d = _unplanes(r["d"], 2).astype(np.uint16)
            train = np.unpackbits(np.frombuffer(r["train"], np.uint8), count=r["docs"])
            pair = np.repeat(np.arange(len(pn), dtype=np.int32), pn)
            seen.append(np.bincount(pair, train[d], len(pn)).astype(np.int32))
            w.append(np.repeat(W, wn)), h.append(hp)
            self.rows.append(({k: r[k] for k in keep if k in r}, pair + np.int32(at), d))
            at += len(pn)
        w, h, seen = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (w, h, seen))
        o = np.lexsort((h, w)).astype(np.int32)
        ws, hs = w[o], h[o]
        del w, h
        new_w = np.r_[True, ws[1:] != ws[:-1]] if len(ws) else np.empty(0, bool)
        new = new_w | np.r_[True, hs[1:] != hs[:-1]] if len(ws) else new_w
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.of = np.empty(len(o), np.int32)  # listed pair -> distinct pair
        self.of[o] = group
        self.h, self.w = hs[new], ws[new]
        self.c = np.bincount(group, seen[o], len(self.h)).astype(np.int64) if len(o) else np.empty(0, np.int64)
        first = np.flatnonzero(new_w[new]) if len(ws) else np.empty(0, np.int64)
        self.word_of = np.cumsum(new_w[new], dtype=np.int32) - np.int32(1) if len(ws) else np.empty(0, np.int32)
        self.words = self.w[first]
        self.word_c = np.add.reduceat(self.c, first) if len(first) else np.empty(0, np.int64)


def _stats(part_table: pa.Table, codes, hot, least: int) -> pa.Table:
    """``STATS`` rows of one part."""
    p = Part(part_table, codes)
    part = part_table.column("part")[0].as_py()
    hot_of = np.searchsorted(hot, p.words) if len(hot) else np.zeros(len(p.words), int)
    is_hot = hot[np.minimum(hot_of, len(hot) - 1)] == p.words if len(hot) else np.zeros(len(p.words), bool)
    cols = {n: [] for n in ("h", "j", "c", "b", *(f"n{r}" for r in range(1, K + 3)), "total", "types")}

    def put(n, **got):
        for k, v in cols.items():
            v.append(np.asarray(got.get(k, np.zeros(n)), np.int64) if np.ndim(got.get(k, np.zeros(n))) else np.full(n, got[k], np.int64))

    # pairs that are kept, per history and hot word: counts of counts up to K, the sum of larger counts, and of c(w) + 1
    kept = np.flatnonzero(p.c >= least)
    j = np.where(is_hot[p.word_of[kept]], hot_of[p.word_of[kept]], -1)
    o = np.lexsort((j, p.h[kept]))
    kept, j = kept[o], j[o]
    if len(kept):
        h, c = p.h[kept], p.c[kept]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (j[1:] != j[:-1])])
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        b = np.where(j < 0, p.word_c[p.word_of[kept]] + 1, 1)
        put(len(first), h=h[first], j=j[first], b=add(b), **{f"n{r}": add(c == r) for r in range(least, K + 1)}, **{f"n{K + 1}": add(np.where(c > K, c, 0))})
    # the words' own counts, as histories; the end token's count is also the start history's. A hot word
    # is asked for wherever it occurs: its training tokens may all be in other parts
    own = np.flatnonzero(((p.word_c >= least) | is_hot) & (p.words != END))
    put(len(own), h=p.words[own] >> np.uint64(16), j=np.full(len(own), -1), c=p.word_c[own])
    ends = int(p.word_c[p.words == END].sum())
    if ends:
        put(1, h=[START], j=[-1], c=[ends])
    # totals of the part
    put(1, h=[-1], j=[-1], total=[int(p.word_c.sum())], types=[int((p.word_c[~is_hot] > 0).sum())], **{f"n{r}": [int((p.c == r).sum())] for r in range(1, K + 2)})
    for i in np.flatnonzero(is_hot).tolist():
        put(1, h=[-2], j=[int(hot_of[i])], c=[int(p.word_c[i])])
    out = {k: np.concatenate(v) for k, v in cols.items()}
    n = len(out["h"])
    ask = np.zeros(n, bool)  # one row of each history that this part needs
    ask[np.unique(out["h"], return_index=True)[1]] = True
    ask &= out["h"] >= 0
    return pa.table([pa.array(np.full(n, part), pa.int32()), pa.array(out["h"]), pa.array(out["j"], pa.int32()), *(pa.array(out[k]) for k in list(cols)[2:]), pa.array(ask)],
                    names=["part", *cols, "ask"])


def discounts(n: dict) -> list:
    """Good-Turing discount of counts 0..K (0 unused), by Katz's formula; absolute where counts of counts are too few for it."""
    out = [1.0]
    cut_off = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - cut_off) / (1 - cut_off) if n.get(r) and cut_off < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _sums(p: Part, hist: pa.Table, hot, hot_c, d, log_d: float, least: int):
    """Partial sums of each block's documents in one part: (block, docs seen, n, known, base, more, ids, nulls)."""
    word_c = p.word_c
    if len(hot):
        i = np.minimum(np.searchsorted(hot, p.words), len(hot) - 1)
        word_c = np.where(hot[i] == p.words, hot_c[i], word_c)
    log_c = np.log10(word_c + 1.0)
    hh = hist.column("h").to_numpy().astype(np.uint64)
    o = np.argsort(hh)
    hh = hh[o]
    weight, alpha = hist.column("g").to_numpy()[o], hist.column("la").to_numpy()[o]

    def look(keys, values):
        if not len(hh):
            return np.zeros(len(keys))
        k = np.minimum(np.searchsorted(hh, keys), len(hh) - 1)
        return np.where(hh[k] == keys, values[k], 0.0)

    own = np.where(p.words == END, 0.0, look(p.words >> np.uint64(16), alpha))
    disc = np.where(p.c <= K, np.asarray(d)[np.clip(p.c, 0, K)], 1.0)
    kept = np.where(p.c >= least, np.log10(np.maximum(p.c, 1) * disc) + look(p.h, weight) - (log_c[p.word_of] - log_d), 0.0)
    per_pair = kept + own[p.word_of]
    base_pair, known_pair = log_c[p.word_of], (word_c > 0)[p.word_of]
    out = []
    for r, pair, doc in p.rows:
        g = p.of[pair]
        n = np.bincount(doc, minlength=r["docs"])
        at = np.flatnonzero(n)
        f = lambda x: np.bincount(doc, x[g], r["docs"])[at]
        out.append((r["block"], r["docs"], _zip(at.astype(np.uint16)), _zip(n[at].astype(np.uint32)), _zip(f(known_pair).astype(np.uint32)), _zip(f(base_pair)), _zip(f(per_pair)),
                    r["train"], r["ids"], r["nulls"]))
    return out


PARTIAL = "block long, docs int, at binary, n binary, known binary, base binary, more binary, train binary, ids binary, nulls binary"


def scores(docs: DataFrame, held_out, id_col="doc_id", text_col="text", part_tokens=PART_TOKENS, sample=SAMPLE, min_parts=8, least=1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); trained on rows where the column ``held_out`` is false.

    Katz's whole model keeps every bigram; those of fewer than ``least`` training occurrences count as unseen.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    n, per_doc, words, share = sampled(src, sample)
    parts = max(min_parts, math.ceil(n * per_doc / part_tokens))
    hot = np.sort(words[share > 1 / (4 * parts)])  # at most 4 words a part
    codes = np.r_[np.zeros(1, np.uint64), words[:CODES]]  # the first one stands for the start history
    # part numbers that hash to partitions of their own
    deal = spark.range(40 * parts + 200).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("k"))
    keys = {r.p: r.k for r in deal.collect()}
    spare = iter(range(40 * parts + 200, 10 ** 9))
    keys = [int(keys.get(p, -1)) if p in keys else next(spare) for p in range(parts)]
    name = f"llm_tokens_{uuid.uuid4().hex}"  # a bucketed table must have a name; it is dropped when the plan has it
    (dealt(src, codes, hot, parts, keys).repartition(parts, "part").write.bucketBy(parts, "part").option("path", scratch(spark, "tokens"))
     .option("compression", "uncompressed").saveAsTable(name))
    tok = spark.table(name)
    shared = spark.sparkContext.broadcast((codes, hot))

    def count(t: pa.Table) -> pa.Table:
        return _stats(t, *shared.value, least)

    stats = cut(tok.drop("ids", "nulls").groupBy("part").applyInArrow(count, STATS), "stats")
    t = stats.where("h = -1").agg(F.sum("total").alias("n"), F.sum("types").alias("v"), *[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, K + 2)]).first()
    total, types = t.n or 0, t.v or 0
    hot_c = np.zeros(len(hot), np.int64)
    for r in stats.where("h = -2").groupBy("j").agg(F.sum("c").alias("c")).collect():  # as many as hot words
        hot_c[r.j] = r.c
    types += int((hot_c > 0).sum())
    size = total + types + 1
    d = discounts({r: t[f"n{r}"] or 0 for r in range(1, K + 2)})

    # b of a hot successor counts pairs: times its count + 1
    one = F.when(F.col("j") < 0, F.col("b")).otherwise(F.col("b") * F.element_at(F.array(*[F.lit(int(x) + 1) for x in hot_c] or [F.lit(1)]), F.greatest(F.col("j") + 1, F.lit(1))))
    h = (stats.where("h >= 0").withColumn("b", one).groupBy("h")
         .agg(F.sum("c").alias("c"), F.sum("b").alias("b"), *[F.sum(f"n{r}").alias(f"n{r}") for r in range(least, K + 2)]))
    mass = sum((F.col(f"n{r}") * (r * d[r]) for r in range(least, K + 1)), F.col(f"n{K + 1}").cast("double"))
    h = h.where("b > 0").withColumn("a", mass).withColumn("left", F.greatest(1 - F.col("a") / F.col("c"), 0.5 / (F.col("c") + 1)))
    h = h.select("h", F.log10(F.col("left") / F.greatest(1 - F.col("b") / size, F.lit(1e-12))).alias("la"), F.log10((1 - F.col("left")) / F.col("a")).alias("s"))
    h = cut(h.select("h", "la", (F.col("s") - F.col("la")).alias("g")), "histories")
    start = h.where(F.col("h") == START).first()
    start = start.la if start else 0.0
    asked = stats.where("ask").select("part", "h").join(h, "h").select("part", "h", "g", "la")
    log_d = math.log10(size)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        codes_, hot_ = shared.value
        rows = _sums(Part(left, codes_), right, hot_, hot_c, d, log_d, least) if left.num_rows else []
        types_ = [pa.int64(), pa.int32(), *[pa.binary()] * 8]
        names = [x.split()[0] for x in PARTIAL.split(", ")]
        cols = zip(*rows) if rows else [[]] * len(names)
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, types_)], names=names)

    partial = tok.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(add, PARTIAL)
    spark.sql(f"DROP TABLE {name}")  # the plan has the files and their buckets; they stay in the run's folder

    def whole(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        m = rows[0]["docs"]
        n_, known, base, more = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        for r in sorted(rows, key=lambda r: r["base"]):  # one order of additions
            at = _unzip(r["at"], np.uint16)
            n_[at] += _unzip(r["n"], np.uint32)
            known[at] += _unzip(r["known"], np.uint32)
            base[at] += _unzip(r["base"], np.float64)
            more[at] += _unzip(r["more"], np.float64)
            if r["ids"] is not None:
                ids, nulls = _unzip(r["ids"], np.int64), np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=m).astype(bool)
        train = np.unpackbits(np.frombuffer(rows[0]["train"], np.uint8), count=m).astype(bool)
        base -= n_ * log_d
        return pa.table([pa.array(ids, mask=nulls), pa.array(~train), pa.array(n_), pa.array(known), pa.array(np.full(m, total)), pa.array(base), pa.array(base + more + start)],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = partial.groupBy("block").applyInArrow(whole, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
