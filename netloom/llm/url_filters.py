"""URL filters: a memory-mapped sorted array of 64-bit digests, confirmed against stored strings.

An index holds rules ``host/path`` (fits the host and its subdomains if the url's path starts with
the rule's path), exact urls, host labels, and words of host labels (between hyphens). Each key's
xxhash64 is stored in ascending order with an offset into the strings. A batch of urls makes its
candidate keys (host suffixes x path lengths that rules have, the url itself, its labels and their
words), probes the array by one vectorised binary search, and compares every hit with the stored
string, so a digest collision cannot give a verdict.

Lists are tables (kind, key, verdict), see ``KINDS``. A counted list of at most ``MAX_BYTES`` is one index
that is sent to every task, which maps it from an unlinked file of its own. A longer one is dealt to
buckets by digest: each bucket's index is built where its probes arrive, distinct candidate keys of
all urls, and the hits go back to the rows. Both ways give the same rows.

The longest fitting rule wins; of equal keys, block wins. Without a rule, a url is blocked if the url,
one of its host's labels or one of their words is listed for blocking, else allowed.

Edge cases: a null url or one without "://" has empty host and path and is allowed; hosts may be
empty or hold ports; repeated rows and repeated ids are judged row by row; an empty table gives no
rows; an empty list allows everything; null keys of a list are left out. Of the caller's columns those
in ``keep`` are returned; result columns win over ``keep`` columns of the same name.
"""

import mmap
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.functions.skew import spread_join
from netloom.session import cut

MAX_BYTES = 64 << 20
LOWER = {c: c + 32 for c in range(65, 91)}


#: kind of a list's key -> its mark in an index
KINDS = {"rule": b"r", "url": b"u", "label": b"l", "word": b"w"}
BUCKET = 500_000  # keys of a bucket's index


def as_table(spark, rules=(), urls=(), labels=(), words=()) -> DataFrame:
    """List table of (verdict, "host/path") rules and of blocked urls, host labels and their words."""
    rows = [("rule", r, v) for v, r in rules] + [(k, x, "block") for k, xs in (("url", urls), ("label", labels), ("word", words)) for x in xs]
    return spark.createDataFrame(rows, "kind string, key string, verdict string")


def _keys(rows) -> dict:
    """Marked key -> verdict; of equal keys block wins."""
    keys: dict = {}
    for kind, key, verdict in rows:
        k = KINDS[kind] + key.encode()
        if keys.get(k) != "block":
            keys[k] = verdict
    return keys


def build(rules=(), urls=(), labels=(), words=()) -> bytes:
    """Index of (verdict, "host/path") rules, blocked urls, host labels and words."""
    return pack(_keys([("rule", r, v) for v, r in rules] + [(k, x, "block") for k, xs in (("url", urls), ("label", labels), ("word", words)) for x in xs]))


def pack(keys: dict) -> bytes:
    """Index of marked keys with their verdicts."""
    rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in keys.items())
    text = [v[:1].encode() + k for _, k, v in rows]
    lengths = sorted({len(path_of(k[1:].decode())) for k in keys if k[:1] == b"r"})
    head = struct.pack("<QQ", len(rows), len(lengths)) + np.array(lengths, "<u8").tobytes()
    return (head + np.array([h for h, _, _ in rows], "<u8").tobytes()
            + np.cumsum([0, *map(len, text)]).astype("<u8").tobytes() + b"".join(text))


def path_of(rule: str) -> str:
    return rule[rule.index("/"):] if "/" in rule else ""


class Index:
    """A mapped index; ``find`` probes many keys at once."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so it goes with the last use
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = struct.unpack_from("<QQ", self.map)
        at = 16
        self.lengths = np.frombuffer(self.map, "<u8", m, at).tolist()
        self.digests = np.frombuffer(self.map, "<u8", n, at := at + 8 * m)
        self.offsets = np.frombuffer(self.map, "<u8", n + 1, at := at + 8 * n)
        self.base = at + 8 * (n + 1)

    def find(self, keys: list) -> list:
        """Verdict initial ("b", "a") of each key, or None."""
        out = [None] * len(keys)
        if not keys or not len(self.digests):
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, h)
        for k in np.flatnonzero(self.digests[np.minimum(first, len(self.digests) - 1)] == h).tolist():
            i = int(first[k])
            while i < len(self.digests) and self.digests[i] == h[k]:  # keys that share a digest lie together
                stored = self.map[self.base + int(self.offsets[i]):self.base + int(self.offsets[i + 1])]
                if stored[1:] == keys[k]:
                    out[k] = stored[:1].decode()
                    break
                i += 1
        return out


def parts(url):
    """(host, path) of a url."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[:min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def candidates(url, host, path, lengths):
    """Keys to probe, longest rule first, then the url and the labels."""
    labels = host.split(".") if host else []
    rules = [".".join(labels[k:]) + path[:n] for k in range(len(labels)) for n in lengths if n <= len(path)]
    return sorted(rules, key=len, reverse=True), [b"u" + (url or "").encode(), *(b"l" + x.encode() for x in labels),
                                                 *(b"w" + w.encode() for x in labels for w in x.split("-") if w)]


RESULT = ("host", "path", "rule", "verdict")


def _choice(rules: list, lists: list, find) -> tuple:
    """(rule, verdict) from the verdict initials that ``find`` gives to marked keys."""
    for r in rules:
        v = find(b"r" + r.encode())
        if v:
            return r, "block" if v == "b" else "allow"
    return None, "block" if any(find(k) == "b" for k in lists) else "allow"


def judge(pages: DataFrame, index: bytes, url_col="url", keep=("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict of each url. Narrow: no shuffle."""
    shared, keep = pages.sparkSession.sparkContext.broadcast(index), [c for c in keep if c not in RESULT]

    def work(batches):
        ix = Index(shared.value)
        for b in batches:
            host, path, keys, cand = [], [], [], []
            for u in b.column(url_col).to_pylist():
                h, p = parts(u)
                rules, lists = candidates(u, h, p, ix.lengths)
                host.append(h), path.append(p), cand.append((rules, lists))
                keys += [b"r" + r.encode() for r in rules] + lists
            found = dict(zip(keys, ix.find(keys)))
            rule, verdict = zip(*[_choice(r, x, found.get) for r, x in cand]) if cand else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], [*keep, *RESULT])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    return pages.select(*keep, *([] if url_col in keep else [url_col])).mapInArrow(work, ", ".join([*fields, "host string, path string, rule string, verdict string"]))


def judge_lists(pages: DataFrame, lists: DataFrame, url_col="url", keep=("page_id",), most=MAX_BYTES) -> DataFrame:
    """``judge`` with list tables of any size."""
    lists = lists.where("key is not null").groupBy("kind", "key").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    n, size = lists.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 24), F.lit(0))).first()
    if size <= most:
        return judge(pages, pack(_keys(map(tuple, lists.select("kind", "key", "verdict").collect()))), url_col, keep)
    lengths = [r[0] for r in lists.where("kind = 'rule'").select(F.length(F.regexp_extract("key", "/.*", 0))).distinct().collect()]  # as many as rules have path lengths
    return _judge_buckets(pages, lists, sorted(lengths), max(1, -(-n // BUCKET)), url_col, [c for c in keep if c not in RESULT])


def _judge_buckets(pages: DataFrame, lists: DataFrame, lengths: list, buckets: int, url_col: str, keep: list) -> DataFrame:
    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    rows = cut(pages.select(kept.alias("kept"), F.col(url_col).cast("string").alias("url"), F.monotonically_increasing_id().alias("row")), "urls")

    def probes(batches):
        for b in batches:
            row, key = [], []
            for r, u in zip(b.column("row").to_pylist(), b.column("url").to_pylist()):
                rules, more = candidates(u, *parts(u), lengths)
                mine = [b"r" + x.encode() for x in rules] + more
                row += [r] * len(mine)
                key += mine
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.binary())], ["row", "key"])

    asked = cut(rows.select("row", "url").mapInArrow(probes, "row long, key binary"), "probes")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    marks = F.create_map(*[F.lit(x) for k, m in KINDS.items() for x in (k, m)])
    listed = lists.select(F.concat(F.element_at(marks, F.col("kind")), F.col("key").cast("binary")).alias("key"), F.substring("verdict", 1, 1).alias("v"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column("key").to_pylist()
        ix = Index(pack({k: "block" if v == "b" else "allow" for k, v in zip(right.column("key").to_pylist(), right.column("v").to_pylist())}))
        hit = [(k, v) for k, v in zip(keys, ix.find(keys)) if v]
        return pa.table([pa.array([k for k, _ in hit], pa.binary()), pa.array([v for _, v in hit], pa.string())], names=["key", "v"])

    # every key is probed once, however many urls hold it; a key that hits may belong to very many rows
    distinct = asked.select("key").distinct().withColumn("b", bucket)
    found = cut(distinct.groupBy("b").cogroup(listed.withColumn("lb", bucket).groupBy("lb")).applyInArrow(find, "key binary, v string"), "hits")
    hits = spread_join(asked, found, ["key"], ["row"]).groupBy("row").agg(F.collect_list(F.struct("key", "v")).alias("hits"))

    def choose(batches):
        for b in batches:
            out = []
            for u, hit in zip(b.column("url").to_pylist(), b.column("hits").to_pylist()):
                h, p = parts(u)
                got = {x["key"]: x["v"] for x in hit or ()}
                out.append((h, p, *_choice(*candidates(u, h, p, lengths), got.get)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("kept"), *(pa.array(c, pa.string()) for c in cols)], ["kept", *RESULT])

    joined = rows.join(hits, "row", "left").select("kept", "url", "hits")
    out = joined.mapInArrow(choose, f"kept {rows.schema['kept'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.select(*[F.col(f"kept.{c}").alias(c) for c in keep], *RESULT)
