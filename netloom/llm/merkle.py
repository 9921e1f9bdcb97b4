"""Merkle manifest of a dataset with membership proofs by pointer jumping.

Every row is a leaf: the SHA-256 of its fields, each written as byte count and value. The leaves of a
source, in order of id, form a tree with three children a node, and the sources' roots form the tree
above. Each node holds the segment of a proof that leads to its parent: its run's other nodes. The
segments are joined by doubling: a node that knows its path to the ancestor ``d`` levels up is joined
with that ancestor, which knows the next ``d`` levels, so after log2(height) self-joins every leaf
holds the path to its root. Only levels that are a multiple of ``d`` take part in a round.

A leaf's place in its source comes from a range sort with running totals per sorted part, so a
source with a third of all rows is spread over tasks. An ancestor ``d`` levels up is looked up by at
most 3**d rows; ancestors are broadcast once their counted bytes are few, which they are long before
3**d is large.

Edge cases: a null field is "-"; rows with a null or repeated id are leaves of their own, ordered
null first, then by leaf digest; a null id is never tampered with; a null source is the first source;
an empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.functions.skew import spread_join
from netloom.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
MAX_BROADCAST = 4 << 20
PART_ROWS = 200_000  # rows of a sorted part


def leaf(**changed) -> Column:
    """Digest of a row's fields; ``changed`` replaces a field by another column."""
    parts = []
    for f in FIELDS:
        c = changed.get(f, F.col(f)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _light(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def positions(df: DataFrame, within: list, order: list, name: str) -> DataFrame:
    """``df`` with ``idx``, a row's place (from 0) among the rows that share ``within``, and ``n``, their number.

    Rows are sorted by ranges and written. A row's number in its sorted part, less the first one of
    its group there, plus the group's rows in earlier parts, is its place. Ties take the scan's order.
    """
    parts = max(1, -(-df.count() // PART_ROWS))
    ties = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ties.repartitionByRange(parts, *within, *order, "_tie").sortWithinPartitions(*within, *order, "_tie")
    placed = cut(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    starts = cut(starts.select(*within, "_part", "_first", F.sum("_rows").over(group).alias("n"),
                               F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")), f"{name}-starts")
    return (placed.join(_light(starts, 48 * starts.count()), [*within, "_part"])
            .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))


def _levels(nodes: DataFrame) -> list:
    """Number of nodes with a parent on each level, from the trees' sizes ``n``."""
    size = [F.expr(f"(n + {RUN ** h - 1}L) div {RUN ** h}L") for h in range(39)]
    got = nodes.groupBy("tree").agg(F.max("n").alias("n")).agg(*[F.sum(F.when(s > 1, s)) for s in size]).first()
    return [int(x) for x in got if x]


def proofs(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (tree, idx, n, digest, row) with ``n`` leaves each.

    Returns (tree, row, digest, path) of the leaves and (tree, digest) of the roots; ``path`` holds,
    for each level, a byte whose halves count the siblings before and after, then their digests.
    """
    nodes = nodes.select("tree", "idx", "n", "digest", "row")
    counts, roots, paths, now = _levels(nodes), [], [], nodes
    for h in range(len(counts)):
        roots.append(now.where("n = 1").select("tree", "digest"))
        runs = cut(now.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {RUN}").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest", "row"))).alias("run")), f"{name}-{h}")
        k, others = F.col("k"), F.filter("run", lambda _, i: i != F.col("k"))
        mark = F.concat(k.cast("string"), (F.size("run") - 1 - k).cast("string"))
        segment = F.unhex(F.concat(mark, F.concat_ws("", F.transform(others, lambda x: F.hex(x["digest"])))))
        paths.append(runs.select("tree", "run", F.posexplode("run").alias("k", "me")).select("tree", "me.*", segment.alias("path")))
        text = F.concat_ws("", F.transform("run", lambda x: F.lower(F.hex(x["digest"]))))
        now = runs.select("tree", F.col("up").alias("idx"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.unhex(F.sha2(text, 256)).alias("digest"),
                          F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
    roots.append(now.where("n = 1").select("tree", "digest"))
    d = 1
    while d < len(counts):  # every node's path leads d levels up; one more round makes it 2 d
        for h in range(0, len(counts) - d, 2 * d):
            above = paths[h + d].select("tree", F.col("idx").alias("_up"), F.col("path").alias("_more"))
            size = counts[h + d] * (32 + 33 * RUN * min(d, len(counts) - h - d))
            joined = paths[h].withColumn("_up", F.expr(f"idx div {RUN ** d}L")).join(_light(above, size), ["tree", "_up"], "left")
            paths[h] = joined.withColumn("path", F.concat("path", F.coalesce("_more", F.lit(b"")))).drop("_up", "_more")
        d *= 2
    alone = nodes.where("n = 1").select("tree", "row", "digest", F.lit(b"").alias("path"))
    top = roots[0]
    for r in roots[1:]:
        top = top.unionByName(r)
    leaves = paths[0].select("tree", "row", "digest", "path").unionByName(alone) if paths else alone
    return leaves, top


def fold(digest: str, path: str) -> str:
    """Root that a leaf's digest and its path (both hex) lead to."""
    at = 0
    while at < len(path):
        before, after = int(path[at]), int(path[at + 1])
        mid, end = at + 2 + 64 * before, at + 2 + 64 * (before + after)
        digest = sha256((path[at + 2:mid] + digest + path[mid:end]).encode()).hexdigest()
        at = end
    return digest


def siblings(path: str) -> str:
    """The digests of a path, without its marks."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + 64 * (int(path[at]) + int(path[at + 1]))
        out.append(path[at + 2:end])
        at = end
    return "".join(out)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, source, leaf, now, subroot, root, path) of every row, digests and path as bytes.

    ``now`` is the leaf of the row as it is today: where ``tampered`` holds, line feeds have gone from its text.
    """
    changed = leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = docs.select(*FIELDS).select("doc_id", "source", leaf().alias("leaf"), F.when(tampered, changed).alias("now"))
    rows = cut(rows.withColumn("now", F.coalesce("now", "leaf")), "leaves")
    names = positions(rows.select("source").distinct(), [], ["source"], "sources")
    names = cut(names.select("source", F.col("idx").alias("tree"), F.lit(0).cast("bigint").alias("top"), F.col("n").alias("trees")), "trees")
    many = names.count()
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_key")
    rows, named = rows.select("doc_id", "leaf", "now", key), names.select(key, "tree")
    rows = rows.join(F.broadcast(named), "_key") if 64 * many <= MAX_BROADCAST else spread_join(rows, named, ["_key"], ["leaf"])
    placed = positions(rows.select("tree", "doc_id", "leaf", "now"), ["tree"], ["doc_id", "leaf"], "placed")
    leaves, subroots = proofs(placed.select("tree", "idx", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "now").alias("row")), "runs")
    subroots = cut(subroots, "subroots")
    heads = subroots.join(names, "tree").select(F.col("top").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest", F.struct("source", "tree").alias("row"))
    heads, root = proofs(heads, "heads")
    heads = cut(heads.join(root.select("tree", F.col("digest").alias("root")), "tree").select(
        "row.tree", "row.source", F.col("digest").alias("subroot"), "root", F.col("path").alias("_rest")), "heads")
    leaves = leaves.select("tree", "row.*", F.col("digest").alias("leaf"), "path")
    whole = leaves.join(F.broadcast(heads), "tree") if 512 * many <= MAX_BROADCAST else spread_join(leaves, heads, ["tree"], ["leaf"])
    return whole.select("doc_id", "source", "leaf", "now", "subroot", "root", F.concat("path", "_rest").alias("path"))


def verified(proven: DataFrame) -> DataFrame:
    """Proofs checked: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests in lowercase hex."""
    def work(batches):
        for b in batches:
            leaf_, now, sub, root, path = ([x.hex() for x in b.column(c).to_pylist()] for c in ("leaf", "now", "subroot", "root", "path"))
            proof = [sha256(siblings(p).encode()).hexdigest() for p in path]
            folded = [fold(d, p) for d, p in zip(now, path)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, (leaf_, sub, root, proof, folded, [x == y for x, y in zip(folded, root)]))],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proven.select("doc_id", "leaf", "now", "subroot", "root", "path").mapInArrow(
        work, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
