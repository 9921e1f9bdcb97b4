"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is an anchor with the next ``CHAIN`` content words, that is words that are no anchors;
chains may overlap and skip any number of anchors. Anchors are common words and, so that lists, code
and other languages are covered in full as well, one word in ``EVERY`` by its hash. The start and the
end of a text are anchors too, with chains of 1 to ``CHAIN`` content words, so every text with a content
word has a signature; a text without one is a single signature of its own. The fingerprint is the sorted set of 64-bit signature
hashes, written as 16 hex digits each. Likeness is the Jaccard similarity of two sets; where a
threshold is asked for, sets whose lengths alone rule it out are not intersected.

Signatures are found in linear time: with the positions of anchors and the array of content words,
the number of content words before an anchor is its position less its rank.

``neighbours`` puts each document beside the next one in descending id. Ids are cut into buckets at
sampled quantiles (a bucket holds some hundred rows), the first row of each bucket is also sent to
the bucket before it, and a window per bucket does the rest: texts are shuffled once, no bucket
grows with the table, and the table of bucket heads is bounded (``HEADS`` rows).

Edge cases: null text is empty; null ids come last, in the order of their texts' hashes, as do equal
ids; repeated rows are neighbours of each other; a single row is its own next; an empty table gives
no rows. Extra columns, whatever their names, are not read.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

CHAIN, EVERY, PER_BUCKET, HEADS, CELLS = 2, 4, 400, 1_000_000, 64
PART_BYTES = 16 << 20  # text bytes of a shuffle partition
#: fixed values: common words of the four languages
ANCHORS = ("the a an of and to in is it that for on was with as be by this are at from "
           "le la les des et de en un une que dans pour est pas sur par "
           "der die das und den ist ein eine von zu mit auf im "
           "el los las y del se para por con su lo").split()


def _anchor(word: Column) -> Column:
    return word.isin(*ANCHORS) | (F.xxhash64(word) % EVERY == 0)


def signatures(df: DataFrame, text: str, out: str, chain=CHAIN) -> DataFrame:
    """``df`` with ``out``: the sorted distinct signature hashes of ``text`` (not null)."""
    w, c, a = f"_{out}_w", f"_{out}_c", f"_{out}_a"
    df = df.withColumn(w, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn(c, F.filter(w, lambda x: ~_anchor(x)))
    df = df.withColumn(a, F.filter(F.transform(w, lambda x, i: F.when(_anchor(x), i).otherwise(-1)), lambda p: p >= 0))

    def spot(p, rank):
        words = [F.get(c, p - rank + k) for k in range(chain)]
        return F.when(p - rank + chain <= F.size(c), F.xxhash64(F.get(w, p), *words))

    start = [F.xxhash64(F.lit("^"), F.array_join(F.slice(c, 1, k), " ")) for k in range(1, chain + 1)]
    start += [F.xxhash64(F.lit("."), F.array_join(F.slice(c, F.greatest(F.size(c) - k, F.lit(0)) + 1, k), " ")) for k in range(1, chain + 1)]
    start = F.when(F.size(c) > 0, F.array(*start)).otherwise(F.array(F.xxhash64(F.lit("$"), F.col(text))))
    sigs = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(a, spot), start))))
    return df.withColumn(out, sigs).drop(w, c, a)


def likeness(a, b, threshold=0.0) -> Column:
    """Jaccard similarity of two sets without repeats; 0 where their lengths rule ``threshold`` out."""
    a, b = F.col(a), F.col(b)
    both = F.size(F.array_intersect(a, b))
    ratio = both / (F.size(a) + F.size(b) - both)
    if not threshold:
        return ratio
    return F.when(F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b)), ratio).otherwise(F.lit(0.0))


def written(sigs) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _bucketed(docs: DataFrame, per: int) -> tuple[DataFrame, int]:
    """``docs`` (id, text) with bucket ``_b``, descending in the order of rows (larger ids, larger buckets), and the text bytes."""
    points = F.array(*[F.lit(k / CELLS) for k in range(CELLS + 1)])
    n, ids, size, bounds = docs.agg(F.count("*"), F.count("id"), F.sum(F.octet_length("text")), F.percentile_approx("id", points, 10_000)).first()
    per = max(per, math.ceil(n / HEADS))
    bounds = sorted(set(bounds or [0]))
    m = max(1, math.ceil(ids / per / max(len(bounds) - 1, 1)))
    cell, lo, hi = F.lit(0), F.lit(float(bounds[0])), F.lit(float(bounds[min(1, len(bounds) - 1)]))
    for k, b in enumerate(bounds[1:-1], 1):
        above = F.col("id") >= b
        cell, lo, hi = F.when(above, k).otherwise(cell), F.when(above, float(b)).otherwise(lo), F.when(above, float(bounds[k + 1])).otherwise(hi)
    df = docs.select("*", cell.alias("_k"), lo.alias("_lo"), hi.alias("_hi"))
    inner = F.floor((F.col("id").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * m)
    bucket = F.col("_k") * m + F.greatest(F.lit(0), F.least(F.lit(m - 1), inner))
    if ids < n:  # rows without an id are dealt by their texts' hashes
        spare = math.ceil((n - ids) / per)
        bucket = F.when(F.col("id").isNull(), -1 - F.floor((F.xxhash64("text") / 2.0 ** 64 + 0.5) * spare)).otherwise(bucket)
    return df.withColumn("_b", bucket.cast("bigint")).drop("_k", "_lo", "_hi"), size or 0


def neighbours(docs: DataFrame, per=PER_BUCKET, chain=CHAIN) -> DataFrame:
    """(id, text) rows with their signatures, the next row's text and signatures."""
    rows, size = _bucketed(docs, per)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    first = F.min(F.struct((-F.coalesce("id", F.lit(0))).alias("i"), F.when(F.col("id").isNull(), F.xxhash64("text")).alias("h")))
    heads = rows.groupBy("_b").agg(first.alias("_f"))
    order = Window.orderBy(F.desc("_b"))  # at most HEADS rows
    heads = heads.select((-F.col("_f.i")).alias("_i"), F.col("_f.h").alias("_h"), (F.col("_b") < 0).alias("_null"),
                         F.coalesce(F.lag("_b").over(order), F.min("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    is_head = (F.col("id").isNull() == F.col("_null")) & F.when(F.col("_null"), F.xxhash64("text") == F.col("_h")).otherwise(F.col("id") == F.col("_i"))
    key = F.coalesce("id", F.lit(0)) == F.col("_i")
    joined = rows.join(F.broadcast(heads), key & is_head, "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("halo"))
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("b"), F.lit(True).alias("halo"))))
    dealt = joined.select("id", "text", F.explode(copies).alias("_x")).select("id", "text", "_x.*").repartition(parts, "b")
    w = Window.partitionBy("b").orderBy("halo", F.desc_nulls_last("id"), F.xxhash64("text"))
    sigs = signatures(dealt, "text", "sigs", chain)
    return (sigs.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sigs", F.lead("sigs").over(w))
            .where(~F.col("halo")).drop("b", "halo"))


def edited(docs: DataFrame, id_col="doc_id", text_col="text", chain=CHAIN) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likenesses the query asks for."""
    df = neighbours(docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), chain=chain)
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    df = df.withColumn("changed", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    df = signatures(df, "changed", "new_sigs", chain)
    return df.select(F.col("id").alias(id_col), "n_chars", F.sha2("changed", 256).alias("edited_sha256"), written("sigs").alias("fingerprint"),
                     written("new_sigs").alias("edited_fingerprint"), likeness("sigs", "new_sigs").alias("near_edited"),
                     likeness("sigs", "next_sigs").alias("near_next"))


def search(docs: DataFrame, queries: DataFrame, threshold=0.8, id_col="doc_id", text_col="text", chain=CHAIN) -> DataFrame:
    """(query, match, likeness): for each query text the texts at least ``threshold`` alike, itself included.

    Sets are partitioned by length: partition k holds lengths whose logarithm to 1 / threshold has
    floor k, so a partner lies in the same partition or one beside it. Of each set only the first
    signatures are indexed, as many as a partner cannot miss, in the order of rising frequency.
    Texts with equal sets are compared once, as a class, and rejoined at the end.
    """
    def sets(df, name):
        return signatures(df.select(F.col(id_col).alias(name), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sigs", chain).drop("text")

    d, q = sets(docs, "match"), sets(queries, "query")
    freq = d.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    step = math.log(1 / threshold)

    def indexed(df):
        c = df.select("sigs").distinct().withColumn("cls", F.sha2(written("sigs"), 256)).withColumn("k", F.floor(F.log(F.size("sigs").cast("double")) / step + 1e-9))
        x = c.select("cls", "k", F.size("sigs").alias("len"), F.explode("sigs").alias("sig")).join(freq, "sig", "left")
        x = x.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.coalesce("n", F.lit(0)), "sig")))
        return c, x.where(F.col("r") <= F.col("len") - F.ceil(F.col("len") * threshold - 1e-9) + 1).select("cls", "k", "len", "sig")

    (dc, dx), (qc, qx) = indexed(d), indexed(q)
    qx = qx.select(F.col("cls").alias("qcls"), "sig", F.col("len").alias("qlen"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    found = (qx.join(dx, ["k", "sig"]).where(F.least("len", "qlen") >= threshold * F.greatest("len", "qlen")).select("qcls", "cls").distinct()
             .join(dc.select("cls", F.col("sigs").alias("a")), "cls").join(qc.select(F.col("cls").alias("qcls"), F.col("sigs").alias("b")), "qcls")
             .withColumn("likeness", likeness("a", "b", threshold)).where(F.col("likeness") >= threshold).select("qcls", "cls", "likeness"))
    name = lambda df, c: df.withColumn(c, F.sha2(written("sigs"), 256)).drop("sigs")
    return name(q, "qcls").join(found, "qcls").join(name(d, "cls"), "cls").select("query", "match", "likeness")
