"""Set logic and reshaping of edge, score and expression tables."""

from pyspark.sql import functions as F


def melt_matrix(rows, names, symmetric=True, tfs=None):
    """Square matrix stored as one value array per gene to edges: the upper triangle, or every
    non-zero cell. ``rows`` is (idx, gene, vec), ``names`` is (idx, gene)."""
    e = rows.select("idx", F.col("gene").alias("source"), F.posexplode("vec").alias("pos", "weight"))
    e = e.where(F.col("idx") < F.col("pos")) if symmetric else e.where("weight != 0")
    e = e.join(names.select(F.col("idx").alias("pos"), F.col("gene").alias("target")), "pos")
    if tfs is not None:
        e = e.join(tfs.select(F.col("tf").alias("source")), "source", "left_semi")
    return e.select("source", "target", "weight")


def pivot_edges(edges, names):
    """Edges to a dense target x source table with zeros."""
    return edges.groupBy("target").pivot("source", list(names)).agg(F.avg("weight")).fillna(0.0)


def melt_edges(wide, names):
    """Dense table back to edges, zeros dropped."""
    return wide.unpivot(["target"], list(names), "source", "weight").where("weight != 0").select("source", "target", "weight")


def tag_union(parts):
    """Union of (tag, table) pairs with a model column."""
    out = None
    for tag, df in parts:
        d = df.withColumn("model", F.lit(tag))
        out = d if out is None else out.unionByName(d)
    return out


def union_distinct(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def combine_codes(df, cols, out="grp"):
    """Several label columns to one mixed-radix code, in column order."""
    from netloom.operators.filters import encode
    code, total = F.lit(0).cast("bigint"), df
    for c in cols:
        total = encode(total, c, f"_{c}")
        size = df.select(F.count_distinct(c)).scalar()
        total = total.withColumn(f"_n_{c}", size)
        code = code * F.col(f"_n_{c}") + F.col(f"_{c}")
    return total.withColumn(out, code).select(*df.columns, out)
