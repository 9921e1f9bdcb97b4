"""Dense matrices in square blocks: (keys, i, j, data) rows, ``data`` the bytes of a block of doubles.

A block is all a task holds; whole rows, columns or matrices never meet in one place.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.session import cut


def square(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(width, width)


def deal(items: DataFrame, blocks: int, width: int) -> DataFrame:
    """A place (block, pos) for every ``gene``; ``blocks * width`` places are enough for all.

    Items are numbered inside hash parts a tenth of a block large on average; the parts' sizes, a
    short table, give each part its first number, so no window orders all items.
    """
    parts = blocks * 10
    rows = items.select("gene", F.pmod(F.xxhash64("gene"), F.lit(parts)).alias("_p"))
    size = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = size.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy("gene")) - 1
    rows = rows.join(before, "_p").withColumn("_at", at)
    return cut(rows.select("gene", F.floor(F.col("_at") / width).cast("int").alias("block"), (F.col("_at") % width).cast("int").alias("pos")), "places")


def inverse(cells: DataFrame, keys=()) -> DataFrame:
    """Inverse of symmetric positive definite matrices, one per key, by Gauss-Jordan steps on blocks.

    Step k inverts the pivot block and updates every block from its row's block in column k and its
    column's block in row k, which it meets by joins. There are as many steps as blocks in a row; each
    is written, so a lost executor repeats one step only.
    """
    keys = list(keys)
    cells = cut(cells, "cells")
    n = (cells.agg(F.max("i")).first()[0] or 0) + 1 if not cells.isEmpty() else 0
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "i", "j", "data"])

    def pivoted(batches):
        """Row k over its pivot; the pivot's own place takes its inverse."""
        for pdf in batches:
            out = []
            for own, a, p in zip(pdf["own"], pdf["data"], pdf["pivot"]):
                width = int((len(a) // 8) ** .5)
                p = np.linalg.inv(square(p, width))
                out.append(((p + p.T) / 2 if own else p @ square(a, width)).tobytes())
            yield pdf[[*keys, "j"]].assign(row=out)

    def step(k):
        def work(batches):
            for pdf in batches:
                out = []
                for i, j, a, row, col in zip(*(pdf[c] for c in ("i", "j", "data", "row", "col"))):
                    width = int((len(a) // 8) ** .5)
                    row = square(row, width)
                    new = row if i == k else -square(a, width) @ row if j == k else square(a, width) - square(col, width) @ row
                    out.append(np.ascontiguousarray(new).tobytes())
                yield pdf[[*keys, "i", "j"]].assign(data=out)
        return work

    for k in range(n):
        at_row, at_col = F.col("i") == k, F.col("j") == k
        pivot = cells.where(at_row & at_col).select(*keys, "i", F.col("data").alias("pivot"))
        row = cells.where(at_row).join(pivot, [*keys, "i"]).select(*keys, "j", at_col.alias("own"), "data", "pivot")
        row = row.mapInPandas(pivoted, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "j"]) + ", row binary")
        col = cells.where(at_col).select(*keys, "i", F.col("data").alias("col"))
        met = cells.join(col, [*keys, "i"]).join(row, [*keys, "j"]).select(*keys, "i", "j", "data", "row", "col")
        cells = cut(met.mapInPandas(step(k), schema), "inverse-step")
    return cells
