"""Table contracts. Inputs are checked against these, never inferred."""

from pyspark.sql import DataFrame


EXPR = "dataset_id string, obs_id string, gene string, layer string, value double"
EDGES = "source string, target string, weight double"
PREDICTION = "dataset_id string, method_id string, source string, target string, weight string, cell_type string"
SCORES = "dataset string, model string, metric string, value double"
SCORE_FILE = "dataset_id string, method_id string, metric_ids array<string>, metric_values array<string>"
PEAKS = "chrom string, start bigint, end bigint, tf string"
GENE_SETS = "library string, set_name string, description string, genes array<string>"
GTF = ("chrom string, src string, feature string, start bigint, end bigint, score string, "
       "strand string, frame string, attributes string")


def names(ddl):
    """Column names of a flat DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip().split(" ")[0])
            start = i + 1
    return out


def require(df: DataFrame, cols, what="table") -> DataFrame:
    """Fail early, before any job runs, when a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df
