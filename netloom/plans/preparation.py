"""End-to-end preparation plans: single cells, pseudobulk, ground truths, priors, traces."""

from pyspark.sql import DataFrame, functions as F

from netloom.operators import edges as E, expression as X, filters as O, intervals as I, nulls as Z, ranking as R
from netloom.session import cut


def process_single_cell(expr, obs, pert_gene=None, kind="cytokine", split=None, min_cells_per_pert=10, min_cells_per_gene=10,
                        min_genes_per_cell=200, path=None):
    """Normalise, keep effective perturbations, filter cells and genes, split. Returns the full
    table and both sides, in counts and lognorm, with the groups of the split; writes them when
    ``path`` is given. ``split`` maps obs to (split, perturbation)."""
    obs = X.qc_effect(X.lognorm(expr), obs, pert_gene, kind) if kind != "cytokine" else obs
    kept = cut(O.qc_perturbation(expr, obs, min_cells_per_pert, min_cells_per_gene, min_genes_per_cell), "cells")
    obs = cut(obs.join(kept.select("obs_id").distinct(), "obs_id", "left_semi"), "obs")
    groups = cut((split or Z.split_perturbations)(obs), "groups")
    norm = X.lognorm(kept)
    both = norm.join(obs.select("obs_id", "perturbation"), "obs_id").join(groups, "perturbation").select("split", "obs_id", "gene", "value")
    out = {"counts": kept, "lognorm": norm, "split": both, "obs": obs, "groups": groups}
    if path:
        kept.withColumn("layer", F.lit("counts")).unionByName(norm.withColumn("layer", F.lit("lognorm"))).write.mode("overwrite").partitionBy("layer").parquet(f"{path}/expr")
        both.write.mode("overwrite").partitionBy("split").parquet(f"{path}/split")
        groups.write.mode("overwrite").parquet(f"{path}/groups")
    return out


def process_bulk(expr, obs, groups, covariates, min_cells=10):
    """Pseudobulk by covariates, normalised, tagged with the side(s) of the split."""
    o = obs.withColumn("bulk_id", O.group_key(*covariates))
    bulk, meta = X.pseudobulk(expr, o, "bulk_id", min_cells)
    norm = X.lognorm(bulk.withColumnRenamed("bulk_id", "obs_id"))
    side = meta.join(groups, "perturbation").select(F.col("bulk_id").alias("obs_id"), "split", "cell_count")
    return norm.join(side, "obs_id").select("split", "obs_id", "gene", "value", "cell_count")


def build_ground_truth(peaks, tss, terms=None, up=1000, down=100):
    """Ground-truth edges per cell type from binding peaks, and their counts."""
    p = peaks if terms is None else O.match_terms(peaks, "cell_type", terms)
    e = cut(I.peaks_near_tss(p, tss, up, down, ["cell_type"]), "truth")
    counts = e.groupBy("cell_type").agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_tfs"), F.count_distinct("target").alias("n_targets"))
    return e, counts


def refresh_consensus(edges: DataFrame, genes, tfs):
    """Both consensus tables over all models: (kind, name, theta, n)."""
    a = E.consensus_regulators(edges, genes).select(F.lit("regulators").alias("kind"), F.col("gene").alias("name"), "theta", "n")
    b = E.consensus_edges(edges, tfs).select(F.lit("edges").alias("kind"), F.col("source").alias("name"), "theta", F.col("value").alias("n"))
    return a.unionByName(b)


def trace_report(trace):
    """Latest-run tasks per data set with file, task and method counts. A data set is the part
    of the task label after the dot."""
    ds = F.substring_index(F.regexp_extract("name", r"\(([^)]+)\)", 1), ".", -1)
    done = trace.where("status = 'COMPLETED'").withColumn("dataset", ds)
    a = done.groupBy("dataset").agg(F.count_distinct("source_file").alias("trace_files"), F.count("*").alias("completed_tasks"),
                                    F.count_distinct(F.regexp_extract("name", r"\(([^)]+)\)", 1)).alias("unique_methods"))
    b = R.latest_run(trace).withColumn("dataset", ds).groupBy("dataset").agg(F.count("*").alias("output_tasks"))
    return a.join(b, "dataset")
