"""User extension points: inference methods, metrics and split rules by name."""

from pyspark.sql import DataFrame, functions as F

from netloom.plans import metrics as M
from netloom.operators import nulls
from netloom.operators.blocks import attach_all
from netloom.plans.config import CV_COLUMN, DATASET_FAMILIES, DATASET_GROUPS, FAMILY_METRICS, modality

METHODS, METRICS, SPLITS, KEYED = {}, {}, {}, set()


def register_method(name, fn):
    """``fn(expr, obs, tfs, **params) -> (source, target, weight)``."""
    METHODS[name] = fn
    return fn


def register_metric(name, fn, keyed=False):
    """``fn(edges, context) -> (metric, value)``; ``context`` is a dict of tables and settings. A ``keyed``
    metric is ``fn(edges, context, keys) -> (keys, metric, value)`` and scores many networks at once."""
    METRICS[name] = fn
    (KEYED.add if keyed else KEYED.discard)(name)
    return fn


def register_split(name, fn):
    """``fn(obs) -> (split, perturbation)``."""
    SPLITS[name] = fn
    return fn


def infer(name, expr, obs, tfs, dataset=None, **params) -> DataFrame:
    """Edges of a registered method, tagged for the prediction table."""
    e = METHODS[name](expr, obs, tfs, **params)
    return e.select(F.lit(dataset).alias("dataset_id"), F.lit(name).alias("method_id"), "source", "target", "weight")


def settings(dataset):
    """The dataset's metadata columns under the names that metrics ask for."""
    g = DATASET_GROUPS.get(dataset, {})
    named = {"strict": g.get("match"), "loose": g.get("loose_match"), "cv": g.get("cv"), "cv_column": CV_COLUMN.get(dataset)}
    return {k: v for k, v in named.items() if v}


def _scores(name, edges, context, keys):
    """(keys, metric, value) of one family."""
    fn = METRICS[name]
    if name in KEYED:
        return fn(edges, context, list(keys))
    if not keys:
        return fn(edges, context)
    out = None  # a metric of the user's that knows one network: a plan for each of a handful
    for r in edges.select(*keys).distinct().orderBy(*keys).collect():
        mine = edges
        for k in keys:
            mine = mine.where(F.col(k).eqNullSafe(F.lit(r[k])))
        part = fn(mine.drop(*keys), context).select(*[F.lit(r[k]).alias(k) for k in keys], "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(edges, context, families=None, dataset=None, keys=()) -> DataFrame:
    """All metrics that apply to a data set, as one long table (keys, metric, value, reason).

    ``keys`` are columns of ``edges`` that tell networks apart; the library's own metrics score all of
    them in one plan. ``context`` overrides what the configuration says about the data set. A metric
    whose input tables are missing has a row without value and the reason.
    """
    keys, context = list(keys), {**settings(dataset), **context}
    names = families or DATASET_FAMILIES.get(dataset, list(METRICS))
    out, lacking = None, []
    for n in names:
        missing = [k for k in NEEDS.get(n, ()) if k not in context] if n in METRICS else ["a registered metric"]
        if missing:
            lacking += [(m, None, f"missing: {', '.join(missing)}") for m in FAMILY_METRICS.get(n, [n])]
            continue
        part = _scores(n, edges, context, keys)
        if part is not None:
            part = part.select(*keys, "metric", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
            out = part if out is None else out.unionByName(part)
    if out is None and not lacking:
        raise ValueError(f"no metric of {names} has its inputs; context holds {sorted(context)}")
    if not lacking:
        return out
    rows = edges.sparkSession.createDataFrame(lacking, "metric string, value double, reason string")
    if keys:
        rows = attach_all(rows, edges.select(*keys).distinct()).select(*keys, "metric", "value", "reason")
    return rows if out is None else out.unionByName(rows)


def evaluate_all(predictions, contexts, families=None) -> DataFrame:
    """Scores of every (dataset, method) of a prediction table (dataset_id, method_id, source, target, weight):
    (dataset, modality, model, metric, value, reason). ``contexts`` maps data sets to their tables: one
    plan for each of them, with all its methods keyed."""
    out = None
    for d, context in contexts.items():
        e = predictions.where(F.col("dataset_id") == d).select(F.col("method_id").alias("model"), "source", "target", "weight")
        part = evaluate(e, context, families, d, keys=("model",)).select(F.lit(d).alias("dataset"), F.lit(modality(d)).alias("modality"), "model", "metric", "value", "reason")
        out = part if out is None else out.unionByName(part)
    return out


def split(name, obs) -> DataFrame:
    """(split, perturbation) by a registered rule."""
    return SPLITS[name](obs)


NEEDS = {
    "regression": ("expr", "obs", "tfs", "regulators"), "ws_distance": ("background", "edge_counts"), "tf_recovery": ("de",),
    "tf_binding": ("truths", "genes", "tfs"), "gs_recovery": ("sets", "expr", "obs", "tfs"), "replicate_consistency": ("expr", "groups"),
    "sem": ("expr", "obs", "strict", "loose", "cv", "early"), "vc": ("expr", "obs", "strict", "loose", "cv"),
}

register_metric("regression", lambda e, c, k: M.regression(e, c["expr"], c["obs"], c["tfs"], c["regulators"], c.get("cv_column"), keys=k), True)
register_metric("ws_distance", lambda e, c, k: M.ws_distance(e, c["background"], c["edge_counts"], keys=k), True)
register_metric("tf_recovery", lambda e, c, k: M.tf_recovery(e, c["de"], keys=k), True)
register_metric("tf_binding", lambda e, c, k: M.tf_binding(e, c["truths"], c["genes"], c["tfs"], k).where("gt = 'all'").select(
    *k, F.lit("tfb_f1").alias("metric"), F.col("f1").alias("value")), True)
register_metric("gs_recovery", lambda e, c, k: M.gs_recovery(e, c["sets"], c["expr"], c["obs"], c["tfs"], keys=k, genes=c.get("genes")).groupBy(*k).agg(
    F.avg("f1").alias("value")).select(*k, F.lit("gs_f1").alias("metric"), "value"), True)
register_metric("replicate_consistency", lambda e, c, k: M.replicate_consistency(e, c["expr"], c["groups"], keys=k), True)
register_metric("sem", lambda e, c, k: M.sem(e, c["expr"], c["obs"], c["strict"], c["loose"], c["cv"], c["early"], keys=k), True)
register_metric("vc", lambda e, c, k: M.vc(e, c["expr"], c["obs"], c["strict"], c["loose"], c["cv"], keys=k), True)

register_method("pearson_corr", lambda expr, obs, tfs, n=50_000: M.correlation_network(expr, obs, tfs, "pearson", n))
register_method("spearman_corr", lambda expr, obs, tfs, n=50_000: M.correlation_network(expr, obs, tfs, "spearman", n))
register_method("positive_control", METHODS["pearson_corr"])


def _negative(expr, obs, tfs, n=50_000, seed=0):
    from netloom.operators.edges import clean_edges
    from netloom.operators.nulls import negative_control
    return clean_edges(negative_control(expr.select("gene").distinct(), tfs, seed=seed), n)


def _boosted(expr, obs, tfs, n=50_000, **kw):
    from netloom.operators.edges import clean_edges
    from netloom.operators.boosting import boosted_importance
    return clean_edges(boosted_importance(expr, obs, tfs, **kw), n, tfs)


def _partial(expr, obs, tfs, n=50_000, k=10):
    from netloom.operators.edges import clean_edges
    from netloom.operators.expression import correlation
    from netloom.operators.fits import moments, partial_corr
    m = moments(expr, obs.select("obs_id", F.lit("all").alias("fold")))
    return clean_edges(partial_corr(correlation(expr, obs), m, k), n, tfs)


register_method("negative_control", _negative)
register_method("grnboost", _boosted)
register_method("ppcor", _partial)
register_split("perturbations", nulls.split_perturbations)
