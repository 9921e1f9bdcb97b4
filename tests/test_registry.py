"""Methods, metrics and splits by name, through the public calls."""

import pytest
from pyspark.sql import functions as F

from netloom.plans import registry as U


def tables(table):
    rows = [(f"o{i}", f"g{j}", float((i * (j + 3)) % 7)) for i in range(24) for j in range(6)]
    e = table([r for r in rows if r[2]], "obs_id string, gene string, value double")
    o = table([(f"o{i}", "c" if i % 3 == 0 else f"p{i % 3}", i % 3 == 0) for i in range(24)], "obs_id string, perturbation string, is_control boolean")
    return e, o, table([("g0",), ("g1",)], "tf string")


def test_infer_by_name(table):
    e, o, tfs = tables(table)
    got = U.infer("pearson_corr", e, o, tfs, dataset="op", n=5).collect()
    assert got and {r.source for r in got} <= {"g0", "g1"} and {r.method_id for r in got} == {"pearson_corr"} and {r.dataset_id for r in got} == {"op"}
    with pytest.raises(KeyError):
        U.infer("unknown", e, o, tfs)


def test_metrics_without_tables_are_named_not_dropped(table, monkeypatch):
    e, _, _ = tables(table)
    edges = table([("g0", "g2", 1.0)], "source string, target string, weight double")
    monkeypatch.setattr(U, "KEYED", set())
    monkeypatch.setitem(U.METRICS, "vc", lambda ed, c: ed.select(F.lit("vc").alias("metric"), F.lit(float(len(c["cv"]))).alias("value")))
    monkeypatch.setitem(U.NEEDS, "vc", ("expr", "cv"))
    got = {r.metric: (r.value, r.reason) for r in U.evaluate(edges, {"expr": e}, dataset="nakatake").collect()}
    assert got["vc"] == (1.0, None)  # cv comes from the data set's settings
    assert got["r_precision"][0] is None and "regulators" in got["r_precision"][1] and got["gs_f1"][1].startswith("missing")


def test_many_networks_in_one_table(table, monkeypatch):
    p = table([("op", "a", "x", "y", 1.0), ("op", "b", "x", "y", 2.0), ("norman", "a", "x", "y", 3.0)],
              "dataset_id string, method_id string, source string, target string, weight double")
    monkeypatch.setattr(U, "KEYED", set())
    monkeypatch.setitem(U.METRICS, "vc", lambda ed, c: ed.groupBy(F.lit("vc").alias("metric")).agg(F.sum("weight").alias("value")))
    monkeypatch.setitem(U.NEEDS, "vc", ())
    got = {(r.dataset, r.modality, r.model, r.value) for r in U.evaluate_all(p, {"op": {}, "norman": {}}, ["vc"]).collect()}
    assert got == {("op", "Multiomics", "a", 1.0), ("op", "Multiomics", "b", 2.0), ("norman", "Transcriptomics", "a", 3.0)}


def test_split_by_name(table):
    _, o, _ = tables(table)
    got = {(r.split, r.perturbation) for r in U.split("perturbations", o).collect()}
    assert ("train", "c") in got and ("test", "c") in got and len(got) == 4
