import json
import math

import pytest

from spatialq import config
from spatialq.plans import run
from spatialq.sources import results

SMALL = {"data": {"source": "synthetic", "n_cells": 100, "n_genes": 4, "sigma": 0.05, "seed": 3}, "test": {"n_perms": 4, "n_reruns": 1, "epochs": 40, "lr": 0.02, "decoder": "quadratic"}}


def test_defaults_aliases_and_seed():
    c = config.parse({"data": {"table": "t", "seed": 9, "covariate_whitening": {"method": "nested-covariate", "column": "q"}}, "test": {"metric": "nll", "block_shape": "hexagonal"}})
    assert c.test["seed"] == 9 and c.test["metric"] == "nll_gaussian_mse" and c.test["block_shape"] == "hexagon"
    assert c.data["covariate_whitening"]["method"] == "loss-difference" and c.test["n_perms"] == 100
    assert config.parse({"data": {"table": "t", "seed": 9}, "test": {"seed": 1}}).test["seed"] == 1


@pytest.mark.parametrize(
    "raw",
    [
        {"data": {}}, {"data": {"table": "t", "gene_list": ["A"], "top_var_genes": 5}}, {"data": {"table": "t"}, "test": {"metric": "pearson"}},
        {"data": {"table": "t", "log1p": True}, "test": {"metric": "poisson"}}, {"data": {"table": "t"}, "test": {"method": "block_permutation"}},
        {"data": {"table": "t"}, "test": {"n_perms": 0}}, {"data": {"table": "t"}, "test": {"delta": [-1]}}, {"data": {"table": "t"}, "test": {"alpha": 1.0}},
        {"data": {"table": "t", "cell_type": "together"}, "test": {"method": "fourier_spectral_randomization"}}, {"data": {"source": "x"}},
        {"data": {"table": "t", "covariate_whitening": {"method": "loss-difference", "column": "q"}}, "test": {"method": "cross_validation"}},
    ],
)
def test_invalid_values(raw):
    with pytest.raises(ValueError):
        config.parse(raw)


def test_unknown_keys():
    for raw in ({"data": {"nope": 1}}, {"other": {}}):
        with pytest.raises(TypeError):
            config.parse(raw)


def test_overrides_and_files(tmp_path):
    (tmp_path / "c.json").write_text('{"data": {"table": "./x"}, "test": {"n_perms": 7}}')
    c = config.load(str(tmp_path / "c.json"), {"test": {"n_perms": 8}})
    assert c.test["n_perms"] == 8 and c.data["table"] == str(tmp_path / "x")


def test_runs(spark, tmp_path):
    r = run.run(spark, config.parse(SMALL))
    row = r.first()
    assert row.p_value == pytest.approx(0.2) and row.n_cells == 100 and len(row.stat_perm) == 4
    results.write_results(r, str(tmp_path / "r"))
    assert results.read_results(spark, str(tmp_path / "r")).count() == 1


@pytest.mark.parametrize(
    "test", [{"method": "cross_validation", "n_folds": 2}, {"method": "block_permutation", "block_radius": 0.2}, {"method": "perturbation_test", "delta": [0.1, 0.3]}, {"method": "subsampling_test"}, {"method": "comparison_perturbation_test", "metric": "spearman"}, {"method": "comparison_subsampling_test"}, {"method": "joint_truncated_msr", "msr_neighbor_radius_um": 0.6, "msr_truncate_um": 0.3}, {"method": "binning", "bin_spot_distance_um": 0.3}, {"method": "fourier_spectral_randomization"}]
)
def test_methods(spark, test):
    row = run.run(spark, config.parse(config.merged(SMALL, {"test": {"n_perms": 2, "n_nulls": 2, "epochs": 4, **test}}))).first()
    assert 0 < row.p_value <= 1 and row.method == test["method"] and len(row.stat_perm) == 2
    parts = {"perturbation_test": test.get("delta"), "comparison_perturbation_test": [0.05], "subsampling_test": [0.5, 0.7, 0.9], "comparison_subsampling_test": [0.5, 0.7, 0.9]}.get(test["method"])
    assert parts is None or sorted(map(float, json.loads(row.artifacts["parts"]))) == parts


def test_metrics_and_radii_of_runs(spark):
    base = {"test": {"n_perms": 1, "epochs": 3}}
    nll, mse = (run.run(spark, config.parse(config.merged(SMALL, {"test": {**base["test"], "metric": m}}))).first() for m in ("nll", "mse"))
    n = nll.n_cells * nll.n_genes
    assert nll.stat_true == pytest.approx(n / 2 * math.log(2 * math.pi * mse.stat_true) + n / 2, rel=1e-9)
    assert run.spot_radius(6.0, "square") == 3.0 and run.spot_radius(6.0, "hexagon") == pytest.approx(6 / math.sqrt(3))


def test_recursive_runs(spark, tmp_path):
    raw = config.merged(SMALL, {"test": {"n_perms": 9, "epochs": 20, "lr": 0.05, "recursive": True, "max_gradients": 1, "alpha": 0.5}})
    row = run.run(spark, config.parse(raw)).first()
    assert "svg" in row.artifacts
    found = spark.createDataFrame([(2, "b", 0.1, 0.2), (1, "c", 0.3, 0.4), (1, "a", 0.01, 0.04)], "gradient int, gene string, p_value double, q_value double")
    results.write_svg(found, str(tmp_path / "all"))
    assert [r.gene for r in spark.read.option("header", True).csv(str(tmp_path / "all")).collect()] == ["a", "c", "b"]
    results.write_significant(found, str(tmp_path / "some"))
    assert [r.gene for r in spark.read.option("header", True).csv(str(tmp_path / "some")).collect()] == ["a"]
    with pytest.raises(ValueError, match="recursive"):
        config.parse(config.merged(raw, {"test": {"method": "binning"}}))


def test_table_source_with_filters_and_types(spark, tmp_path):
    from pyspark.sql import functions as F

    from spatialq.sources import synthetic

    cells = synthetic.lattice(spark, 10).withColumn("cell_type", F.when(F.col("x") < 0.5, "a").otherwise("b")).withColumn("q", F.col("y"))
    results.write_cells(cells, synthetic.manifold(cells, "radial", 3, 0.1, 1), str(tmp_path))
    raw = {"data": {"table": str(tmp_path), "cell_type": "separate", "obs_numeric_filters": {"q": {"lt": 0.9}}, "exclude_gene_patterns": ["3$"]}, "test": {"n_perms": 2, "n_reruns": 1, "epochs": 5, "decoder": "linear", "moran": True, "moran_neighbor_radius_um": 1.0}}
    rows = run.run(spark, config.parse(raw)).collect()
    assert [r.n_cells for r in rows] == [45, 45] and all(r.n_genes == 2 and "moran_mean" in r.artifacts for r in rows)


def test_batches_and_warm_up_reach_the_plan():
    c = config.parse({"data": {"table": "t"}, "test": {"metric": "poisson", "sgd_batch_size": 128, "sgd_cosine_lr_decay": True, "sgd_cosine_eta_min": 1e-5, "gaussian_pretrain_epochs": 7, "gaussian_pretrain_freeze_encoder": True}})
    p = run.plan_of(c)
    assert (p.batch, p.cosine, p.least_rate, p.warm, p.freeze) == (128, True, 1e-5, 7, True)
    for bad in ({"sgd_cosine_lr_decay": True}, {"sgd_batch_size": -1}, {"gaussian_pretrain_epochs": 3}):
        with pytest.raises(ValueError):
            config.parse({"data": {"table": "t"}, "test": bad})


def test_block_runs_of_types_together_have_a_mesh_each(spark, monkeypatch):
    from spatialq.operators import nulls

    seen = []
    real = nulls.block_permutation
    monkeypatch.setattr(run.N, "block_permutation", lambda *a: seen.append(a[6]) or real(*a))
    monkeypatch.setattr(run.T, "fit_slots", lambda *a, **k: None)
    monkeypatch.setattr(run.T, "statistics", lambda *a: spark.createDataFrame([(0, 1.0)], "slot int, stat double"))
    cells = spark.createDataFrame([(i, float(i), float(i % 3), "ab"[i % 2]) for i in range(12)], "cell_id long, x double, y double, cell_type string")
    expr = spark.createDataFrame([(i, "g", float(i)) for i in range(12)], "cell_id long, gene string, value double")
    for kind in ("together", False):
        c = config.parse({"data": {"table": "t", "cell_type": kind}, "test": {"method": "block_permutation", "block_radius": 1.0, "n_perms": 2}})
        run.losses(c, cells, expr)
    assert seen == [("cell_type",), ()]
