"""Run configurations: three sections of plain values, checked before anything runs.

Unknown keys are errors. Old names are accepted and replaced. ``data.seed`` also seeds the
test unless the test has a seed of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: Keys of each section with their defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "data": {
        "source": "table", "table": None, "layer": None, "seed": 0,
        "obs_filters": None, "obs_numeric_filters": None, "obs_drop_na": None, "obs_indices": None, "max_cells": None,
        "exclude_gene_patterns": None, "gene_list": None, "top_var_genes": 0, "min_cells_per_gene": 0,
        "normalize_total": False, "log1p": False, "standardize_expression": True, "standardize_coordinates": True,
        "cell_type": False, "min_cells_per_celltype": 1, "covariate_whitening": None,
        "spatial_denoise_radius_um": None, "spatial_region_split": False, "spatial_region_split_eps": None,
        "spatial_region_split_eps_mult": 3.0, "spatial_region_split_min_samples": 10, "spatial_region_split_min_cells": 50, "spatial_crop": None,
        "mode": "radial", "n_cells": 900, "n_genes": 20, "sigma": 0.1, "shape": "square",
    },
    "test": {
        "method": "parallel_permutation", "metric": "nll_gaussian_mse", "decoder": "nn", "n_perms": 100, "n_nulls": 50, "n_reruns": 30, "epochs": 5000, "lr": 1e-3,
        "patience": 0, "seed": 0, "alpha": 0.05, "n_folds": 5, "delta": [0.05], "subset_fractions": [0.5, 0.7, 0.9],
        "block_radius": None, "block_shape": "hexagon", "block_jitter": True, "bin_shape": "hexagon", "bin_spot_distance_um": 100.0,
        "coordinate_um_per_unit": None, "msr_truncate_um": None, "msr_neighbor_radius_um": None, "moran": False, "moran_neighbor_radius_um": 30.0,
        "recursive": False, "max_gradients": 10,
        "sgd_batch_size": None, "sgd_cosine_lr_decay": False, "sgd_cosine_eta_min": 0.0, "gaussian_pretrain_epochs": 0, "gaussian_pretrain_freeze_encoder": False,
    },
    "output": {"out_dir": "results", "run_name": "permutation"},
}
#: Accepted names.
METRICS = {
    "nll": "nll_gaussian_mse", "nll_gaussian_mse": "nll_gaussian_mse", "nll_poisson_mse": "nll_poisson_mse", "poisson": "nll_poisson_mse", "mse": "mse",
    "pearson": "pearson_corr_mean", "pearson_corr": "pearson_corr_mean", "pearson_corr_mean": "pearson_corr_mean",
    "spearman": "spearman_corr_mean", "spearman_corr": "spearman_corr_mean", "spearman_corr_mean": "spearman_corr_mean",
}
TRAINED_METRICS = ("nll_gaussian_mse", "nll_poisson_mse", "mse")
METHODS = (
    "parallel_permutation", "full_retraining", "block_permutation", "binning", "fourier_spectral_randomization", "joint_truncated_msr",
    "joint_truncated_rank_msr", "cross_validation", "perturbation_test", "comparison_perturbation_test", "subsampling_test", "comparison_subsampling_test",
)
CHOICES = {
    ("data", "source"): ("table", "synthetic"), ("data", "mode"): ("radial", "checkerboard", "fourier", "noise"),
    ("data", "shape"): ("square", "circle", "semicircle", "triangle", "cutout"), ("data", "cell_type"): (False, "separate", "together"),
    ("test", "decoder"): ("linear", "quadratic", "nn"), ("test", "method"): METHODS,
    ("test", "block_shape"): ("square", "hexagon"), ("test", "bin_shape"): ("square", "hexagon"),
}
POSITIVE = {"data": ("n_cells", "n_genes", "min_cells_per_celltype", "spatial_region_split_min_samples"), "test": ("n_perms", "n_nulls", "n_reruns", "epochs", "lr", "bin_spot_distance_um", "moran_neighbor_radius_um", "max_gradients")}
WHITENING = {"freedman-lane": "freedman-lane", "freeman-lane": "freedman-lane", "freedman_lane": "freedman-lane", "loss-difference": "loss-difference", "loss_difference": "loss-difference", "nested-covariate": "loss-difference"}


@dataclass(frozen=True)
class RunConfig:
    data: dict[str, Any]
    test: dict[str, Any]
    output: dict[str, Any]

    def as_json(self) -> str:
        return json.dumps({"data": self.data, "test": self.test, "output": self.output}, sort_keys=True)


def merged(base: dict, extra: dict) -> dict:
    """base with extra's values; sections merge key by key."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def parse(raw: dict[str, Any], overrides: dict[str, Any] | None = None) -> RunConfig:
    raw = merged(raw, overrides or {})
    unknown = [f"{s}.{k}" for s, part in raw.items() for k in (part if s in DEFAULTS else {"": 0}) if s not in DEFAULTS or k not in DEFAULTS[s]]
    if unknown:
        raise TypeError(f"unknown keys: {', '.join(unknown)}")
    parts = {s: {**d, **raw.get(s, {})} for s, d in DEFAULTS.items()}
    if "seed" in raw.get("data", {}) and "seed" not in raw.get("test", {}):
        parts["test"]["seed"] = parts["data"]["seed"]
    if parts["test"]["metric"] not in METRICS:
        raise ValueError(f"unknown metric: {parts['test']['metric']}")
    parts["test"]["metric"] = METRICS[parts["test"]["metric"]]
    for s in ("block_shape", "bin_shape"):
        parts["test"][s] = {"hexagonal": "hexagon"}.get(parts["test"][s], parts["test"][s])
    w = parts["data"]["covariate_whitening"]
    if w is not None:
        if w.get("method") not in WHITENING or not w.get("column"):
            raise ValueError("covariate_whitening needs a known method and a column")
        parts["data"]["covariate_whitening"] = {**w, "method": WHITENING[w["method"]]}
    config = RunConfig(**parts)
    check(config)
    return config


def check(c: RunConfig) -> None:
    """Raise ValueError for values or combinations that cannot run."""
    for (s, k), allowed in CHOICES.items():
        if getattr(c, s)[k] not in allowed:
            raise ValueError(f"{s}.{k} must be one of {allowed}")
    for s, keys in POSITIVE.items():
        for k in keys:
            if getattr(c, s)[k] <= 0:
                raise ValueError(f"{s}.{k} must be positive")
    d, t = c.data, c.test
    rules = [
        (d["source"] == "table" and not d["table"], "data.table is needed"),
        (bool(d["gene_list"]) and d["top_var_genes"] > 0, "gene_list and top_var_genes exclude each other"),
        (t["metric"] not in (METRICS.values() if t["method"] == "comparison_perturbation_test" else TRAINED_METRICS), "trained tests take a loss metric"),
        (t["recursive"] and t["method"] not in ("parallel_permutation", "full_retraining"), "recursive runs permute coordinates"),
        (t["recursive"] and d["cell_type"] == "together", "recursive runs take one type at a time"),
        (("msr" in t["method"] or t["method"] == "fourier_spectral_randomization") and (d["cell_type"] == "together" or t["metric"] == "nll_poisson_mse"), "surrogates take Gaussian losses of one group"),
        (t["metric"] == "nll_poisson_mse" and (d["log1p"] or d["normalize_total"]), "Poisson losses need raw counts"),
        (t["method"] == "block_permutation" and not t["block_radius"], "block_permutation needs block_radius"),
        (t["method"] == "cross_validation" and t["n_folds"] < 2, "n_folds must be at least 2"),
        (t["method"] == "fourier_spectral_randomization" and d["cell_type"] is not False, "Fourier randomisation takes no cell types"),
        ((t["sgd_batch_size"] or 0) < 0 or t["gaussian_pretrain_epochs"] < 0, "batches and warm-up epochs are not negative"),
        (t["sgd_cosine_lr_decay"] and not t["sgd_batch_size"], "a falling rate needs sgd_batch_size"),
        (t["gaussian_pretrain_epochs"] and t["metric"] != "nll_poisson_mse", "a warm-up leads to the Poisson loss"),
        ("msr" in t["method"] and not t["msr_neighbor_radius_um"], "surrogates need msr_neighbor_radius_um"),
        (any(x <= 0 for x in t["delta"]), "delta must be positive"),
        (any(not 0 < x < 1 for x in t["subset_fractions"]), "subset fractions lie between 0 and 1"),
        (not 0 < t["alpha"] < 1, "alpha lies between 0 and 1"),
        (
            d["covariate_whitening"] is not None and d["covariate_whitening"]["method"] == "loss-difference" and t["method"] not in ("parallel_permutation", "full_retraining", "binning"),
            "loss-difference is defined for coordinate permutations only",
        ),
    ]
    for bad, message in rules:
        if bad:
            raise ValueError(message)


def load(path: str, overrides: dict[str, Any] | None = None) -> RunConfig:
    """A JSON file; relative table paths count from its folder."""
    raw = json.loads(Path(path).read_text())
    own = raw.get("data", {}).get("table")
    if own and own.startswith(("./", "../")):
        raw["data"]["table"] = str((Path(path).parent / own).resolve())
    return parse(raw, overrides)
