"""Pairs within a radius by tile, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialq.operators import moran, spatial, tiles


def no_pairs(*_, **__):
    raise AssertionError("pairs became rows")


def scattered(n, seed):
    """Cells with a clump of more than a block's cells at one place, in random order."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0, 1, (n, 2)), np.full((tiles.BLOCK + 40, 2), 0.25), rng.normal(-3, 0.2, (n // 4, 2))])
    return rng.permutation(xy)


def frame(spark, xy, slots=1):
    rows = [(s, i, float(x) + s * (i % 3), float(y)) for s in range(slots) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "slot int, cell_id long, x double, y double")


def apart(xy):
    dx, dy = xy[:, 0, None] - xy[None, :, 0], xy[:, 1, None] - xy[None, :, 1]
    return np.sqrt(dx * dx + dy * dy)


def measured(spark, v):
    return spark.createDataFrame([(i, f"g{j}", float(a)) for i, row in enumerate(v) for j, a in enumerate(row)], "cell_id long, gene string, value double")


def test_moran_without_a_pair_table(spark, monkeypatch):
    monkeypatch.setattr(moran, "radius_pairs", no_pairs)
    xy, r = scattered(400, 1), 0.3
    v = np.random.default_rng(2).normal(size=(len(xy), 2)) + xy
    e = measured(spark, v)
    z, means = v - v.mean(0), {}
    for slot in range(2):
        own = xy + np.stack([slot * (np.arange(len(xy)) % 3), np.zeros(len(xy))], 1)
        d = apart(own)
        pair = np.triu(d <= r, 1)
        m = np.sort(d[pair])[(pair.sum() - 1) // 2]
        w = np.where(d <= r, 1 / np.maximum(d, max(m * 1e-4, 1e-9)), 0)
        np.fill_diagonal(w, 0)
        means[slot] = len(xy) / w.sum() * np.einsum("ig,ij,jg->g", z, w, z) / (z * z).sum(0)
    got = {row.slot: row.moran for row in moran.moran_slots(frame(spark, xy, 2), e, r).collect()}
    assert got == pytest.approx({s: m.mean() for s, m in means.items()})
    one = {row.gene: row.moran for row in moran.morans_i(frame(spark, xy), e, r).collect()}
    assert one == pytest.approx({f"g{j}": a for j, a in enumerate(means[0])})
    assert moran.morans_i(frame(spark, [(0, 0), (9, 9)]), measured(spark, [[1], [2]]), r).first().moran is None


def test_variogram_without_a_pair_table(spark, monkeypatch):
    monkeypatch.setattr(moran, "radius_pairs", no_pairs)
    xy, r, bins = scattered(400, 3), 0.5, 6
    v = np.random.default_rng(4).normal(size=(len(xy), 3))
    z = (v - v.mean(0)) / (v.std(0) + 1e-8)
    d = apart(xy)
    i, j = np.nonzero(np.triu(d <= r, 1))
    b = np.minimum(np.floor(d[i, j] / (r / bins)), bins - 1)
    c = (z[i] * z[j]).mean(1)
    got = {row.bin: row for row in moran.variogram(frame(spark, xy), measured(spark, v), r, bins).collect()}
    assert set(got) == set(b)
    for k, row in got.items():
        assert row.n_pairs == (b == k).sum()
        assert (row.distance, row.covariance) == pytest.approx((d[i, j][b == k].mean(), c[b == k].mean()))


@pytest.mark.parametrize(("rows", "bins"), [(10, 4), (1, 8), (10**6, 16)])
def test_median_of_distances(spark, rows, bins):
    for xy in (scattered(200, 5), np.zeros((30, 2))):
        d = apart(xy)
        d = np.sort(d[np.triu(d <= 0.7, 1)])
        assert tiles.median_distances(frame(spark, xy), 0.7, "slot", rows, bins) == {0: d[(len(d) - 1) // 2]}
    assert tiles.median_distances(frame(spark, [(0, 0)]), 0.7) == {}


def test_dbscan_without_a_pair_table(spark, monkeypatch):
    """Clusters across tiles, with copies, noise, borders between clusters and cells without a place."""
    monkeypatch.setattr(spatial, "radius_pairs", no_pairs)
    xy = np.concatenate([scattered(300, 6), [(50.0 + k, 0.0) for k in range(12)], [(np.nan, 0.0), (0.0, np.nan)]])
    for r, least in ((0.3, 5), (1.0, 3)):
        d = apart(xy)
        d[np.isnan(d)] = np.inf
        np.fill_diagonal(d, 0)
        near = d <= r
        core = near.sum(1) >= least
        root = np.where(core, np.arange(len(xy)), len(xy))
        while True:
            low = np.where(core, np.where(near & core[None], root[None], len(xy)).min(1), len(xy))
            if (low == root).all():
                break
            root = low
        root = np.where(core, root, np.where(near & core[None], root[None], len(xy)).min(1))
        names = {v: k for k, v in enumerate(sorted(set(root[core])))}
        want = {i: names.get(v, -1) for i, v in enumerate(root)}
        assert {row.cell_id: row.cluster for row in spatial.dbscan(frame(spark, xy), r, least).collect()} == want


def test_nearest_match_by_tile(spark, monkeypatch):
    """Ties go to the lower id; a target on a candidate, and one without any, are answered."""
    monkeypatch.setattr(spatial, "near_tiles", no_pairs)
    xy = np.concatenate([scattered(300, 7), [(90.0, 0.0)]])
    a, b = np.arange(len(xy)) % 3 == 0, np.arange(len(xy)) % 3 != 0
    d = np.where(b[None], apart(xy), np.inf)
    c = frame(spark, xy)
    got = {row.cell_id: (row.match_id, row.d) for row in spatial.nearest_match(c.filter("cell_id % 3 = 0"), c.filter("cell_id % 3 <> 0"), 0.2).collect()}
    want = {int(i): (int(d[i].argmin()), float(d[i].min())) if d[i].min() <= 0.2 else (None, None) for i in np.flatnonzero(a)}
    assert got == want


def test_sparse_cells_share_wide_tiles(spark):
    """A tile is widened where a radius holds few cells; no pair across tiles is lost."""
    xy = np.random.default_rng(8).uniform(0, 40, (900, 2))
    c = frame(spark, xy)
    assert tiles.tile_side(c, 0.8) > 3 and tiles.tile_side(c, 20.0) < 20.1
    n = (apart(xy) <= 0.8).sum(1) - 1
    assert {row.cell_id: row.n for row in tiles.neighbour_counts(c, 0.8).collect()} == {i: k for i, k in enumerate(n) if k}
