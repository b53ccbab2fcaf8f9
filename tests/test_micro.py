"""Hand-computed micro inputs."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatialq.functions import networks, scalar, special, surrogates
from spatialq.operators import comparisons, decoders, expr, genes, graph, gsea, linkage, lowrank, masks, matched, metrics, modes, moran, nulls, ranks, rows, spatial, studies, trained
from spatialq.operators import surrogates as spectral
from spatialq.sources import gmt, results, synthetic


def cells(spark, xy, types=None):
    types = types or ["t"] * len(xy)
    return spark.createDataFrame([(i, float(x), float(y), t) for i, ((x, y), t) in enumerate(zip(xy, types))], "cell_id long, x double, y double, cell_type string")


def long(spark, a, names=None):
    names = names or [f"g{j}" for j in range(len(a[0]))]
    return spark.createDataFrame([(i, names[j], float(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "cell_id long, gene string, value double")


def wide(df):
    return {(r.cell_id, r.gene): r.value for r in df.collect()}


def test_square_binning(spark):
    out = spatial.bin_cells(cells(spark, [(1, 1), (2, 2), (11, 1)]), long(spark, [(1, 2), (3, 4), (5, 6)]), 5.0).collect()
    got = {(r.x, r.y, r.gene): (r.value, r.n_cells) for r in out}
    assert got == {(6.0, 6.0, "g0"): (4.0, 2), (6.0, 6.0, "g1"): (6.0, 2), (16.0, 6.0, "g0"): (5.0, 1), (16.0, 6.0, "g1"): (6.0, 1)}


def test_binning_by_type(spark):
    out = spatial.bin_cells(cells(spark, [(1, 1), (2, 2)], ["a", "b"]), long(spark, [(1, 0), (0, 2)]), 5.0, keys=("cell_type",)).collect()
    assert {(r.cell_type, r.gene, r.value, r.x, r.y) for r in out} == {("a", "g0", 1.0, 6.0, 6.0), ("a", "g1", 0.0, 6.0, 6.0), ("b", "g0", 0.0, 6.0, 6.0), ("b", "g1", 2.0, 6.0, 6.0)}


def test_pseudo_spots_read_the_items_once(spark, monkeypatch):
    """Also their sums are those of the counts by cell."""
    import __spark_entry__ as entry
    from spatialq import bindings

    d, read, seen = "/root/testdata/sf0.001", bindings.read, spark.sparkContext.accumulator(0)
    note = F.udf(lambda _: seen.add(1) or True, "boolean").asNondeterministic()
    monkeypatch.setattr(bindings, "read", lambda s, d, t: read(s, d, t).filter(note("l_orderkey")) if t == "lineitem" else read(s, d, t))
    assert entry.queries()["binning_test"](spark, d).count() == 1
    assert seen.value == read(spark, d, "lineitem").count()
    by_cell = spatial.bin_cells(bindings.count_cells(spark, d), bindings.count_expr(spark, d), 500.0)
    by_bin = spatial.bin_cells(bindings.count_cells(spark, d), lambda b: bindings.count_rows(spark, d, b), 500.0)
    assert sorted(by_cell.collect()) == sorted(by_bin.collect())


def test_gene_support(spark):
    e = long(spark, [(1, 0, 3), (0, 0, 1), (1, 1, 0)])
    assert {r.gene for r in genes.min_cells(e, 2).select("gene").distinct().collect()} == {"g0", "g2"}
    assert genes.min_cells(e, 0) is e


def test_cpm_and_guards(spark):
    got = wide(expr.cpm(long(spark, [(2, 3), (10, 0), (0, 0)])))
    assert got[0, "g0"] + got[0, "g1"] == pytest.approx(1e6) and got[1, "g0"] == pytest.approx(1e6) and got[2, "g0"] == 0
    with pytest.raises(Exception, match="negative"):
        expr.cpm(long(spark, [(-1, 2)])).collect()
    with pytest.raises(Exception, match="negative"):
        expr.log1p(long(spark, [(-0.5,)])).collect()


def test_log_then_zscore(spark):
    a = np.log1p(np.array([(0, 3), (1, 7), (3, 15)], float))
    want = (a - a.mean(0)) / (a.std(0) + 1e-8)
    got = wide(expr.zscore(expr.log1p(long(spark, [(0, 3), (1, 7), (3, 15)]))))
    assert all(got[i, f"g{j}"] == pytest.approx(want[i, j]) for i in range(3) for j in range(2))


def test_type_residuals(spark):
    c = cells(spark, [(0, 0)] * 4, ["a", "a", "b", "b"])
    got = wide(expr.residuals(long(spark, [(1, 10), (3, 14), (20, 2), (24, 6)]), c))
    assert [(got[i, "g0"], got[i, "g1"]) for i in range(4)] == [(-1, -2), (1, 2), (-2, -2), (2, 2)]


def test_moran_graph(spark):
    got = moran.morans_i(cells(spark, [(0, 0), (10, 0), (20, 0)]), long(spark, [(1,), (1,), (0,)]), 30.0).first()
    assert got.moran == pytest.approx(-0.4)


def test_moran_slots_rank(spark):
    s = spark.createDataFrame([(0, 0.75), (1, 0.15), (2, 0.2)], "slot int, moran double")
    r = moran.lower_rank_p(s).first()
    assert r.stat_true == 0.75 and r.p_value == 1.0 and r.p_upper == pytest.approx(1 / 3)


def test_fold_weighting(spark):
    f = spark.createDataFrame([("t", 0.3, 0.0), ("t", 0.7, 4.0), ("a", 0.3, 1.0), ("a", 0.7, 3.0), ("b", 0.3, 2.0), ("b", 0.7, 8.0)], "k string, n double, loss double")
    assert {r.k: r.loss for r in studies.weighted_loss(f, ["k"]).collect()} == pytest.approx({"t": 2.8, "a": 2.4, "b": 6.2})


def test_folds(spark):
    f = nulls.kfold(cells(spark, [(i, 0) for i in range(10)]), 3, 1)
    assert sorted((r["count"] for r in f.groupBy("fold").count().collect()), reverse=True) == [4, 3, 3]
    with pytest.raises(ValueError):
        nulls.kfold(cells(spark, [(0, 0)]), 1, 1)


def test_masked_loss(spark):
    d = spark.createDataFrame([(0, 1.0, 0.0), (0, 2.0, 1.0), (1, 3.0, 1.0), (1, 4.0, 2.0)], "cell_id long, predicted double, value double")
    mask = spark.createDataFrame([(0,)], "cell_id long")
    assert metrics.masked_losses(d, mask, []).first().mse == 1.0
    with pytest.raises(Exception, match="empty mask"):
        metrics.masked_losses(d, mask.limit(0), []).collect()


def test_ranks_and_permutation_p(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, 1.0)], "i int, v double")
    assert {r.i: r.r for r in ranks.with_average_rank(d, "v", []).collect()} == {1: 2.5, 2: 4.0, 3: 2.5, 4: 1.0}
    s = spark.createDataFrame([(0, 0.05), (1, 0.1), (2, 0.2), (3, 0.3)], "slot int, stat double")
    assert metrics.permutation_p(s, []).first().p_value == 0.25
    t = spark.createDataFrame([(0, 0.9), (1, 0.2), (2, 0.3), (3, 0.4)], "slot int, stat double")
    assert metrics.permutation_p(t, [], higher_is_better=True).first().p_value == 0.25


def test_ranks_in_buckets_equal_plain_ranks(spark):
    from spatialq.functions.portable import order_key

    d = spark.range(300).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("k"))
    a = ranks.hash_rank(d, ["k"], order_key(1, "cell_id"), "cell_id", rows=150, per_task=10)
    b = ranks.hash_rank(d, ["k"], order_key(1, "cell_id"), "cell_id", rows=150)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    a, b = ranks.id_rank(d, ["k"], "cell_id", 150, 10), ranks.id_rank(d, ["k"], "cell_id", 150)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_value_ranks_in_buckets_equal_plain_ranks(spark):
    rng = np.random.default_rng(4)
    rows_ = [(i, i % 2, float(rng.integers(0, 40)), float(rng.uniform())) for i in range(300)]
    d = spark.createDataFrame(rows_, "cell_id long, k int, value double, p double")
    for per_task in (10**6, 7):
        got = {r.cell_id: r.r for r in ranks.with_average_rank(d, "value", ["k"], per_task=per_task).collect()}
        for i, k, v, _ in rows_:
            own = [x[2] for x in rows_ if x[1] == k]
            assert got[i] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
        q = {r.cell_id: r.q_value for r in ranks.bh_qvalues(d, "p", ("k",), per_task).collect()}
        for k in (0, 1):
            own = sorted((x[3], x[0]) for x in rows_ if x[1] == k)
            low = 1.0
            for rank, (p, i) in reversed(list(enumerate(own, 1))):
                low = min(low, p * len(own) / rank)
                assert q[i] == pytest.approx(low)
        m = ranks.rank_match(d.select("k", "cell_id", F.col("p").alias("value")), d.select("k", "cell_id", "value"), ["k"], per_task).collect()
        for k in (0, 1):
            own = sorted((r for r in m if r.k == k), key=lambda r: (rows_[r.cell_id][2], r.cell_id))
            assert [r.value for r in own] == sorted(x[3] for x in rows_ if x[1] == k)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2.5, "a"), (7, float("nan"), "b"), (None, float("inf"), "7")], "i int, x double, s string").write.parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t")
    assert rows.filter_equal(d, {"i": 7}).count() == 1 and rows.filter_equal(d, {"i": "07"}).count() == 0 and rows.filter_equal(d, {"s": 7}).count() == 1
    f = rows.filter_range(rows.filter_equal(d, {"i": 1, "s": "a"}), {"x": {"ge": 2, "ne": 3}})
    assert f.count() == 1 and rows.filter_range(d, {"i": {"lt": 5}}).count() == 1 and rows.filter_range(d, {"x": {"ne": 3}}).count() == 1 and rows.filter_range(d, {"i": {"gt": 1.5}}).count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = f._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(x in plan for x in ("EqualTo(i,1)", "EqualTo(s,a)", "GreaterThanOrEqual(x,2.0)"))


def test_lower_median_in_rounds(spark):
    d = spark.range(1001).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 997 / 3.0).alias("v"))
    d = d.unionByName(spark.createDataFrame([(5, 2.0), (5, 2.0), (5, 2.0)], "k long, v double"))
    want = {k: sorted(x.v for x in d.collect() if x.k == k) for k in (0, 1, 5)}
    for rows_ in (10, 200_000):
        got = {r.k: r.median for r in ranks.lower_median(d, "k", "v", exact_rows=rows_, bins=8).collect()}
        assert got == {k: v[(len(v) - 1) // 2] for k, v in want.items()}


def test_block_offsets(spark):
    xy = [(0, 0), (1, 0), (0, 1), (100, 100), (101, 100), (100, 101)]
    s = nulls.block_permutation(cells(spark, xy), 3, 2, 25.0, jitter=False).toPandas()
    for slot, rows_ in s.groupby("slot"):
        p = rows_.sort_values("cell_id")[["x", "y"]].to_numpy()
        for part in (p[:3], p[3:]):
            assert np.allclose(part - part.mean(0), np.array(xy[:3]) - np.mean(xy[:3], 0))
        if slot == 0:
            assert np.allclose(p, xy)


def test_square_ids_decode_negative_indices(spark):
    df = spark.createDataFrame([(i, j, (i + 0.5) * 100.0, (j + 0.5) * 100.0) for i in range(3) for j in (0, 1, -1)], "i long, j long, x double, y double")
    u, v = scalar.unpack(scalar.square_bin(F.col("x"), F.col("y"), 50.0))
    assert all(r.i == r.u and r.j == r.v for r in df.select("i", "j", u.alias("u"), v.alias("v")).collect())


def test_gene_filters(spark):
    g = spark.createDataFrame([(x,) for x in ("MT-CO1", "RPL41", "MALAT1", "HSPA1A", "ACTB")], "gene string")
    assert [r.gene for r in genes.exclude_genes(g, ["^MT-", "^RPL", "^MALAT1$", "^HSP"]).collect()] == ["ACTB"]
    p = spark.createDataFrame([("ACTB",), ("MALAT1",), ("NOT_PRESENT",)], "gene string")
    assert {r.gene for r in genes.panel(g, p).collect()} == {"ACTB", "MALAT1"}
    assert [r.gene for r in genes.panel_missing(g, p).collect()] == ["NOT_PRESENT"]


def test_row_filters(spark):
    d = spark.createDataFrame([("1", "a"), ("x", "a"), ("NaN", "a"), ("3", "b"), (None, "a"), ("Infinity", "a")], "v string, t string")
    assert [r.v for r in rows.filter_range(d, {"v": {"ne": 3}}).collect()] == ["1"]
    assert rows.filter_equal(d, {"t": "b"}).count() == 1
    with pytest.raises(ValueError, match="missing"):
        rows.filter_equal(d, {"nope": 1})
    with pytest.raises(ValueError, match="no rows"):
        rows.some_rows(d.limit(0))


def test_study_rates(spark):
    r = studies.rates(spark.createDataFrame([("c", 0.01), ("c", 0.5)], "k string, p_value double"), ["k"], 0.05).first()
    assert (r.n, r.n_reject, r.rate) == (2, 1, 0.5) and 0 <= r.lo < r.hi <= 1


def test_bh_with_ties(spark):
    p = [0.01, 0.04, 0.04, 0.5]
    got = [r.q_value for r in ranks.bh_qvalues(spark.createDataFrame([(x,) for x in p], "p_value double")).orderBy("p_value").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_gmt_lines(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("SET A\turl\tG1\tG2\tG1\nB url G3\nshort x\n")
    got = sorted(map(tuple, gmt.read_gmt(spark, str(tmp_path / "a.gmt")).collect()))
    assert got == [("B", "G3"), ("SET A", "G1"), ("SET A", "G2")]


def test_two_blobs(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal((-2, 0), 0.15, (40, 2)), rng.normal((2, 0), 0.15, (40, 2)), rng.uniform(-6, 6, (8, 2))])
    got = spatial.dbscan(cells(spark, xy.tolist()), 0.5, 3).toPandas().sort_values("cell_id")["cluster"].to_numpy()
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= 0.5
    core = near.sum(1) >= 3
    assert len(set(got[:40])) == 1 and len(set(got[40:80])) == 1 and got[0] != got[40]
    assert all(got[i] >= 0 for i in np.flatnonzero(core)) and (got == -1).any()


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.uniform(-5, 5, (40, 2)), [[100, 100]]])
    got = spatial.knn(cells(spark, xy.tolist()), 5).toPandas()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 5 * len(xy)
    for i, r in got.groupby("i"):
        assert np.allclose(np.sort(r["d"]), np.sort(d[i])[:5])


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98)], "a long, b long")
    got = dict(map(tuple, graph.components(e).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[99] == 98


def test_tails():
    for f, d in ((0.5, 10.0), (3.0, 40.0), (60.0, 200.0)):
        assert special.f_tail(np.array([f]), 2, np.array([d]))[0] == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-10)
    assert special.pearson_p(np.array([0.0, 1.0, 0.3]), np.array([10, 10, 2])).tolist() == [1.0, 0.0, 1.0]
    assert special.incomplete_beta(0.5, 2, 2) == pytest.approx(0.5)


def test_poisson_irls_sums_equal_one_array(spark):
    """Rounds of sums over the cells against the fit of whole arrays."""
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=40), rng.uniform(1, 3, 40)
    y = np.stack([rng.poisson(e * np.exp(0.3 + 0.8 * x)), rng.poisson(4, 40), np.zeros(40)], 1)
    df = long(spark, y).join(spark.createDataFrame([(i, float(x[i]), float(e[i])) for i in range(40)], "cell_id long, z double, exposure double"), "cell_id")
    for degree in (1, 2):
        got = {r.gene: r for r in decoders.poisson_irls(df.repartition(4), degree).collect()}
        for g in range(3):
            beta = decoders.poisson_fit(y[:, g], x, np.log(e), degree)
            assert got[f"g{g}"].beta == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-6)
            z = (x - x.mean()) / x.std()
            mu = e * np.exp(sum(b * z**k for k, b in enumerate(beta)))
            dev = 2 * np.sum(np.where(y[:, g] > 0, y[:, g] * np.log(np.maximum(y[:, g], 1e-300) / mu), 0) - (y[:, g] - mu))
            assert got[f"g{g}"].deviance == pytest.approx(dev, rel=1e-6, abs=1e-6)


def test_poisson_fit_recovers_a_planted_slope():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    z = (x - x.mean()) / x.std()
    y = rng.poisson(np.exp(0.5 + 0.4 * z) * 3.0).astype(float)
    assert decoders.poisson_fit(y, x, np.full(4000, math.log(3.0))) == pytest.approx([0.5, 0.4], abs=0.05)
    assert decoders.poisson_fit(np.zeros(5), np.arange(5.0), np.zeros(5))[0] == -20


@pytest.mark.parametrize("decoder", ["linear", "quadratic", "nn"])
@pytest.mark.parametrize("metric", ["gaussian", "poisson"])
@pytest.mark.parametrize("encoder", ["nn", "midline"])
def test_gradients_by_differences(decoder, metric, encoder):
    rng = np.random.default_rng(0)
    s, a, group = rng.normal(size=(12, 2)), rng.poisson(2, (12, 3)).astype(float), np.arange(12) % 2
    model = networks.DepthModel(3, networks.Plan(decoder=decoder, encoder=encoder, hidden=4, seed=2), 2, 1)
    cov = rng.normal(size=(12, 1))
    factor = np.ones_like(a)
    value = lambda: [networks.loss_sums(model.predict(s, group, cov), a, factor, metric).sum()]
    grads = model.gradients(networks.loss_slopes(model.predict(s, group, cov), a, factor, metric))
    for p, g in zip(model.params(), grads):
        at = tuple(rng.integers(0, n) for n in p.shape)
        old, h = p[at], 1e-6
        p[at] = old + h
        up = value()[0]
        p[at] = old - h
        down = value()[0]
        p[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-3)


PLAN = networks.Plan(epochs=30, rate=0.05, hidden=8)


def test_planted_axis_is_found(spark):
    c = synthetic.lattice(spark, 14)
    e = expr.zscore(synthetic.manifold(c, "radial", 6, 0.05, 3))
    few = trained.test(trained.fit_slots(nulls.coordinate_permutation(c, 9, 3), c, e, PLAN)).first()
    more = trained.test(trained.fit_slots(nulls.coordinate_permutation(c.repartition(3), 11, 3), c, e, PLAN)).first()
    assert few.p_value == pytest.approx(0.1) and few.stat_true == pytest.approx(more.stat_true, rel=1e-9)


def test_midline_encoder_finds_a_line(spark):
    c = synthetic.lattice(spark, 10)
    e = c.select("cell_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("gene"), F.abs(F.col("x") + F.col("y") - 1.0).alias("value"))
    t = trained.fit_slots(nulls.coordinate_permutation(c, 4, 3), c, expr.zscore(e), networks.Plan(encoder="midline", epochs=40, rate=0.1), reruns=3)
    assert trained.test(t).first().p_value == pytest.approx(0.2)


def test_spark_steps_equal_one_array(spark):
    """Sums over partitions against the same network on all cells at once."""
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(40, 2))
    c = cells(spark, xy, ["a", "b"] * 20).repartition(5)
    a = rng.normal(size=(40, 3))
    t = trained.fit_slots(c.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), c, long(spark, a), networks.Plan(epochs=4, rate=0.05, hidden=3), by_type=True)
    net = t.network(t.models[0])
    adam = networks.Adam(net.flat()[None, :], 0.05)
    s = (xy - xy.mean(0)) / xy.std(0)
    for _ in range(4):
        net.load(adam.params[0])
        out = net.predict(s, np.arange(40) % 2, None)
        loss = ((out - a) ** 2).mean()
        adam.step(np.array([0]), np.concatenate([g.ravel() for g in net.gradients(2 * (out - a))])[None, :] / a.size)
    assert t.found[0, 0] == pytest.approx(loss, rel=1e-9)
    got = {r.cell_id: r.depth for r in t.depths().collect()}
    assert [got[i] for i in range(40)] == pytest.approx(net.encoder.forward(s)[:, 0].tolist(), rel=1e-9)
    nll = trained.statistics(t, "nll_gaussian_mse").first().stat
    assert nll == pytest.approx(60 * math.log(2 * math.pi * loss) + 60, rel=1e-9)


def test_reruns_are_chosen_by_training_loss(spark):
    c = cells(spark, [(i, i % 3) for i in range(12)])
    e = long(spark, np.random.default_rng(1).normal(size=(12, 2)))
    masks = trained.fold_masks(nulls.kfold(c, 3, 1))
    t = trained.fit_slots(c.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), c, e, networks.Plan(epochs=3, hidden=3), reruns=3, masks=masks)
    losses = t.losses().collect()
    got = {r.variant: (r.n, r.stat) for r in trained.statistics(t).collect()}
    for v in range(3):
        best = min((r for r in losses if r.variant == v), key=lambda r: (r.fit, r.rerun))
        assert got[v] == (8, best.loss)
    whole = sum(n * s for n, s in got.values()) / 24
    assert trained.by_folds(t, "mse").first().stat == pytest.approx(whole)


def test_empty_masks_are_errors(spark):
    c = cells(spark, [(0, 0), (1, 1), (2, 0)])
    masks = c.select(F.lit(0).alias("variant"), "cell_id", F.lit(True).alias("fit"), F.lit(False).alias("judge"))
    with pytest.raises(ValueError, match="no cell"):
        trained.fit_slots(c.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), c, long(spark, [[1], [2], [3]]), PLAN, masks=masks)
    df = long(spark, [[1.0], [2.0]]).withColumn("predicted", F.lit(0.0))
    with pytest.raises(Exception, match="empty mask"):
        metrics.masked_losses(df, df.select("cell_id").limit(0), ["gene"]).collect()


def test_comparisons(spark):
    c = synthetic.lattice(spark, 10)
    e = expr.zscore(synthetic.manifold(c, "radial", 4, 0.05, 3))
    args = (c, e, PLAN, [0.01, 0.3], 2)
    p = {r.delta: r for r in comparisons.perturbation(*args, 4, "mse").collect()}
    assert p[0.01].n_perms == 2 and p[0.01].stat_true == p[0.3].stat_true
    q = {r.delta: r for r in comparisons.compared_perturbation(*args, 3, 4, "spearman_corr_mean").collect()}
    assert q[0.01].n_perms == 3 and q[0.01].p_value == pytest.approx(0.25) and 0 <= q[0.01].stat_true <= 1
    s = {(r.fraction, r.slot): r.stat for r in comparisons.subsampling_stats(c, e, PLAN, [0.5, 0.8], 2, 8, "mse").collect()}
    assert len(s) == 6 and s[0.5, 0] == s[0.8, 0]
    r = {x.fraction: x for x in comparisons.compared_subsampling(c, e, PLAN, [0.5, 0.8], 2, 3, 8, "mse").collect()}
    assert r[0.8].p_value == pytest.approx(0.25) and 0 <= r[0.8].correlation <= 1


def test_permuted_rows_deal_places(spark):
    c = cells(spark, [(i, 2 * i) for i in range(6)])
    out = comparisons.with_permuted_rows(comparisons.perturbed(c, [0.1], 2, 1), 2, 2, 5).toPandas()
    assert sorted(out["slot"].unique()) == list(range(9))
    base = {k: sorted(zip(g["x"], g["y"])) for k, g in out.groupby("slot")}
    assert base[0] == base[3] == base[6] and base[1] == base[4] == base[7] != base[2]


def test_recursive_gradients(spark):
    c = cells(spark, [(i % 10, i // 10) for i in range(100)])
    rng = np.random.default_rng(42)
    a = rng.normal(size=(100, 5))
    a[:, 0], a[:, 1] = np.arange(100) % 10, -2.0 * (np.arange(100) % 10)
    a[:, :2] += 0.1 * rng.normal(size=(100, 2))
    got = comparisons.recursive_svg(c, expr.zscore(long(spark, a)), networks.Plan(epochs=40, rate=0.05, hidden=8), 9, 3, alpha=0.2, max_gradients=2).collect()
    assert {"g0", "g1"} <= {r.gene for r in got if r.gradient == 1}


def test_later_gradients_read_the_first_table(spark, monkeypatch):
    """Layouts are drawn and cells packed once, and each gradient is the one that its genes alone would give."""
    c = cells(spark, [(i % 10, i // 10) for i in range(100)])
    a = np.random.default_rng(7).normal(size=(100, 6))
    a[:, :3] += 3.0 * (np.arange(100) % 10)[:, None]
    a[:, 3:5] += 3.0 * (np.arange(100) // 10)[:, None]
    e, plan = expr.zscore(long(spark, a)), networks.Plan(epochs=60, rate=0.05, hidden=8)
    calls, whole = [], trained.cell_table
    monkeypatch.setattr(trained, "cell_table", lambda *x, **k: calls.append(1) or whole(*x, **k))
    got = comparisons.recursive_svg(c, e, plan, 4, 3, alpha=0.3, max_gradients=2).toPandas()
    assert len(calls) == 1 and got["gradient"].nunique() > 1
    left = e
    for g, own in got.groupby("gradient"):
        t = trained.fit_slots(nulls.coordinate_permutation(c, 4, 3), c, left, plan)
        assert own["gradient_p"].iloc[0] == trained.test(t).first()["p_value"]
        z = t.depths().filter("slot = 0").select("cell_id", F.col("depth").alias("z"))
        tests = ranks.bh_qvalues(decoders.with_f_p(decoders.quadratic_fit(left.join(z, "cell_id"), ["gene"]), 2))
        want = {r.gene: r.q_value for r in tests.filter("q_value < 0.3").collect()}
        assert want.keys() == set(own["gene"])
        assert np.allclose([want[x] for x in own["gene"]], own["q_value"], atol=1e-6)
        left = left.filter(~F.col("gene").isin(own["gene"].tolist()))


@pytest.mark.parametrize("metric, by_type", [("gaussian", False), ("gaussian", True), ("poisson", False), ("poisson", True)])
def test_narrowed_tables_are_those_of_the_kept_genes(spark, metric, by_type):
    c = cells(spark, [(i, i % 3) for i in range(8)]).withColumn("cell_type", F.col("cell_id") % 2)
    e, plan = long(spark, np.random.default_rng(1).poisson(3.0, size=(8, 4)).astype(float)), networks.Plan(metric=metric)
    lay = nulls.coordinate_permutation(c, 2, 1)
    table = trained.cell_table(lay, c, e, plan, by_type)
    assert table.select(F.max(F.size("factor"))).first()[0] == (4 if metric == "poisson" and by_type else 1)
    got = trained.narrowed(table, [True, False, False, True], plan, by_type).orderBy("cell_id").collect()
    assert got == trained.cell_table(lay, c, e.filter("gene IN ('g0', 'g3')"), plan, by_type).select(*table.columns).orderBy("cell_id").collect()


def test_scores_do_not_move_the_values(spark):
    e = long(spark, np.arange(12.0).reshape(6, 2))
    z = expr.zscore(e.repartition(3))
    assert "strategy=broadcast" in z._jdf.queryExecution().optimizedPlan().toString()


def test_mode_mask_turns_long_scales():
    assert surrogates.turned_modes(np.array([4.0, 0.25, -0.25, -4.0]), 1.0, 1.0).tolist() == [False, True, True, False]
    assert surrogates.turned_modes(np.array([4.0]), 0.0, 1.0).all()


def layout(n, seed, genes=3):
    rng = np.random.default_rng(seed)
    s = rng.uniform(size=(n, 2))
    a = rng.normal(size=(n, genes))
    a[:, 0] += 2 * s[:, 0]
    return s, a


def centred_weights(s, radius):
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1))
    near = (d <= radius) & (d > 0)
    w = np.zeros_like(d)
    w[near] = 1 / np.maximum(d[near], max(1e-4 * np.median(d[np.triu(near)]), 1e-9))
    c = np.eye(len(s)) - 1 / len(s)
    return c @ w @ c


def test_modes_equal_the_dense_ones(spark):
    s, _ = layout(1200, 1)
    c = cells(spark, s)
    dense = np.linalg.eigvalsh(centred_weights(s, 0.06))
    links = modes.layout(c, 0.06)
    values, own = modes.leading_modes(links, 3, width=12, steps=7)
    assert np.allclose(values, dense[np.argsort(-np.abs(dense))][:3], atol=1e-6)
    for r in modes.mode_residuals(links, own, values).collect():
        assert r.residual < 1e-3 * abs(r.eigenvalue) and r.length == pytest.approx(1)
    with pytest.raises(ValueError, match="no two cells"):
        modes.layout(c, 1e-9)


@pytest.mark.parametrize("steps, truncate", [(2, 0.0), (3, 0.1)])
def test_mode_nulls_keep_covariances_and_autocorrelation(spark, steps, truncate):
    """With far fewer basis columns than cells."""
    s, a = layout(90, 2)
    o = centred_weights(s, 0.3)
    out = modes.mode_surrogates(cells(spark, s), long(spark, a), 2, 1, 0.3, truncate, calibration=1.0 if truncate else None, steps=steps).toPandas().sort_values("cell_id")
    az = a - a.mean(0)
    for k, g in out.groupby("slot"):
        b = np.stack(g["a"])
        bz = b - b.mean(0)
        assert np.allclose(b.mean(0), a.mean(0)) and np.allclose(bz.T @ bz, az.T @ az) and np.allclose(bz.T @ o @ bz, az.T @ o @ az)
        assert np.allclose(a, b) == (k == 0)


def test_whole_bases_turn_the_operators_own_modes(spark):
    s, a = layout(24, 3)
    out = modes.mode_surrogates(cells(spark, s), long(spark, a), 1, 5, 0.4, steps=60).toPandas().sort_values("cell_id")
    b = np.stack(out[out.slot == 1]["a"])
    _, v = np.linalg.eigh(centred_weights(s, 0.4))
    before, after = v.T @ (a - a.mean(0)), v.T @ (b - b.mean(0))
    assert np.allclose(np.abs(before), np.abs(after), atol=1e-6)  # every coefficient kept or turned, alike for all genes
    turned = np.sign(before * after)[np.abs(before).min(1) > 1e-6]
    assert (turned == turned[:, :1]).all() and {-1.0, 1.0} == set(turned[:, 0])


def test_rank_matched_nulls_deal_the_true_values(spark):
    s, a = layout(60, 4)
    a[:, 1] = np.round(a[:, 1])
    out = modes.mode_surrogates(cells(spark, s), long(spark, a), 2, 1, 0.3, ranks=True, steps=2).toPandas()
    for _, g in out.groupby("slot"):
        assert np.allclose(np.sort(np.stack(g["a"]), 0), np.sort(a, 0))


def test_phases_keep_means_and_power(spark):
    rng = np.random.default_rng(0)
    g = rng.normal(size=(5, 8, 2))
    at = [(j, i) for i in range(5) for j in range(8)]
    out = spectral.phase_surrogates(cells(spark, at), long(spark, g.reshape(40, 2)), 2, 3).toPandas().sort_values("cell_id")
    for k, rows_ in out.groupby("slot"):
        h = np.stack(rows_["a"]).reshape(5, 8, 2)
        assert np.allclose(np.abs(np.fft.fft2(g, axes=(0, 1))), np.abs(np.fft.fft2(h, axes=(0, 1)))) and np.allclose(g, h) == (k == 0)
    with pytest.raises(ValueError, match="full grid"):
        spectral.phase_surrogates(cells(spark, at[:-1]), long(spark, g.reshape(40, 2)[:-1]), 1, 3)


def test_low_rank_factors_lower_the_deviance(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(0, 0.6, (60, 1)), rng.normal(0, 0.8, (12, 1))
    y = rng.poisson(np.exp(1.5 + left @ right.T))
    flat = lowrank.deviance(lowrank.fit(long(spark, y), 1, rounds=0))
    own = lowrank.fit(long(spark, y), 1, rounds=6, ridge=0.1)
    assert lowrank.deviance(own) < 0.7 * flat
    got = np.array([r.l[0] for r in own.left.orderBy("cell_id").collect()])
    assert abs(np.corrcoef(got, left[:, 0])[0, 1]) > 0.8


def test_variogram_kinds_and_bands(spark):
    c = cells(spark, [(0, 0), (1, 0), (0, 2), (4, 0)])
    e = long(spark, [[1.0], [2.0], [4.0], [1.0]])
    z = (np.array([1, 2, 4, 1]) - 2) / np.array([1, 2, 4, 1]).std()
    pairs = {(0, 1): 1.0, (0, 2): 2.0, (0, 3): 4.0, (1, 2): 5**0.5, (1, 3): 3.0, (2, 3): 20**0.5}
    for kind, slot in (("linear", lambda d: int(d / 1.0)), ("log", lambda d: int(5 + math.log2(d / 5))), ("near", lambda d: int((d / 5) ** 0.5 * 5))):
        want = {}
        for (i, j), d in pairs.items():
            want.setdefault(slot(d), []).append(z[i] * z[j])
        got = {r.bin: (r.n_pairs, r.gamma) for r in moran.variogram(c, e, 5.0, 5, kind).collect()}
        assert {k: (len(v), pytest.approx(1 - sum(v) / len(v), abs=1e-6)) for k, v in want.items()} == got
    b = moran.variogram_bands(nulls.coordinate_permutation(c, 4, 1), e, 5.0, 5).collect()
    assert all(r.low <= r.high for r in b if r.low is not None)
    assert 0 < moran.variogram(c, e, 5.0, 5, share=0.5, seed=1).agg(F.sum("n_pairs")).first()[0] < 6


def test_knn_plan_does_not_grow(spark):
    c = cells(spark, [(i % 7, i // 7) for i in range(40)] + [(1000 + i, 0) for i in range(5)] + [(1e6, 1e6)])
    out = spatial.knn(c, 3)
    assert out.count() == 46 * 3
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0  # rounds are read, not run again


def test_slots_and_samples(spark):
    c = cells(spark, [(i, i * i % 7) for i in range(30)])
    p = nulls.coordinate_permutation(c, 2, 3).toPandas()
    assert all(sorted(r["x"]) == list(range(30)) for _, r in p.groupby("slot"))
    assert p[p["slot"] == 1]["x"].tolist() != p[p["slot"] == 2]["x"].tolist()
    j = nulls.perturb(c, 1, 7, 0.5).toPandas()
    assert j["x"].between(0, 29).all() and j["y"].between(0, 6).all()
    assert rows.subsample(c, 5, 1).count() == 5


def test_gsea_of_a_planted_set(spark):
    r = spark.createDataFrame([(f"g{i:02d}", float(20 - i)) for i in range(40)], "gene string, score double")
    s = spark.createDataFrame([("top", f"g{i:02d}") for i in range(5)] + [("mixed", f"g{i:02d}") for i in range(0, 40, 8)], "pathway string, gene string")
    got = {x.pathway: x for x in gsea.preranked(r, s, 50, 1).collect()}
    assert got["top"].es == pytest.approx(1.0) and got["top"].p_value < got["mixed"].p_value


def test_sources_round_trip(spark, tmp_path):
    row = [("r", "m", "mse", 0.1, 1.0, [2.0, 3.0], 1.5, 4, 5, "{}", {"a": "b"})]
    results.write_results(spark.createDataFrame(row, results.RESULT), str(tmp_path / "r"))
    assert results.read_results(spark, str(tmp_path / "r")).first().stat_perm == [2.0, 3.0]
    (tmp_path / "m.json").write_text('{"runs": [{"path": "p1"}, {"path": "p2"}]}')
    assert results.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    c, e = cells(spark, [(0, 0), (1, 1)]), long(spark, [(1, 2), (3, 4)])
    results.write_cells(c, e, str(tmp_path / "c"))
    a, b = results.read_cells(spark, str(tmp_path / "c"))
    assert a.count() == 2 and b.count() == 4
    results.write_csv(c, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == c.columns


def test_registry_loads_and_imports_stand_alone():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_take_whole_tables(spark, tmp_path):
    """pathway_score has every cell, explode_nulls every run, best_of_k draws from every loss."""
    from hashlib import md5

    from spatialq.plans import registry

    runs = [(i, i % 4 + 1, f"c{i % 2}", "F", float(i * 37 % 101)) for i in range(1, 61)]
    tables = {
        "orders": (runs, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"),
        "customer": ([(i, 1.0, 1, "t") for i in range(1, 5)], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string"),
        "lineitem": ([(1, 1, 3.0), (2, 2, 5.0)], "l_orderkey long, l_partkey long, l_quantity double"),
        "part": ([(1, "b1", "p"), (2, "b2", "p")], "p_partkey long, p_brand string, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    q = registry.queries()
    scores = {r.cell_id: r.score for r in q["pathway_score"](spark, str(tmp_path)).collect()}
    assert scores == {1: 0.0, 2: 1.5, 3: 2.5, 4: 0.0}
    want = [(c, k, r[4]) for c in ("c0", "c1") for k, r in enumerate(r for r in runs if r[2] == c)]
    assert sorted((r.condition, r.slot, r.stat) for r in q["explode_nulls"](spark, str(tmp_path)).collect()) == want
    got = {r.k: r.mean for r in q["best_of_k"](spark, str(tmp_path)).collect()}
    for k in (1, 3, 10):
        best = [min(r[4] for r in sorted(runs, key=lambda r: md5(f"2:{draw}:{r[0]}".encode()).hexdigest())[:k]) for draw in range(1, 41)]
        assert got[k] == pytest.approx(sum(best) / 40, abs=1e-6)
    plan = q["best_of_k"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks keep the first rows of each draw before the shuffle


def test_matched_nulls_follow_the_variogram(spark):
    """A smooth gene's nulls have its variogram within their bands; a white one's stay flat."""
    rng = np.random.default_rng(8)
    s = rng.uniform(size=(400, 2))
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1))
    a = np.stack([np.linalg.cholesky(np.exp(-d / 0.15) + 1e-6 * np.eye(400)) @ rng.normal(size=400), rng.normal(size=400)], 1)
    choices, out = matched.variogram_matched(cells(spark, s), long(spark, a), 6, 3, 0.3, [0.03, 0.08, 0.2], 6)
    assert choices.count() == 12
    rows_ = out.toPandas().sort_values("cell_id")
    i, j = np.nonzero(np.triu((d <= 0.3) & (d > 0)))
    slot = np.minimum((d[i, j] / 0.05).astype(int), 5)
    gamma = {k: np.array([((np.stack(g["a"])[i] - np.stack(g["a"])[j]) ** 2)[slot == b].mean(0) / 2 for b in range(6)]) for k, g in rows_.groupby("slot")}
    nulls_ = np.stack([gamma[k] for k in range(1, 7)])
    spread = nulls_.max(0) - nulls_.min(0) + 0.25
    assert (np.abs(nulls_.mean(0) - gamma[0]) < spread).all()
    assert (nulls_[:, 0, 0] < nulls_[:, 5, 0]).all()  # near pairs are alike in every null of the smooth gene
    assert not np.allclose(np.stack(rows_[rows_.slot == 1]["a"]), np.stack(rows_[rows_.slot == 2]["a"]))


def test_smooth_axes_have_the_kernels_covariance(spark):
    rng = np.random.default_rng(9)
    s = rng.uniform(size=(30, 2)) * 4
    df = cells(spark, s).select("cell_id", "x", "y", F.lit(0).alias("lobule"))
    out = matched.smooth_axes(df, 400, 0.8, 48, 3).toPandas().pivot(index="draw", columns="cell_id", values="value").to_numpy()
    z = (s - s.mean(0)) / (s.std(0) + 1e-8)
    k = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * 0.8**2))
    assert np.abs(out.T @ out / 400 - k).max() < 0.25 and np.abs(out.T @ out / 400 - k).mean() < 0.06


def test_axes_that_follow_the_target_stand_out(spark):
    rng = np.random.default_rng(10)
    s = rng.uniform(size=(240, 2))
    lobule = np.arange(240) % 3
    target = np.hypot(s[:, 0] - 0.5, s[:, 1] - 0.5)
    rows_ = [(i, int(lobule[i]), *map(float, s[i]), float(target[i] + 0.01 * rng.normal() if lobule[i] < 2 else rng.normal()), float(target[i])) for i in range(240)]
    df = spark.createDataFrame(rows_, "cell_id long, lobule int, x double, y double, axis double, target double")
    observed, nulls_ = matched.axis_recovery(df, 40, 0.8, 24, 1)
    p = {r.lobule: r.p_value for r in matched.recovery_by_key(observed, nulls_).collect()}
    assert p[0] == p[1] == 0 and p[2] > 0.05
    one = matched.recovery(observed, nulls_).collect()
    assert len(one) == 1 and one[0].n_lobules == 3 and one[0].p_value == 0 and one[0].observed > one[0].null_mean


def test_folds_need_as_many_cells(spark):
    with pytest.raises(ValueError, match="5 folds"):
        nulls.kfold(cells(spark, [(0, 0), (1, 1), (2, 2)]), 5, 1)


def merged_one_by_one(d):
    """Average linkage of a distance matrix, the nearest pair at a time: {(a, b): height} and the leaf order."""
    clusters, number, leaves, heights = {k: [k] for k in range(len(d))}, {k: k for k in range(len(d))}, {k: [k] for k in range(len(d))}, {}
    while len(clusters) > 1:
        h, a, b = min((np.mean([d[x][y] for x in clusters[a] for y in clusters[b]]), a, b) for a in clusters for b in clusters if a < b)
        heights[a, b] = h
        first, second = sorted((a, b), key=number.__getitem__)
        leaves[a] = leaves[first] + leaves[second]
        clusters[a] += clusters.pop(b)
        number[a] = len(d) + len(heights) - 1
    return heights, leaves[0]


@pytest.mark.parametrize("n, seed", [(2, 0), (13, 1), (24, 2)])
def test_average_linkage_equals_merging_one_by_one(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a int, b int, d double")
    got = linkage.average_linkage(pairs)
    want, leaves = merged_one_by_one(d)
    rows_ = {(r.a, r.b): r.height for r in got.collect()}
    assert rows_.keys() == want.keys() and all(rows_[k] == pytest.approx(h) for k, h in want.items())
    order = linkage.leaf_order(got, spark.range(n).selectExpr("cast(id as int) AS item"))
    assert [r.item for r in order.orderBy("place").collect()] == leaves


def test_linkage_of_equal_distances(spark):
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], "a int, b int, d double")
    got = linkage.average_linkage(pairs).collect()
    assert len(got) == 4 and {r.height for r in got} == {1.0} and max(r["size"] for r in got) == 5


def test_candidates_of_a_clump_grow_with_the_cells(spark):
    """Half of the cells in a clump: twice the cells look at about twice the candidates."""
    seen = []
    for n in (500, 1000, 2000):
        xy = np.random.default_rng(1).random((n, 2))
        xy[: n // 2] = 0.5 + 1e-4 * np.random.default_rng(2).normal(size=(n // 2, 2))
        c = cells(spark, xy).select("cell_id", "x", "y")
        todo = spatial.tile_levels(c, 0.0, 0.0, 1.0, 7, 4)
        seen.append(spatial.candidates_at_levels(todo, c, 0.0, 0.0, 1.0).count())
    assert seen[1] < 3 * seen[0] and seen[2] < 3 * seen[1] and seen[2] < 200 * 2000


def test_knn_of_equal_places(spark):
    got = spatial.knn(cells(spark, [(1, 1)] * 30 + [(2, 2)]), 3).toPandas()
    assert len(got) == 31 * 3 and (got[got.i < 30].d == 0).all() and sorted(got[got.i == 30].j) == [0, 1, 2]


def test_quantiles_by_narrowing(spark):
    x = np.random.default_rng(4).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for rows_ in (100_000, 50):
        got = ranks.quantiles(df, "v", [0.0, 0.1, 0.5, 0.97, 1.0], exact_rows=rows_)
        assert np.allclose(got, np.quantile(x, [0.0, 0.1, 0.5, 0.97, 1.0]))
    assert ranks.quantiles(df.filter("v is null"), "v", [0.5]) == []


def test_strict_matches(spark):
    a, b = cells(spark, [(0, 0), (5, 5)]), cells(spark, [(0.1, 0), (5, 5.1), (9, 9)])
    assert spatial.nearest_match(a, b, 0.5, strict=True).count() == 2
    with pytest.raises(ValueError, match="1 of 2"):
        spatial.nearest_match(a, b.filter("cell_id <> 1"), 0.5, strict=True)
    with pytest.raises(ValueError, match="1 share"):
        spatial.nearest_match(cells(spark, [(0, 0), (0.2, 0)]), b, 0.5, strict=True)


def flooded(on, corners):
    """Sizes and centres of a mask's objects, pixel by pixel."""
    left, out = set(on), []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        own = []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (corners or not (dr and dc)) and (r + dr, c + dc) in left:
                        left.discard((r + dr, c + dc))
                        todo.append((r + dr, c + dc))
        out.append((len(own), np.mean([c for _, c in own]), np.mean([r for r, _ in own])))
    return sorted(out)


@pytest.mark.parametrize("corners", [False, True])
def test_mask_objects_equal_flooding(spark, corners):
    rng = np.random.default_rng(6)
    on = [(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((25, 300)) < 0.45))] + [(40, c) for c in range(700)] + [(41, 699), (42, 699), (39, 5)]
    df = spark.createDataFrame(on + on[:20], "row int, col int")
    got = masks.mask_objects(df, 1, corners).collect()
    assert sorted((r.n_pixels, r.cx, r.cy) for r in got) == [pytest.approx(x) for x in flooded(on, corners)]
    assert [r.object for r in sorted(got, key=lambda r: r.object)] == list(range(len(got)))
    assert masks.mask_objects(df, 100, corners).count() == sum(x[0] >= 100 for x in flooded(on, corners))
    assert masks.mask_objects(df.limit(0)).count() == 0


def test_colour_mask(spark):
    df = spark.createDataFrame([(200, 10, 10), (180, 10, 10), (200, 80, 10), (255, 79, 79)], "r int, g int, b int")
    on = masks.colour_mask(F.col("r"), F.col("g"), F.col("b"), (180, -1, -1), (256, 80, 80))
    assert [r[0] for r in df.select(on).collect()] == [True, False, False, True]


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(7)
    at = np.array([(0, 0), (10, 0), (0, 10), (10, 10), (30, 30)])
    xy = np.concatenate([c + 0.5 * rng.normal(size=(n, 2)) for c, n in zip(at, (80, 60, 40, 30, 5))])
    c = cells(spark, xy.tolist())
    got = spatial.kmeans(c, 5, 3).toPandas().sort_values("cell_id")["cluster"].to_numpy()
    parts = np.split(got, np.cumsum((80, 60, 40, 30)))
    assert all(len(set(p)) == 1 for p in parts) and len({p[0] for p in parts}) == 5
    again = spatial.kmeans(c.repartition(7), 5, 3).toPandas().sort_values("cell_id")["cluster"].to_numpy()
    assert (got == again).all()
    centers = spatial.kmeans_seeds(c, 5, 3)
    d = ((xy[:, None] - np.array(centers)[None]) ** 2).sum(-1).argmin(1)
    for k, x, y, n in spatial.lloyd_step(c, centers):
        assert n == (d == k).sum() and (not n or np.allclose((x, y), xy[d == k].mean(0)))
    assert {r.cluster for r in spatial.kmeans(cells(spark, [(1, 1)] * 4), 3, 1).collect()} == {0}
    assert {r.cluster for r in spatial.kmeans(cells(spark, [(1, 1), (2, 2)]), 9, 1).collect()} == {0, 1}
    assert spatial.kmeans(c.limit(0), 3, 1).count() == 0


def test_low_rank_start_is_the_dense_one(spark):
    rng = np.random.default_rng(12)
    y = rng.poisson(np.exp(rng.normal(0, 1, (120, 2)) @ rng.normal(0, 0.7, (2, 15))) * 3).astype(float)
    e = long(spark, y)
    rows_ = e.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("v"), F.sum("value").alias("t")).select(F.col("v.value").alias("y"), F.log(F.greatest("t", F.lit(1.0))).alias("size"))
    order = np.argsort([f"g{j}" for j in range(15)])
    y = y[:, order]
    base = np.log(np.maximum(y.sum(0), 0.5)) - np.log(y.sum())
    mu = np.exp(np.log(np.maximum(y.sum(1), 1))[:, None] + base)
    dense = np.linalg.svd((y - mu) / np.sqrt(mu))
    values, v = lowrank.leading_directions(rows_, base, 3, 1, passes=8)
    assert np.allclose(values, dense[1][:3], rtol=1e-4) and np.allclose(np.abs(v[:, 0] @ dense[2][0]), 1, atol=1e-4)
    other, w = lowrank.leading_directions(rows_.repartition(5), base, 3, 1, passes=8)
    assert np.allclose(values, other) and np.allclose(v, w, atol=1e-6)


def test_low_rank_factors_by_type(spark):
    rng = np.random.default_rng(13)
    y = rng.poisson(np.exp(rng.normal(0, 1, (60, 1)) @ rng.normal(0, 1, (1, 6))) * 2)
    c = cells(spark, [(i, 0) for i in range(60)], ["a"] * 30 + ["b"] * 30)
    got = lowrank.fit_by_type(c, long(spark, y), 1, rounds=4, patience=1)
    assert set(got) == {"a", "b"} and all(f.left.count() == 30 for f in got.values())


def test_scales_of_other_layouts(spark):
    c, o = cells(spark, [(0, 5), (2, 5), (4, 5)]), cells(spark, [(4, 6)])
    scale_ = rows.coordinate_scale(c, ["x", "y"])
    z = rows.scaled(o, scale_, ["x", "y"])
    assert z.first().x == pytest.approx(2 / math.sqrt(8 / 3)) and z.first().y == 1.0  # no spread: divided by 1
    assert rows.scaled(z, scale_, ["x", "y"], back=True).first().x == pytest.approx(4)


def trained_on_one_array(s, a, plan, parts, seed):
    """Losses by epoch of one model, trained over parts of the cells, visited in a seeded order, in NumPy."""
    net, n = networks.DepthModel(a.shape[1], plan, 1, 0), len(s)
    adam = networks.Adam(net.flat()[None], plan.rate)
    out, z = [], (s - s.mean(0)) / s.std(0)

    def sums(rows_):
        net.load(adam.params[0])
        p = net.predict(z[rows_], np.zeros(len(rows_), int), None)
        each = networks.loss_sums(p, a[rows_], None, "gaussian")
        grads = net.gradients(networks.loss_slopes(p, a[rows_], None, "gaussian"))
        return each.sum(), np.concatenate([g.ravel() for g in grads])

    for epoch in range(plan.epochs):
        for k, part in enumerate(np.random.default_rng([seed, epoch]).permutation(len(parts))):
            loss, grad = sums(parts[part])
            if len(parts) == 1:
                out.append(loss / a.size)
            rate = plan.rate * (1 + np.cos(np.pi * (epoch * len(parts) + k) / (plan.epochs * len(parts)))) / 2 if plan.cosine else plan.rate
            adam.step(np.array([0]), grad[None] / (len(parts[part]) * a.shape[1]), rate)
        if len(parts) > 1:
            out.append(sums(np.arange(n))[0] / a.size)
    return out


@pytest.mark.parametrize("batch", [0, 14])
def test_steps_equal_one_array(spark, batch):
    import dataclasses
    import hashlib

    rng = np.random.default_rng(14)
    s, a = rng.uniform(size=(40, 2)), rng.normal(size=(40, 3))
    c = cells(spark, s)
    plan = networks.Plan(epochs=4, rate=0.05, hidden=4, seed=2, batch=batch, cosine=True)
    t = trained.fit_slots(c.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), c, long(spark, a), plan)
    order = sorted(range(40), key=lambda i: hashlib.md5(f"2:{i}".encode()).hexdigest())
    parts = [np.array(order[k::3]) for k in range(3)] if batch else [np.arange(40)]
    assert {tuple(sorted(r[0] for r in p.select("cell_id").collect())) for p in t.parts} == {tuple(sorted(p.tolist())) for p in parts}
    want = trained_on_one_array(s, a, dataclasses.replace(plan, seed=plan.seed * 1_000_003), parts, plan.seed)
    got = [r.loss for r in t.trajectory().orderBy("epoch").collect()]
    assert len(got) == 4 and np.allclose(got, want)


def test_steps_of_a_stretch_are_one_job(spark, monkeypatch):
    """30 batches make no 30 jobs, and models move as they do with a job a step."""
    rng = np.random.default_rng(16)
    s, a = rng.uniform(size=(60, 2)), rng.normal(size=(60, 3))
    c = cells(spark, s)
    slots = nulls.coordinate_permutation(c, 2, 5)
    plan = networks.Plan(epochs=2, rate=0.05, hidden=4, batch=2, cosine=True)
    table, sc, jobs, found = trained.cell_table(slots, c, long(spark, a), plan), spark.sparkContext, [], []
    for size in (trained.PASS_BYTES, 0):
        monkeypatch.setattr(trained, "PASS_BYTES", size)
        sc.setJobGroup(f"stretch {size}", "")
        t = trained.Trainer(table, plan, 3, reruns=2)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"stretch {size}")))
        found.append([(*r[:-1], round(r.loss, 9)) for r in t.trajectory().orderBy("epoch", "slot", "rerun").collect()])
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < 30 < 60 < jobs[1]
    assert found[0] == found[1] and len(found[0]) == 12


def test_warm_up_then_counts_with_a_resting_encoder(spark):
    rng = np.random.default_rng(15)
    s = rng.uniform(size=(50, 2))
    y = rng.poisson(np.exp(1 + 2 * s[:, :1]) * np.ones((1, 4)))
    c = cells(spark, s)
    slot = c.select(F.lit(0).alias("slot"), "cell_id", "x", "y")
    plan = networks.Plan(metric="poisson", epochs=6, rate=0.05, hidden=4, warm=3, freeze=True)
    t = trained.fit_slots(slot, c, long(spark, y), plan)
    h = [r.loss for r in t.trajectory().orderBy("epoch").collect()]
    assert len(h) == 6 and abs(h[3] - h[2]) > 0.1  # another loss from epoch 3 on
    assert t.losses().first().fit == pytest.approx(min(h[3:]))
    short = trained.fit_slots(slot, c, long(spark, y), networks.Plan(metric="poisson", epochs=3, rate=0.05, hidden=4, warm=3, freeze=True))
    inner = sum(p.size for p in t.network(t.models[0]).encoder.params())
    longer = trained.fit_slots(slot, c, long(spark, y), networks.Plan(metric="poisson", epochs=5, rate=0.05, hidden=4, warm=3, freeze=True))
    assert longer.best.shape == t.best.shape and np.allclose(longer.best[0, :inner], t.best[0, :inner]) and not np.allclose(short.best[0], t.best[0])


def test_best_of_k_sorts_few_losses(spark):
    """Of 5,000 losses a draw sorts those of least key, with the same least values."""
    losses = spark.range(5000).selectExpr("id AS run_id", "cast((id * 7919) % 5003 AS double) AS stat")
    out = studies.best_of_k(losses, [1, 10], 4, 2)
    assert 40 <= spark.read.parquet(*out.inputFiles()).count() < 5000
    key = {draw: sorted(range(5000), key=lambda i: hashlib.md5(f"2:{draw}:{i}".encode()).hexdigest()) for draw in range(1, 5)}
    want = {k: sum(min((i * 7919) % 5003 for i in own[:k]) for own in key.values()) / 4 for k in (1, 10)}
    assert {r.k: r["mean"] for r in out.collect()} == pytest.approx(want)
    few = studies.best_of_k(losses.filter("run_id < 3"), [1, 10], 4, 2).collect()
    assert {r.k for r in few} == {1, 10}


def test_poisson_rounds_move_no_rows(spark):
    rows = spark.createDataFrame([("g", i, float(i % 3), float(i), 1.0) for i in range(12)], "gene string, cell_id long, value double, z double, exposure double")
    assert "strategy=broadcast" in decoders.poisson_irls(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_genes_are_cut_by_cells_not_by_values(spark):
    """True values dealt in the nulls' order, with buckets or without; genes of other scales; rows are standardised where they are."""
    rng = np.random.default_rng(17)
    a, b = rng.normal(size=(50, 3)) * [1, 100, 0.01], rng.normal(size=(2, 50, 3)) * [1, 100, 0.01]
    kind = "slot int, cell_id long, a array<double>"
    truth = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(a)], kind)
    null = spark.createDataFrame([(k + 1, i, v.tolist()) for k in range(2) for i, v in enumerate(b[k])], kind)
    want = np.stack([np.take_along_axis(np.sort(a, 0), z.argsort(0).argsort(0), 0) for z in b])
    for per_task in (200_000, 12):
        got = modes.dealt_by_rank(truth, null, per_task)
        assert np.array_equal([r.a for r in got.orderBy("slot", "cell_id").collect()], want.reshape(-1, 3))
    z = spectral.standardised(null)
    assert "Generate" not in z._jdf.queryExecution().optimizedPlan().toString()
    exact = (b - b.mean(1, keepdims=True)) / (b.std(1, keepdims=True) + 1e-8)
    assert np.allclose([r.a for r in z.orderBy("slot", "cell_id").collect()], exact.reshape(-1, 3))
    edges = [0.0, 0.5, 1.0, 2.0, 2.5, 4.0, 7.0]
    at = spark.createDataFrame([(float(v),) for v in np.arange(-1, 9, 0.5)], "v double")
    assert all(r.b == sum(e <= r.v for e in edges) for r in at.select("v", ranks.bucket_of(edges, F.col("v")).alias("b")).collect())
