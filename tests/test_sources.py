"""Readers of matrices, names and positions."""

import gzip

import numpy as np
import pytest

from spatialq.sources import matrices, results, scale


def write(path, text, compressed=False):
    (gzip.open if compressed else open)(path, "wt").write(text)
    return str(path)


HEAD = "%%MatrixMarket matrix coordinate integer general\n% note\n%\n\n"


def test_lines_are_numbered_over_blocks_and_parts(spark, tmp_path):
    texts = [[f"{k} {'x' * (k % 7)}" for k in range(n)] for n in (5000, 0, 17, 3000)]
    for i, t in enumerate(texts):
        write(tmp_path / f"part-{i}.txt", "".join(f"{x}\n" for x in t))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r.value for r in matrices.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
        lines = matrices.numbered_lines(spark, str(tmp_path)).agg({"line": "max"}).first()[0]
        assert matrices.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sum(texts, []) and lines == len(got) - 1


@pytest.mark.parametrize("compressed", [False, True])
def test_counts_with_names_and_positions(spark, tmp_path, compressed):
    end = ".gz" if compressed else ""
    m = write(tmp_path / f"m.mtx{end}", HEAD + "4 3 5\n1 1 5\n2 1 7\n3 2 1\n4 3 9\n1 3 2\n", compressed)
    g = write(tmp_path / f"g.tsv{end}", "e1\tA\tGene Expression\ne2\tB\tGene Expression\ne3\tA\tGene Expression\ne4\tP\tAntibody Capture\n", compressed)
    b = write(tmp_path / f"b.tsv{end}", "AAA-1\nCCC-1\nGGG-1\n", compressed)
    p = write(tmp_path / "p.csv", "GGG-1,1,0,0,10,20\nAAA-1,1,0,1,11,21\nCCC-1,0,0,2,12,22\nTTT-1,1,9,9,9,9\n")
    cells, expr = matrices.assemble(spark, m, g, b, p)
    assert {(r.cell_id, r.x, r.y) for r in cells.collect()} == {("GGG-1", 20.0, 10.0), ("AAA-1", 21.0, 11.0)}
    assert {tuple(r) for r in expr.collect()} == {("AAA-1", "A", 5.0), ("AAA-1", "B", 7.0), ("GGG-1", "A", 2.0)}
    _, whole = matrices.assemble(spark, m, g, b, p, tissue_only=False)
    assert ("CCC-1", "A-1", 1.0) in {tuple(r) for r in whole.collect()}
    with pytest.raises(ValueError, match="1 rows lack coordinates"):
        matrices.assemble(spark, m, g, b, write(tmp_path / "q.csv", "GGG-1,1,0,0,10,20\nAAA-1,1,0,1,11,21\n"))
    with pytest.raises(ValueError, match="2 barcodes for 3"):
        matrices.assemble(spark, m, g, write(tmp_path / "c.tsv", "AAA-1\nCCC-1\n"), p)


def dense(m):
    out = np.zeros((m.rows, m.columns))
    for r in m.entries.collect():
        out[r.i - 1, r.j - 1] += r.value
    return out.tolist()


def test_kinds_of_matrices(spark, tmp_path):
    s = write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 1.5\n2 1 -2\n")
    assert dense(matrices.read_matrix(spark, s)) == [[1.5, -2.0], [-2.0, 0.0]]
    k = write(tmp_path / "k.mtx", "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n")
    assert dense(matrices.read_matrix(spark, k)) == [[0.0, -3.0], [3.0, 0.0]]
    p = write(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 3 1\n2 3\n")
    assert dense(matrices.read_matrix(spark, p)) == [[0.0] * 3, [0.0, 0.0, 1.0]]


@pytest.mark.parametrize("text, match", [
    ("%%MatrixMarket matrix array real general\n1 1\n1\n", "no coordinate matrix"), (HEAD + "2 2 2\n1 1 1\n", "1 of 2"), (HEAD + "2 2 1\n3 1 1\n", "1 lines"),
    (HEAD + "2 2 1\n1 x 1\n", "1 lines"), (HEAD + "2 2 1\n1 1\n", "1 lines"), (HEAD, "no line of sizes"),
])
def test_damaged_matrices_are_errors(spark, tmp_path, text, match):
    with pytest.raises(ValueError, match=match):
        matrices.read_matrix(spark, write(tmp_path / "m.mtx", text))


def test_written_matrices_come_back(spark, tmp_path):
    rows = [(i, j, float(i * j)) for i in range(1, 40) for j in range(1, 30) if (i * j) % 3]
    matrices.write_matrix(spark.createDataFrame(rows, "i int, j int, value double").repartition(5), 40, 30, f"{tmp_path}/m", "gzip")
    got = matrices.read_matrix(spark, f"{tmp_path}/m")
    assert (got.rows, got.columns) == (40, 30) and {tuple(r) for r in got.entries.collect()} == set(rows)


def test_scale_of_coordinates():
    lib = lambda **k: {"spatial": {"s": k}}
    assert scale.um_per_unit({"stereo_seq": {"coordinate_um_per_unit": "2.5"}}, "x.MOSTA.h5ad") == 2.5
    assert scale.um_per_unit({"mosta": {"coordinate_um_per_unit": -1}}, "a/E12.MOSTA.h5ad") == 25.0
    assert scale.um_per_unit({}, "NSCLC_9.h5ad") == 0.12028 and scale.um_per_unit({}, "e12.mosta.h5ad") is None
    assert scale.um_per_unit(lib(metadata={"coordinate_um_per_unit": 3}, scalefactors={"spot_diameter_fullres": 11})) == 3
    assert scale.um_per_unit(lib(scalefactors={"microns_per_pixel": "bad", "spot_diameter_fullres": 110})) == 0.5
    assert scale.um_per_unit(lib(scalefactors={"spot_diameter_fullres": 0})) is None and scale.um_per_unit({"spatial": 3}) is None


def test_damaged_rows_are_set_aside(spark, tmp_path):
    text = "cell_id,x,y\n1,0.5,2\n2,zero,3\n3,1.5\n4,2.5,4,9\n\n5,,6\n"
    path = write(tmp_path / "cells.csv", text)
    rows, damaged = results.read_quarantined(spark, path, "cell_id long, x double, y double")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0.5, 2.0), (5, None, 6.0)]
    got = {r.line: r.reason for r in damaged.collect()}
    assert got == {"2,zero,3": "a value of another kind", "3,1.5": "2 of 3 fields", "4,2.5,4,9": "4 of 3 fields"}
    assert {r.file for r in damaged.collect()} == {"cells.csv"} and open(path).read() == text


def test_region_manifest_and_configs(spark, tmp_path):
    import json

    df = spark.createDataFrame([("T cell", 0, 9, 1.0), ("T cell", 1, 4, 2.0), ("B", 0, 5, 3.0)], "cell_type string, region int, n_cells int, cx double")
    base = {"data": {"table": "t", "obs_filters": {"ok": True}}, "test": {"seed": 3}}
    assert results.write_region_manifest(df, base, str(tmp_path)) == 3
    assert {r.run_name for r in spark.read.parquet(f"{tmp_path}/manifest").collect()} == {"T_cell_r0", "T_cell_r1", "B_r0"}
    configs = {r.run_name: json.loads(r.config) for r in spark.read.json(f"{tmp_path}/configs").collect()}
    assert configs["T_cell_r1"]["data"] == {"table": "t", "obs_filters": {"ok": True, "cell_type": "T cell", "region": 1}} and configs["B_r0"]["test"] == {"seed": 3}
    assert base["data"]["obs_filters"] == {"ok": True}
