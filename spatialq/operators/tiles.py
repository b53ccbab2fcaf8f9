"""Pairs within a radius by tile, block by block: no pair becomes a row, and cells move five times however dense they are.

A tile is as wide as the radius, wider where cells are sparse. Its group holds its own cells and those of the four tiles
after it, so each pair is met once: in the group of the earlier of its two tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block; distances of two blocks are held at once.
BLOCK = 512
#: Tiles are widened until they hold so many cells on average.
FULL = 64
#: The tiles after a tile. With those before it and itself these are the nine around it.
AFTER = ((1, 0), (-1, 1), (0, 1), (1, 1))


def tile_side(places: DataFrame, r: float) -> float:
    """The side of a tile: the radius, or up to eight of it where that would hold few of the cells."""
    w, h, n = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    held = n * r * r / (w * h) if w and h and w * h > 0 else FULL
    wide = 2 ** max(0, min(3, math.ceil(math.log2(FULL / held) / 2))) if held > 0 else 8
    return r * wide * (1 + 1e-9)  # so that rounding can't part a pair by two tiles


def grouped(df: DataFrame, r: float, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, places: DataFrame | None = None) -> DataFrame:
    """run on each tile's group of df(keys, x, y, ...), which has _own besides; cells without a place are left out.

    places: the cells' x and y, where they are found with less work than df. The partitions are
    given by number: few bytes mean much work here, so they must not be merged by size.
    """
    df = df.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    side = tile_side((df if places is None else places).select("x", "y").filter("NOT isnan(x) AND NOT isnan(y)"), r)
    spark, own = df.sparkSession, {c: F.floor(F.col(c) / side) for c in ("x", "y")}
    low, high = ({c: f(c) for c in ("x", "y")} for f in (lambda c: F.col(c) - own[c] * side <= r * (1 + 1e-6), lambda c: (own[c] + 1) * side - F.col(c) <= r * (1 + 1e-6)))
    meets = {(0, 0): F.lit(True), (1, 0): low["x"], (-1, 1): high["x"] & low["y"], (0, 1): low["y"], (1, 1): low["x"] & low["y"]}
    steps = [F.when(meets[i, j], F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j in ((0, 0), *AFTER)]
    placed = df.withColumn("_o", F.explode(F.filter(F.array(*steps), lambda v: v.isNotNull())))
    tile = [(own[c].cast("bigint") - F.col(f"_o.{o}")).alias(t) for c, o, t in (("x", "i", "_tx"), ("y", "j", "_ty"))]
    put = placed.select(*df.columns, *tile, ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_own"))
    at = [*keys, "_tx", "_ty"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return put.repartition(n, *at).groupBy(*at).applyInArrow(run, schema)


class Group:
    """A tile's cells in blocks: own ones first, each half by place, so that blocks are small and far ones are passed over."""

    def __init__(self, t: pa.Table, r: float, first: str | None = None) -> None:
        """first: a boolean column whose true rows go before the others, so that most blocks hold one kind."""
        x, y, own = (t.column(c).to_numpy() for c in ("x", "y", "_own"))
        kind = t.column(first).to_numpy() if first else own
        order = np.lexsort((x, np.floor(y / (r / 4)), ~kind, ~own))
        self.table, self.r, self.x, self.y = t.take(pa.array(order)), r, x[order], y[order]
        self.n, self.n_own = len(x), int(own.sum())
        cuts = sorted({*range(0, self.n_own, BLOCK), *range(self.n_own, self.n, BLOCK), self.n})
        self.blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def pairs(self, skip: Callable[[slice, slice], bool] | None = None) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """(a, b, d, near): two blocks, their cells' distances, and which of them are pairs of this tile."""
        heads = [s.start for s in self.blocks]
        if not self.n_own:
            return
        (x0, x1), (y0, y1) = ((np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads)) for v in (self.x, self.y))
        for k, a in enumerate(self.blocks):
            if a.start >= self.n_own:
                break
            gx = np.maximum(0, np.maximum(x0[k:] - x1[k], x0[k] - x1[k:]))
            gy = np.maximum(0, np.maximum(y0[k:] - y1[k], y0[k] - y1[k:]))
            for m in np.flatnonzero(gx * gx + gy * gy <= (self.r * self.r) * (1 + 1e-9)) + k:
                b = self.blocks[m]
                if skip is not None and skip(a, b):
                    continue
                dx, dy = self.x[a, None] - self.x[None, b], self.y[a, None] - self.y[None, b]
                dx *= dx
                dy *= dy
                dx += dy
                d = np.sqrt(dx, out=dx)
                near = d <= self.r
                if m == k:
                    near &= np.tri(len(d), k=-1, dtype=bool).T
                if near.any():
                    yield a, b, d, near


def neighbour_counts(cells: DataFrame, r: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, n): how many others lie within r, within the keys; cells without any are absent."""

    def run(t: pa.Table) -> pa.Table:
        g = Group(t, r)
        n = np.zeros(g.n, np.int64)
        for a, b, _, near in g.pairs():
            n[a] += near.sum(1)
            n[b] += near.sum(0)
        some = np.flatnonzero(n)
        return pa.table({"cell_id": g.table.column("cell_id").take(pa.array(some)), "n": n[some]})

    kind = dict(cells.dtypes)["cell_id"]
    each = grouped(cells.select(*keys, "cell_id", "x", "y"), r, list(keys), run, f"cell_id {kind}, n long")
    return each.groupBy("cell_id").agg(F.sum("n").alias("n"))


def links(cells: DataFrame, r: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) whose components are those of all pairs within r: a tile's cells are linked to the least of their piece, so there are five links a cell at most."""

    def run(t: pa.Table) -> pa.Table:
        g = Group(t, r)
        ids = g.table.column("cell_id")
        by_id = pc.sort_indices(ids).to_numpy()
        lab = np.empty(g.n, np.int64)  # places in the order of ids, so that the least label is the least id
        lab[by_id] = np.arange(g.n)
        up = np.arange(g.n)

        def alike(a: slice, b: slice) -> bool:
            return bool((lab[a] == lab[a.start]).all() and (lab[b] == lab[a.start]).all())

        for a, b, _, near in g.pairs(alike):
            while True:
                la, lb = lab[a], lab[b]
                low_a, low_b = np.where(near, lb[None], g.n).min(1), np.where(near, la[:, None], g.n).min(0)
                if (low_a >= la).all() and (low_b >= lb).all():
                    break
                np.minimum.at(up, la, low_a)
                np.minimum.at(up, lb, low_b)
                while (up[up] != up).any():
                    up = up[up]
                lab = up[lab]
        some = np.flatnonzero(by_id[lab] != np.arange(g.n))
        return pa.table({"a": ids.take(pa.array(some)), "b": ids.take(pa.array(by_id[lab[some]]))})

    kind = dict(cells.dtypes)["cell_id"]
    return grouped(cells.select(*keys, "cell_id", "x", "y"), r, list(keys), run, f"a {kind}, b {kind}").distinct()


def least_near(rows: DataFrame, r: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, side): the least root among those within r of each cell without a root, for rows(keys, cell_id, x, y, root)."""

    def run(t: pa.Table) -> pa.Table:
        g = Group(t.append_column("_none", pc.is_null(t.column("root"))), r, "_none")
        none, root = g.table.column("_none").to_numpy(), g.table.column("root")
        known = pc.unique(root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).drop_null()
        known = known.take(pc.sort_indices(known))
        code = pc.index_in(root, value_set=known).to_numpy(zero_copy_only=False)
        code = np.where(none, len(known), np.nan_to_num(code.astype(float))).astype(np.int64)
        best = np.full(g.n, len(known))
        for a, b, _, near in g.pairs(lambda a, b: not (none[a].any() or none[b].any()) or (none[a].all() and none[b].all())):
            best[a] = np.minimum(best[a], np.where(near, code[None, b], len(known)).min(1))
            best[b] = np.minimum(best[b], np.where(near, code[a, None], len(known)).min(0))
        some = np.flatnonzero(none & (best < len(known)))
        return pa.table({"cell_id": g.table.column("cell_id").take(pa.array(some)), "side": known.take(pa.array(best[some]))})

    types = dict(rows.dtypes)
    each = grouped(rows.select(*keys, "cell_id", "x", "y", "root"), r, list(keys), run, f"cell_id {types['cell_id']}, side {types['root']}")
    return each.groupBy("cell_id").agg(F.min("side").alias("side"))


def nearest(targets: DataFrame, candidates: DataFrame, r: float) -> DataFrame:
    """(cell_id, match_id, d): the nearest candidate within r of each target, ties by id; targets without one are absent."""
    kind = dict(candidates.dtypes)["cell_id"]
    own = targets.select("cell_id", F.lit(None).cast(kind).alias("match_id"), "x", "y", F.lit(True).alias("_target"))
    other = candidates.select(F.lit(None).cast(dict(targets.dtypes)["cell_id"]).alias("cell_id"), F.col("cell_id").alias("match_id"), "x", "y", F.lit(False).alias("_target"))

    def run(t: pa.Table) -> pa.Table:
        g = Group(t, r, "_target")
        target, ids = g.table.column("_target").to_numpy(), g.table.column("match_id")
        by_id = pc.sort_indices(ids).to_numpy()
        code = np.empty(g.n, np.int64)  # places in the order of ids
        code[by_id] = np.arange(g.n)
        best, match = np.full(g.n, np.inf), np.full(g.n, g.n)

        def take(a: slice, b: slice, d: np.ndarray) -> None:
            """The nearest of b for the rows of a; d is infinite where there is no pair."""
            low = d.min(1)
            who = np.where(d == low[:, None], code[None, b], g.n).min(1)
            better = (low < best[a]) | ((low == best[a]) & (who < match[a]))
            better &= low < np.inf
            best[a], match[a] = np.where(better, low, best[a]), np.where(better, who, match[a])

        def alike(a: slice, b: slice) -> bool:
            return bool((target[a].all() and target[b].all()) or not (target[a].any() or target[b].any()))

        for a, b, d, near in g.pairs(alike):
            if target[a].any():
                take(a, b, np.where(near & target[a, None] & ~target[None, b], d, np.inf))
            if target[b].any():
                take(b, a, np.where(near & target[None, b] & ~target[a, None], d, np.inf).T)
        some = np.flatnonzero(best < np.inf)
        return pa.table({"cell_id": g.table.column("cell_id").take(pa.array(some)), "match_id": ids.take(pa.array(by_id[match[some]])), "d": best[some]})

    each = grouped(own.unionByName(other), r, [], run, f"cell_id {dict(targets.dtypes)['cell_id']}, match_id {kind}, d double")
    best = each.groupBy("cell_id").agg(F.min(F.struct("d", "match_id")).alias("m"))
    return best.select("cell_id", F.col("m.match_id").alias("match_id"), F.col("m.d").alias("d"))


def median_distances(cells: DataFrame, r: float, key: str | None = None, exact_rows: int = 100_000, bins: int = 1 << 14) -> dict[object, float]:
    """The lower median of the distances of pairs within r for each value of the key (a few; None without one).

    Distances are counted in bins of the radius; the bin that holds the median is cut into bins
    again, until few enough distances are left to be looked at.
    """
    rows = cells.select(*([key] if key else []), "cell_id", "x", "y")
    kind = f"k {dict(cells.dtypes)[key]}, " if key else ""
    chosen: dict[object, list[int]] = {}  # by key: the bin, its bin, ...
    left: dict[object, int] = {}
    rank: dict[object, int] = {}
    depth = 0

    def within(d: np.ndarray, path: list[int]) -> tuple[np.ndarray, float, float]:
        lo, width = 0.0, r
        for b in path:
            d = d[np.minimum(np.floor((d - lo) / width * bins), bins - 1) == b]
            lo, width = lo + b * (width / bins), width / bins
        return d, lo, width

    def visit(paths: dict[object, list[int]], counted: bool) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            k = t.column(key)[0].as_py() if key else None
            values, n = np.empty(0), np.zeros(0, np.int64)
            if not paths or k in paths:
                total = np.zeros(bins, np.int64)
                for _, _, d, near in Group(t, r).pairs():
                    own, lo, width = within(d[near], paths.get(k, []))
                    if counted:
                        total += np.bincount(np.clip(np.floor((own - lo) / width * bins), 0, bins - 1).astype(np.int64), minlength=bins)
                    elif len(own):
                        values, at = np.unique(np.concatenate([values, own]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([n, np.ones(len(own), np.int64)])).astype(np.int64)
                if counted:
                    values = np.flatnonzero(total).astype(float)
                    n = total[total > 0]
            return pa.table(({"k": pa.array([k] * len(n), t.schema.field(key).type)} if key else {}) | {"v": values, "n": n})

        return run

    def collected(counted: bool) -> dict[object, list[tuple[float, int]]]:
        each = grouped(rows, r, [key] if key else [], visit(dict(chosen), counted), f"{kind}v double, n long")
        by = ["k", "v"] if key else ["v"]
        out: dict[object, list[tuple[float, int]]] = {}
        for row in each.groupBy(*by).agg(F.sum("n").alias("n")).orderBy("v").collect():  # bins, or exact_rows about, a key
            out.setdefault(row["k"] if key else None, []).append((row["v"], row["n"]))
        return out

    while depth < 4 and (not depth or max(left.values(), default=0) > exact_rows):
        for k, counts in collected(True).items():
            want = rank.setdefault(k, (sum(n for _, n in counts) - 1) // 2 + 1)
            for b, n in counts:
                if want <= n:
                    chosen.setdefault(k, []).append(int(b))
                    left[k], rank[k] = n, want
                    break
                want -= n
        depth += 1
    out = {}
    for k, counts in collected(False).items() if chosen else ():
        want = rank[k]
        for v, n in counts:
            if want <= n:
                out[k] = v
                break
            want -= n
    return out
