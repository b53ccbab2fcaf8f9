"""Spatial joins, tilings, aggregation and clustering over cells(cell_id, x, y)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.portable import order_key, uniform
from ..sources.scratch import written
from .graph import components
from .ranks import quantiles
from .tiles import least_near, links, nearest, neighbour_counts


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def tile(c: str, r: float) -> Column:
    return F.floor(F.col(c) / r).cast("bigint")


def near_tiles(df: DataFrame, r: float, reach: int = 1) -> DataFrame:
    """df once for each tile within reach of its own."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    offs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    return df.withColumn("_o", F.explode(offs)).withColumn("_tx", tile("x", r) + F.col("_o.i")).withColumn("_ty", tile("y", r) + F.col("_o.j")).drop("_o")


def radius_pairs(cells: DataFrame, r: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, d) with i < j and distance at most r, within the keys.

    Both sides are hashed to tiles of side r, so that the join is an equi-join on the
    tile; only one side visits the neighbours.
    """
    a = cells.select(*keys, F.col("cell_id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), tile("x", r).alias("_tx"), tile("y", r).alias("_ty"))
    b = near_tiles(cells.select(*keys, "cell_id", "x", "y"), r).select(*keys, F.col("cell_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), "_tx", "_ty")
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, [*keys, "_tx", "_ty"]).filter("i < j").withColumn("d", d).filter(F.col("d") <= r).select(*keys, "i", "j", "d")


def extent(cells: DataFrame) -> tuple[float, float, int]:
    w, h, n = cells.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    return float(w or 0.0), float(h or 0.0), int(n)


def density_radius(cells: DataFrame, neighbours: float) -> float:
    """The radius of a circle that holds so many cells where they fill their bounding box evenly: pairs within it grow with the cells."""
    w, h, n = extent(cells)
    return math.sqrt(w * h * neighbours / (math.pi * n)) if n else 0.0


#: Halvings of the extent after which a tile is taken as it is: its cells are at one place, as far as doubles tell.
DEEPEST = 45


def at_level(df: DataFrame, x0: float, y0: float, size: float, level: Column) -> DataFrame:
    """df with _tx, _ty: its tile when the extent is halved ``level`` times."""
    side = F.lit(size) / F.pow(F.lit(2.0), level)
    return df.withColumn("_tx", F.floor((F.col("x") - x0) / side).cast("bigint")).withColumn("_ty", F.floor((F.col("y") - y0) / side).cast("bigint"))


def tile_levels(cells: DataFrame, x0: float, y0: float, size: float, least: int, start: int) -> DataFrame:
    """cells with ``level``: how often the extent is halved until a cell's tile holds about 4 * ``least`` cells or fewer.

    All cells begin at one level. Those in crowded tiles go as many levels deeper as even
    density asks for, and are counted again; the others are left alone.
    """
    todo, done = cells.withColumn("level", F.lit(start)), None
    while True:
        tiled = at_level(todo, x0, y0, size, F.col("level"))
        n = tiled.groupBy("level", "_tx", "_ty").agg(F.count("*").alias("_n"))
        crowded = (F.col("_n") > 4 * least) & (F.col("level") < DEEPEST)
        deeper = F.greatest(F.lit(1), F.floor(F.log2(F.col("_n") / least) / 2)).cast("int")
        seen = written(tiled.join(n, ["level", "_tx", "_ty"]).withColumn("_more", F.when(crowded, deeper).otherwise(0)).drop("_tx", "_ty", "_n"), "levels")
        fine = seen.filter("_more = 0").drop("_more")
        done = fine if done is None else done.unionByName(fine)
        todo = seen.filter("_more > 0").withColumn("level", F.least(F.lit(DEEPEST), F.col("level") + F.col("_more"))).drop("_more")
        if todo.isEmpty():
            return done


def candidates_at_levels(todo: DataFrame, points: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """(i, level, j, d): the points in the 3 x 3 tiles around each cell of todo, at its own level."""
    levels = [r[0] for r in todo.select("level").distinct().collect()]  # DEEPEST at most
    a = at_level(todo, x0, y0, size, F.col("level")).select(F.col("cell_id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), "level", "_tx", "_ty")
    for c in ("_tx", "_ty"):
        a = a.withColumn(c, F.explode(F.array(*(F.col(c) + o for o in (-1, 0, 1)))))
    every = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    b = at_level(every, x0, y0, size, F.col("level")).select(F.col("cell_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), "level", "_tx", "_ty")
    return a.join(b, ["level", "_tx", "_ty"]).filter("i <> j").withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def knn(cells: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each cell, ties by id.

    A cell looks over the 3 x 3 tiles around it at a level of its own, where its tile holds
    about 4 (k + 1) cells or fewer, so that clumps are split as finely as they are dense: a
    tile with many cells is only looked at from the few around it that are not crowded. A
    cell is settled once k neighbours lie within the side of its tiles; the rest look again
    over tiles of twice the side. Each round writes what it found and what is left. The loop
    ends at the latest when a tile covers the whole extent.
    """
    x0, y0, w, h, n = cells.agg(F.min("x"), F.min("y"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    if n < 2:
        return cells.select(F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    want, done = min(k, n - 1), None
    size = max(w, h, 1e-12) * (1 + 1e-9)  # the one tile of level 0 holds all
    start = max(0, math.floor(math.log2(n / (k + 1)) / 2))
    points = cells.select("cell_id", "x", "y")
    todo = written(tile_levels(points, x0, y0, size, k + 1, start), "todo")
    own = Window.partitionBy("i")
    while True:
        near = candidates_at_levels(todo, points, x0, y0, size)
        ranked = near.select("i", "level", "j", "d", F.row_number().over(own.orderBy("d", "j")).alias("rank")).filter(F.col("rank") <= want)
        side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
        sure = (F.count("*").over(own) == want) & ((F.col("level") == 0) | (F.max("d").over(own) <= side))
        found = written(ranked.withColumn("sure", sure).filter("sure").drop("sure", "level"), "neighbours", n * want)
        done = found if done is None else done.unionByName(found)
        left = todo.join(found.select(F.col("i").alias("cell_id")).distinct(), "cell_id", "left_anti")
        todo = written(left.withColumn("level", F.greatest(F.lit(0), F.col("level") - 1)), "todo", n)
        if todo.isEmpty():
            return done


def auto_eps(cells: DataFrame, share: float = 0.9, factor: float = 1.0) -> DataFrame:
    """A quantile of the distance to the nearest other cell, times factor; null without one."""
    at = quantiles(knn(cells, 1), "d", [share])
    return cells.sparkSession.createDataFrame([(at[0] * factor if at else None,)], "eps double")


def nearest_match(targets: DataFrame, candidates: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """(cell_id, match_id, d): the nearest candidate within the tolerance, ties by id; null without one.

    strict: a target without a match, or a candidate that is the match of two, is an error.
    """
    out = matches(targets, candidates, tolerance)
    if strict:
        n, some, each = out.agg(F.count("*"), F.count("match_id"), F.countDistinct("match_id")).first()
        if some < n or each < some:
            raise ValueError(f"{n - some} of {n} cells have no match within {tolerance}; {some - each} share theirs")
    return out


def matches(targets: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """(cell_id, match_id, d): the nearest candidate within the tolerance, ties by id; null without one."""
    best = nearest(targets, candidates, tolerance)
    return targets.select("cell_id").join(best, "cell_id", "left").select("cell_id", "match_id", "d")


def nearest_center(cells: DataFrame, centers: list[tuple[int, float, float]]) -> DataFrame:
    """(cell_id, center, d) by a least over the given centres, with no join."""
    each = [F.struct(distance(F.col("x"), F.col("y"), F.lit(float(cx)), F.lit(float(cy))).alias("d"), F.lit(i).alias("center")) for i, cx, cy in centers]
    best = F.least(*each) if len(each) > 1 else each[0]
    return cells.select("cell_id", best.alias("m")).select("cell_id", F.col("m.center").alias("center"), F.col("m.d").alias("d"))


def with_bin(cells: DataFrame, radius: float, shape: str = "square") -> DataFrame:
    f = {"square": scalar.square_bin, "hexagon": scalar.hex_bin}[shape]
    return cells.withColumn("bin", f(F.col("x"), F.col("y"), radius))


def bin_cells(cells: DataFrame, expr: DataFrame | Callable[[DataFrame], DataFrame], radius: float, shape: str = "square", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pseudo-spots: (keys, bin, x, y, gene, value, n_cells) with bin centres and summed values.

    The origin is the least corner of the cells. expr: (cell_id, gene, value), or a function from the
    binned cells (cell_id, keys, bin) to rows (keys, bin, gene, value) that need not be summed by cell.
    """
    lo = cells.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    moved = cells.crossJoin(F.broadcast(lo)).withColumn("x", F.col("x") - F.col("_x0")).withColumn("y", F.col("y") - F.col("_y0"))
    binned = with_bin(moved, radius, shape).select("cell_id", *keys, "bin")
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n_cells"))
    rows = expr(binned) if callable(expr) else binned.join(expr, "cell_id")
    sums = rows.groupBy(*keys, "bin", "gene").agg(F.sum("value").alias("value"))
    center = {"square": scalar.square_center, "hexagon": scalar.hex_center}[shape](F.col("bin"), radius)
    out = sums.join(counts, [*keys, "bin"]).crossJoin(F.broadcast(lo))
    return out.select(*keys, "bin", (center[0] + F.col("_x0")).alias("x"), (center[1] + F.col("_y0")).alias("y"), "gene", "value", "n_cells")


def block_stats(cells: DataFrame, radius: float, shape: str = "square") -> DataFrame:
    n = with_bin(cells, radius, shape).groupBy("bin").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_blocks"), F.avg("n").alias("mean_cells"), F.percentile("n", F.lit(0.5)).alias("median_cells"),
        F.min("n").alias("min_cells"), F.max("n").alias("max_cells"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"),
    )


def principal_axis(cells: DataFrame) -> DataFrame:
    """(lambda, ux, uy): the larger eigenvalue of the coordinates' covariance and its unit vector, in closed form."""
    m = cells.agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"))
    lam = (F.col("a") + F.col("c")) / 2 + F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    out = m.withColumn("lam", lam).withColumn("vx", F.when(F.col("b") == 0, (F.col("a") >= F.col("c")).cast("double")).otherwise(F.abs("b")))
    out = out.withColumn("vy", F.when(F.col("b") == 0, 1 - F.col("vx")).otherwise(F.signum("b") * (F.col("lam") - F.col("a"))))
    size = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return out.select("lam", (F.col("vx") / size).alias("ux"), (F.col("vy") / size).alias("uy"))


def dbscan(cells: DataFrame, eps: float, min_samples: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, cluster): -1 is noise; a border cell joins its neighbours' lowest cluster.

    keys: columns, such as the cell type, within which cells are neighbours.

    A cell is a core if its closed ball holds min_samples cells, itself included.
    Clusters are components of core-core links, numbered by their least core.
    Pairs are counted, linked and looked over in the tiles where they meet; at most five
    links a cell are rows.
    """
    places = written(cells.select(*keys, "cell_id", "x", "y"), "places")
    degree = neighbour_counts(places, eps, keys)
    core = F.coalesce(F.col("n") + 1, F.lit(1)) >= min_samples
    marked = written(places.join(degree, "cell_id", "left").withColumn("core", core).drop("n"), "marked")
    comp = components(links(marked.filter("core"), eps, keys)).withColumnRenamed("v", "cell_id")
    rooted = marked.join(comp, "cell_id", "left").withColumn("root", F.when(F.col("core"), F.coalesce("c", "cell_id"))).drop("c")
    rooted = written(rooted, "rooted")
    root = rooted.filter("core").select(F.col("cell_id").alias("i"), "root")
    border = least_near(rooted, eps, keys).withColumnRenamed("cell_id", "i")
    ids = root.select("root").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("bigint"))
    owner = cells.select(F.col("cell_id").alias("i")).join(root, "i", "left").join(border, "i", "left").select("i", F.coalesce("root", "side").alias("root"))
    return owner.join(ids, "root", "left").select(F.col("i").alias("cell_id"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def nearest_of(centers: list[tuple[float, float]]) -> Column:
    """(d2, center): the squared distance to the nearest of a few centres, and its number; ties to the lower."""
    each = [F.struct(((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)).alias("d2"), F.lit(k).alias("center")) for k, (cx, cy) in enumerate(centers)]
    return F.least(*each) if len(each) > 1 else each[0]


def kmeans_seeds(cells: DataFrame, k: int, seed: int, rounds: int = 3) -> list[tuple[float, float]]:
    """k starting centres, the same in every run: oversampled by distance, then thinned out.

    The first candidate is the cell of least hash. Each round adds cells with probability
    2 k d^2 / sum d^2, d being the distance to the nearest candidate, by a hash of the round
    and the cell: about 2 k a round, whatever the number of cells. Candidates weigh what is
    nearest to them; the heaviest is taken first, then always that of largest weight times
    squared distance to those taken. Equal places count once.
    """
    first = cells.agg(F.min_by(F.struct("x", "y"), F.struct(order_key(seed, "cell_id"), "cell_id"))).first()[0]
    found = [(first["x"], first["y"])]
    for r in range(1, rounds + 1):
        d2 = cells.select("cell_id", "x", "y", nearest_of(found)["d2"].alias("d2"))
        total = d2.agg(F.sum("d2")).first()[0]
        if not total:
            break
        new = d2.filter(uniform(seed, F.lit(r), "cell_id") < F.col("d2") * (2 * k) / total).select("x", "y").distinct().orderBy("x", "y").collect()
        found += [(x, y) for x, y in new if (x, y) not in found]
    weights = dict(cells.groupBy(nearest_of(found)["center"]).count().collect())
    left = [(weights.get(i, 0), p) for i, p in enumerate(found)]
    taken: list[tuple[float, float]] = []
    while left and len(taken) < k:
        def gain(c: tuple[int, tuple[float, float]]) -> tuple[float, float, float]:
            w, (x, y) = c
            return w * min(((x - a) ** 2 + (y - b) ** 2 for a, b in taken), default=1.0), -x, -y

        best = max(left, key=gain)
        taken.append(best[1])
        left.remove(best)
    return taken


def lloyd_step(cells: DataFrame, centers: list[tuple[float, float]]) -> list[tuple[int, float, float, int]]:
    """(center, x, y, n): the mean and number of the cells nearest to each centre; a centre without cells stays where it is."""
    sums = cells.groupBy(nearest_of(centers)["center"].alias("center")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    found = {r["center"]: (r["x"], r["y"], r["n"]) for r in sums.collect()}
    return [(i, *found.get(i, (*c, 0))) for i, c in enumerate(centers)]


def kmeans(cells: DataFrame, k: int, seed: int, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(cell_id, cluster): Lloyd's iteration from kmeans_seeds, at most as many clusters as cells (and places).

    A round is one partial aggregate; only the centres pass through the driver. It ends when no
    centre moves by more than the tolerance times the extent.
    """
    w, h, n = extent(cells)
    if not n:
        return cells.select("cell_id", F.lit(0).alias("cluster"))
    centers = kmeans_seeds(cells, min(k, n), seed)
    for _ in range(rounds):
        moved = [(x, y) for _, x, y, _ in lloyd_step(cells, centers)]
        far = max(math.hypot(a - c, b - d) for (a, b), (c, d) in zip(moved, centers, strict=True))
        centers = moved
        if far <= tolerance * max(w, h):
            break
    return cells.select("cell_id", nearest_of(centers)["center"].alias("cluster"))


def relabel_by_size(clusters: DataFrame, least: int) -> DataFrame:
    """(cell_id, region): clusters of at least so many cells, 0 for the largest; ties by old number."""
    sizes = clusters.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rank = sizes.withColumn("region", (F.row_number().over(Window.orderBy(F.col("n").desc(), "cluster")) - 1).cast("bigint"))
    return clusters.join(rank.select("cluster", "region"), "cluster").select("cell_id", "region")


def denoise(cells: DataFrame, radius: float) -> DataFrame:
    """The largest connected piece of each cell type under links within radius; a type without links stays whole."""
    comp = components(links(cells, radius, ("cell_type",)))
    own = cells.join(comp.withColumnRenamed("v", "cell_id"), "cell_id", "left").withColumn("c", F.coalesce("c", "cell_id"))
    size = own.groupBy("cell_type", "c").agg(F.count("*").alias("n"))
    best = size.groupBy("cell_type").agg(F.max(F.struct("n", (-F.col("c")).alias("m"))).alias("b"))
    best = best.select("cell_type", F.when(F.col("b.n") > 1, -F.col("b.m")).alias("keep"))
    return own.join(best, "cell_type").filter(F.col("keep").isNull() | (F.col("c") == F.col("keep"))).select(*cells.columns)


def bin_covariates(cells: DataFrame, radius: float, covariates: list[str], shape: str = "square") -> DataFrame:
    """(bin, n_cells, covariates): how many cells each bin of bin_cells holds, and the mean of each covariate."""
    lo = cells.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    f = {"square": scalar.square_bin, "hexagon": scalar.hex_bin}[shape]
    bin_ = f(F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0"), radius)
    return cells.crossJoin(F.broadcast(lo)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_cells"), *(F.avg(c).alias(c) for c in covariates))


def count_stats(bins: DataFrame) -> DataFrame:
    """One row: number of bins, and mean, median, least and most cells of a bin. Medians come from counts of counts."""
    n = bins.groupBy("n_cells").agg(F.count("*").alias("c"))
    whole = Window.orderBy("n_cells").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = n.select("n_cells", "c", F.sum("c").over(Window.orderBy("n_cells")).alias("u"), F.sum("c").over(whole).alias("t"))
    lower, upper = (F.min(F.when(F.col("u") >= F.floor((F.col("t") + k) / 2), F.col("n_cells"))) for k in (1, 2))
    return upto.agg(
        F.sum("c").alias("n_bins"), (F.sum(F.col("n_cells") * F.col("c")) / F.sum("c")).alias("mean_cells"), ((lower + upper) / 2).alias("median_cells"),
        F.min("n_cells").alias("min_cells"), F.max("n_cells").alias("max_cells"),
    )


def regions(cells: DataFrame, clusters: DataFrame, least: int, keys: tuple[str, ...] = ("cell_type",)) -> DataFrame:
    """(keys, region, n_cells, cx, cy): clusters of at least so many cells with their centroids; 0 is the largest of its keys."""
    n = clusters.filter("cluster >= 0").join(cells, "cell_id").groupBy(*keys, "cluster").agg(F.count("*").alias("n_cells"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    order = Window.partitionBy(*keys).orderBy(F.col("n_cells").desc(), "cluster")
    return n.filter(F.col("n_cells") >= least).withColumn("region", F.row_number().over(order) - 1).drop("cluster")


def middle_cluster(cells: DataFrame, clusters: DataFrame, axis: str = "x") -> DataFrame:
    """(cell_id) of the cluster in the middle along x, y or pc1, the first principal axis; ties by number."""
    if axis == "pc1":
        u = principal_axis(cells)
        at = cells.crossJoin(F.broadcast(u)).select("cell_id", (F.col("x") * F.col("ux") + F.col("y") * F.col("uy")).alias("_p"))
    else:
        at = cells.select("cell_id", F.col(axis).alias("_p"))
    own = clusters.filter("cluster >= 0")
    m = own.join(at, "cell_id").groupBy("cluster").agg(F.avg("_p").alias("_m"))
    m = m.select("cluster", (F.row_number().over(Window.orderBy("_m", "cluster")) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("k"))
    return own.join(m.filter(F.col("place") == F.floor(F.col("k") / 2)), "cluster").select("cell_id")


def kde(points: DataFrame, n: int, width: float, reach: float = 4.0) -> DataFrame:
    """(bx, by, density) at the centres of an n x n grid over the extent: normal kernels, cut off at reach widths.

    Points meet the grid's places in tiles of the reach, so only near ones are compared.
    """
    e = points.agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"), F.count("*").alias("_n"))
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    grid = e.withColumn("bx", F.explode(axis)).withColumn("by", F.explode(axis))
    grid = grid.withColumn("x", F.col("_a") + (F.col("bx") + 0.5) * (F.col("_b") - F.col("_a")) / n).withColumn("y", F.col("_c") + (F.col("by") + 0.5) * (F.col("_d") - F.col("_c")) / n)
    r = reach * width
    g = near_tiles(grid.select("bx", "by", "x", "y", "_n"), r).withColumnsRenamed({"x": "gx", "y": "gy"})
    p = points.select(F.col("x").alias("px"), F.col("y").alias("py"), tile("x", r).alias("_tx"), tile("y", r).alias("_ty"))
    d = distance(F.col("px"), F.col("py"), F.col("gx"), F.col("gy"))
    near = g.join(p, ["_tx", "_ty"]).withColumn("d", d).filter(F.col("d") <= r)
    kernel = F.exp(-F.col("d") * F.col("d") / (2 * width * width)) / (2 * math.pi * width * width)
    return near.groupBy("bx", "by", "_n").agg(F.sum(kernel).alias("s")).select("bx", "by", (F.col("s") / F.col("_n")).alias("density"))


def density(points: DataFrame, n: int) -> DataFrame:
    """Counts in n x n equal bins over the extent; the upper edges belong to the last bins."""
    e = points.agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))

    def slot(v: str, lo: str, hi: str) -> Column:
        width = F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0)
        return F.least(F.floor((F.col(v) - F.col(lo)) / width * n), F.lit(n - 1)).cast("bigint")

    return points.crossJoin(F.broadcast(e)).groupBy(slot("x", "_a", "_b").alias("bx"), slot("y", "_c", "_d").alias("by")).agg(F.count("*").alias("n"))
