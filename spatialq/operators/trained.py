"""Tests whose statistic is the loss of a trained network; every task trains on its own cells.

A table has one row a cell: its place in every layout, its measurements, and where it
counts. One step is one pass over that table: each task adds up the gradients of all
models over its cells, the sums are added up by model, and only they, a few thousand
numbers a model, reach the driver, which moves the parameters. Cells are never gathered,
so a layout may be of any size; models run in groups of bounded parameter bytes.

Steps of few cells would be one job each, and jobs would grow with the cells. Models do not
depend on each other, so then a job takes many steps: each task has some of the models and
moves them over the same stretch of batches, PASS_BYTES of cells at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.networks import Adam, DepthModel, Plan, loss_slopes, loss_sums
from ..functions.portable import order_key
from ..sources.scratch import scratch, written
from .expr import type_size_factors
from .metrics import nll_of_mse, permutation_p
from .ranks import hash_rank

GROUP_BYTES = 32 << 20
#: Cells of one round of matrices: few enough that these stay in the processor's cache.
CHUNK = 512
PASS_BYTES = 32 << 20


def cell_table(slots: DataFrame, cells: DataFrame, expr: DataFrame, plan: Plan, by_type: bool = False, covariate: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """One row a cell: xs, ys (by slot), a (by gene), factor, kind, cov, fit and judge (by variant).

    factor: one number a gene for a Poisson loss by type, one for all genes otherwise. Layouts take the true layout's mean and scale. covariate: (cell_id, z), an input of
    the decoder. masks: (variant, cell_id, fit, judge), which cells train and judge each
    variant of a model; cells that a variant does not name are out of it.
    """
    m = slots.filter("slot = 0").agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    place = [((F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 1e-8, F.col(f"_s{c}")).otherwise(1.0)).alias(c) for c in "xy"]
    lay = slots.crossJoin(F.broadcast(m)).select("cell_id", F.struct("slot", *place).alias("p"))
    lay = lay.groupBy("cell_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("cell_id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    by_gene = plan.metric == "poisson" and by_type
    if by_gene:
        typed = expr.join(cells.select("cell_id", "cell_type"), "cell_id")
        expr = typed.join(type_size_factors(expr, cells), ["cell_type", "gene"]).select("cell_id", "gene", "value", "factor")
    else:
        expr = expr.withColumn("factor", F.lit(1.0))
    rows = expr.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "value", "factor"))).alias("v"), F.sum("value").alias("total"))
    factor = F.col("v.factor") if by_gene else F.array("total") if plan.metric == "poisson" else F.array(F.lit(1.0))
    rows = rows.select("cell_id", F.col("v.value").alias("a"), factor.alias("factor"))
    kinds = sorted(str(r[0]) for r in cells.select("cell_type").distinct().collect()) if by_type else []  # a few types
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("cell_type").cast("string")).cast("int") - 1 if by_type else F.lit(0)
    own = cells.select("cell_id", kind.alias("kind")).join(lay, "cell_id").join(rows, "cell_id")
    own = own.join(covariate.select("cell_id", F.array("z").alias("cov")), "cell_id") if covariate is not None else own.withColumn("cov", F.array().cast("array<double>"))
    if masks is None:
        own = own.withColumn("fit", F.array(F.lit(True))).withColumn("judge", F.array(F.lit(True)))
    else:
        n = masks.agg(F.max("variant")).first()[0] + 1
        named = masks.groupBy("cell_id").agg(*(F.map_from_entries(F.collect_list(F.struct("variant", c))).alias(c) for c in ("fit", "judge")))
        every = F.sequence(F.lit(0), F.lit(n - 1))

        def flags_of(c: str):
            return F.transform(every, lambda v: F.coalesce(F.try_element_at(F.col(c), v), F.lit(False))).alias(c)

        own = own.join(named, "cell_id", "left").select("cell_id", "kind", "xs", "ys", "a", "factor", "cov", flags_of("fit"), flags_of("judge"))
    return written(own, "cells")


def narrowed(table: DataFrame, kept: list[bool], plan: Plan, by_type: bool = False) -> DataFrame:
    """A cell_table with the kept genes only, given in its order: cells are read once, and nothing is moved."""
    def pick(c: str):
        return F.filter(c, lambda _, i: F.get(F.array(*map(F.lit, kept)), i))

    out = table.withColumn("a", pick("a"))
    if plan.metric == "poisson":
        total = F.aggregate("a", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        out = out.withColumn("factor", pick("factor") if by_type else F.array(total))
    return written(out, "cells")


def null_table(cells: DataFrame, nulls: DataFrame) -> DataFrame:
    """As cell_table, for one layout and nulls(slot, cell_id, a) that change the measurements: a holds those of all slots in turn."""
    m = cells.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    place = [F.array((F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 1e-8, F.col(f"_s{c}")).otherwise(1.0)).alias(f"{c}s") for c in "xy"]
    lay = cells.crossJoin(F.broadcast(m)).select("cell_id", F.lit(0).alias("kind"), *place, F.array().cast("array<double>").alias("cov"), F.array(F.lit(True)).alias("fit"), F.array(F.lit(True)).alias("judge"))
    a = nulls.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("slot", "a"))).alias("r")).select("cell_id", F.flatten("r.a").alias("a"))
    return written(lay.join(a, "cell_id").withColumn("factor", F.array(F.lit(1.0))), "cells")


@dataclass(frozen=True)
class Model:
    slot: int
    rerun: int
    variant: int
    seed: int


def nested(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    col = batch.column(batch.schema.names.index(name))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


@dataclass
class Rows:
    """Cells of one batch as matrices, a row a cell."""

    kind: np.ndarray
    lists: dict[str, np.ndarray]

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        kind = batch.column(batch.schema.names.index("kind")).to_numpy(zero_copy_only=False)
        return Rows(kind, {c: nested(batch, c) for c in ("xs", "ys", "a", "factor", "cov", "fit", "judge")})

    def at(self, rows: np.ndarray) -> Rows:
        return Rows(self.kind[rows], {c: m[rows] for c, m in self.lists.items()})


def summed(net: DepthModel, models: list[Model], params: np.ndarray, cells: Rows, genes: int, nulls: bool, warm: bool) -> np.ndarray:
    """For each model: summed training loss, judged loss, values that train and judge, and the gradient."""
    xs, ys, a, factor, cov, fit, judge = cells.lists.values()
    total = np.empty((len(models), 4 + params.shape[1]))
    for k, m in enumerate(models):
        net.load(params[k])
        at, own = (0, a[:, m.slot * genes : (m.slot + 1) * genes]) if nulls else (m.slot, a)
        out = net.predict(np.stack([xs[:, at], ys[:, at]], 1), cells.kind, cov if cov.shape[1] else None)
        metric = "gaussian" if warm else net.plan.metric
        if warm:
            own = np.log1p(own * (1e4 / np.maximum(own.sum(1, keepdims=True), 1)))
        each = loss_sums(out, own, factor, metric)
        on = fit[:, m.variant].astype(float)
        slope = loss_slopes(out, own, factor, metric) * on[:, None]
        judges = judge[:, m.variant].astype(float)
        total[k] = np.concatenate([[each @ on, each @ judges, on.sum() * genes, judges.sum() * genes], *(g.ravel() for g in net.gradients(slope))])
    return total


class Trainer:
    """Trains models(slot, rerun, variant) on a cell_table, or with nulls on a null_table."""

    def __init__(self, table: DataFrame, plan: Plan, n_slots: int, reruns: int = 1, variants: int = 1, nulls: bool = False) -> None:
        self.table, self.plan, self.nulls = table, plan, nulls
        self.models = [Model(s, r, v, plan.seed * 1_000_003 + s * 1009 + r) for s in range(n_slots) for v in range(variants) for r in range(reruns)]
        head = table.agg(F.max(F.size("a")), F.max(F.size("cov")), F.max("kind"), *(F.count_if(F.get(c, F.lit(v))) for v in range(variants) for c in ("fit", "judge"))).first()
        if head[0] is None:
            raise ValueError("no cell has measurements and a place in every layout")
        self.shape = (head[0] // (n_slots if nulls else 1), head[2] + 1, head[1])
        self.counts = np.array(head[3:], float).reshape(variants, 2) * self.shape[0]
        if (self.counts == 0).any():
            raise ValueError("a mask holds no cell")
        size = self.network(self.models[0]).flat().size
        self.best = np.zeros((len(self.models), size))
        self.found = np.full((len(self.models), 2), np.inf)
        self.history: list[tuple[int, int, float]] = []
        self.n_parts, self.dealt = self.batches()
        width = sum(table.select(*(F.size(c).alias(c) for c in ("xs", "ys", "a", "factor", "cov", "fit", "judge"))).first())
        #: Steps of a job: those of PASS_BYTES of cells; 1: a step is a job, which all tasks share.
        self.stretch = max(1, PASS_BYTES // (8 * width * plan.batch)) if self.n_parts > 1 else 1
        step = max(1, GROUP_BYTES // (8 * size * (3 if self.stretch > 1 else 1)))
        for i in range(0, len(self.models), step):
            self.train(np.arange(i, min(i + step, len(self.models))))

    def network(self, m: Model) -> DepthModel:
        genes, kinds, cov = self.shape
        return DepthModel(genes, replace(self.plan, seed=m.seed), kinds, cov)

    @property
    def parts(self) -> list[DataFrame]:
        return [self.dealt.filter(F.col("batch") == i).drop("batch") for i in range(self.n_parts)] if self.n_parts > 1 else [self.table]

    def batches(self) -> tuple[int, DataFrame]:
        """How many parts of about ``batch`` cells there are, dealt by hash once for all models and epochs alike, and the table with a column batch.

        The parts are folders of one written table, so a step reads its own and moves nothing.
        """
        n = self.table.count()
        k = max(1, -(-n // self.plan.batch)) if self.plan.batch else 1
        if k == 1:
            return 1, self.table
        path = scratch(self.table.sparkSession, "batches")
        bucket = hash_rank(self.table, [], order_key(self.plan.seed, "cell_id"), "cell_id", rows=n)
        dealt = bucket.withColumn("batch", ((F.col("_r") - 1) % k).cast("int")).drop("_r")
        dealt.repartition(k, "batch").write.partitionBy("batch").option("compression", "zstd").parquet(path)
        return k, self.table.sparkSession.read.schema(dealt.schema).parquet(path)

    def train(self, rows: np.ndarray) -> None:
        """Steps over the parts until the epochs or every model's patience run out; the best state of each is kept.

        With one part the loss before a step is the epoch's; with more, it is that of a pass over all
        cells after them. Each epoch visits the parts in a seeded order, the same for all models.
        """
        plan = self.plan
        adam = Adam(np.stack([self.network(self.models[i]).flat() for i in rows]), plan.rate)
        left = np.full(len(rows), plan.patience)
        active = np.arange(len(rows))
        n_parts = self.n_parts
        inner = sum(p.size for p in self.network(self.models[0]).encoder.params())
        for epoch in range(plan.epochs):
            warm = plan.metric == "poisson" and epoch < plan.warm
            fixed = inner if plan.freeze and plan.metric == "poisson" and 0 < plan.warm <= epoch else 0
            if plan.metric == "poisson" and plan.warm and epoch == plan.warm:  # losses of another kind begin
                self.found[rows[active]], left[active] = np.inf, plan.patience
            order = np.random.default_rng([plan.seed, epoch]).permutation(n_parts)
            for first in range(0, len(order), self.stretch):
                numbers = order[first : first + self.stretch]
                rates = [self.rate((epoch * n_parts + first + i) / (plan.epochs * n_parts)) for i in range(len(numbers))]
                own = [self.models[i] for i in rows[active]]
                if self.stretch > 1:
                    self.moved(own, adam, active, numbers, rates, fixed, warm)
                    continue
                sums = self.sums(own, adam.params[active], self.table if n_parts == 1 else self.dealt.filter(F.col("batch") == int(numbers[0])), warm)
                seen = self.counts[[m.variant for m in own]] if n_parts == 1 else np.maximum(sums[:, 2:4], 1)
                before = active
                if n_parts == 1 and not (active := self.judged(rows, active, left, epoch, sums[:, :2] / seen, adam.params)).size:
                    return
                at = np.isin(before, active)
                adam.step(active, (sums[:, 4:] / seen[:, :1])[at], rates[0], fixed)
            if n_parts > 1:
                own = [self.models[i] for i in rows[active]]
                sums = self.sums(own, adam.params[active], self.table, warm)
                if not (active := self.judged(rows, active, left, epoch, sums[:, :2] / self.counts[[m.variant for m in own]], adam.params)).size:
                    return

    def judged(self, rows: np.ndarray, active: np.ndarray, left: np.ndarray, epoch: int, losses: np.ndarray, params: np.ndarray) -> np.ndarray:
        """Note an epoch's losses, keep better states, and return the models whose patience lasts."""
        self.history += [(epoch, int(i), float(x)) for i, x in zip(rows[active], losses[:, 0], strict=True)]
        better = losses[:, 0] < self.found[rows[active], 0] - 1e-5
        self.found[rows[active[better]]] = losses[better]
        self.best[rows[active[better]]] = params[active[better]]
        left[active] = np.where(better, self.plan.patience, left[active] - 1)
        return active[left[active] > 0]

    def rate(self, progress: float) -> float:
        plan = self.plan
        return plan.least_rate + (plan.rate - plan.least_rate) * (1 + np.cos(np.pi * progress)) / 2 if plan.cosine else plan.rate

    def moved(self, models: list[Model], adam: Adam, active: np.ndarray, numbers: np.ndarray, rates: list[float], fixed: int, warm: bool) -> None:
        """Steps over the numbered batches in turn, as one job: a task has some of the models and reads all these batches."""
        spark, plan, shape, nulls = self.table.sparkSession, self.plan, self.shape, self.nulls
        teams = min(len(models), spark.sparkContext.defaultParallelism)
        shared = spark.sparkContext.broadcast((adam.params[active], adam.m[active], adam.v[active], adam.t))  # at most GROUP_BYTES

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks()
            at = {name: whole.column(name).to_numpy() for name in ("team", "batch")}
            cells = Rows.of(whole.drop_columns(["team"]).to_batches()[0])
            net = DepthModel(shape[0], plan, shape[1], shape[2])
            for team in np.unique(at["team"]):
                mine = np.arange(team, len(models), teams)
                own, state = [models[i] for i in mine], Adam(shared.value[0][mine], plan.rate)
                state.m, state.v, state.t = shared.value[1][mine], shared.value[2][mine], shared.value[3]
                for number, rate in zip(numbers, rates, strict=True):
                    sums = summed(net, own, state.params, cells.at(np.flatnonzero((at["team"] == team) & (at["batch"] == number))), shape[0], nulls, warm)
                    state.step(np.arange(len(own)), sums[:, 4:] / np.maximum(sums[:, 2:3], 1), rate, fixed)
                yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(list(np.concatenate([state.params, state.m, state.v], 1)), pa.list_(pa.float64()))], names=["model", "state"])

        stretch = self.dealt.filter(F.col("batch").isin(numbers.tolist())).coalesce(1)
        # Spark puts branches of one partition each into one task; a branch of none keeps them apart
        branches = [self.dealt.filter("batch < 0").withColumn("team", F.lit(-1)), *(stretch.withColumn("team", F.lit(i)) for i in range(teams))]
        got = reduce(DataFrame.unionByName, branches).drop("cell_id").mapInArrow(run, "model int, state array<double>").toArrow()
        shared.destroy()
        at = active[got.column("model").to_numpy()]
        adam.params[at], adam.m[at], adam.v[at] = np.split(np.stack(got.column("state").to_numpy(zero_copy_only=False)), 3, axis=1)
        adam.t += len(numbers)

    def sums(self, models: list[Model], params: np.ndarray, table: DataFrame, warm: bool = False) -> np.ndarray:
        """For each model over the table's cells: summed training loss, judged loss, values that train and judge, and the gradient."""
        spark, plan, shape, nulls = self.table.sparkSession, self.plan, self.shape, self.nulls
        shared = spark.sparkContext.broadcast(params)  # at most GROUP_BYTES

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, total, net = shared.value, None, DepthModel(shape[0], plan, shape[1], shape[2])
            for whole in batches:
                for lo in range(0, whole.num_rows, CHUNK):
                    got = summed(net, models, state, Rows.of(whole.slice(lo, CHUNK)), shape[0], nulls, warm)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

        parts = table.mapInArrow(run, "model int, sums array<double>")
        whole = parts.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).toArrow()
        shared.destroy()
        order = np.argsort(whole.column("model").to_numpy())
        return np.stack(whole.column("sums").to_numpy(zero_copy_only=False))[order]

    def losses(self) -> DataFrame:
        """(slot, rerun, variant, fit, loss, n): training loss, loss on the judged cells, and how many values those have."""
        rows = [(m.slot, m.rerun, m.variant, float(f), float(j), int(self.counts[m.variant, 1])) for m, (f, j) in zip(self.models, self.found, strict=True)]
        return self.table.sparkSession.createDataFrame(rows, "slot int, rerun int, variant int, fit double, loss double, n long")

    def trajectory(self) -> DataFrame:
        """(epoch, slot, rerun, variant, loss): the training loss of every model by epoch, as far as it went."""
        named = [(e, m.slot, m.rerun, m.variant, x) for e, i, x in self.history for m in (self.models[i],)]
        return self.table.sparkSession.createDataFrame(named, "epoch int, slot int, rerun int, variant int, loss double")

    def chosen(self) -> list[int]:
        """The rerun of least training loss for each slot and variant."""
        first: dict[tuple[int, int], int] = {}
        for i, m in enumerate(self.models):
            k = (m.slot, m.variant)
            if k not in first or self.found[i, 0] < self.found[first[k], 0]:
                first[k] = i
        return list(first.values())

    def depths(self) -> DataFrame:
        """(slot, variant, cell_id, depth, used) of the chosen models; used where the cell trained the variant."""
        own = [self.models[i] for i in self.chosen()]
        shared = self.table.sparkSession.sparkContext.broadcast(self.best[self.chosen()])
        plan, shape = self.plan, self.shape

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = DepthModel(shape[0], plan, shape[1], shape[2])
            for batch in batches:
                xs, ys, fit = (nested(batch, c) for c in ("xs", "ys", "fit"))
                for k, m in enumerate(own):
                    net.load(shared.value[k])
                    z = net.encoder.forward(np.stack([xs[:, m.slot], ys[:, m.slot]], 1))[:, 0]
                    n = len(z)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m.slot] * n, pa.int32()), pa.array([m.variant] * n, pa.int32()), batch.column(batch.schema.names.index("cell_id")), pa.array(z), pa.array(fit[:, m.variant])],
                        names=["slot", "variant", "cell_id", "depth", "used"],
                    )

        return self.table.mapInArrow(run, "slot int, variant int, cell_id long, depth double, used boolean")

    def with_depth(self) -> DataFrame:
        """(z, a): each cell's depth in the true layout beside its measurements, for every variant."""
        at = [i for i in self.chosen() if self.models[i].slot == 0]
        shared = self.table.sparkSession.sparkContext.broadcast(self.best[at])
        plan, shape = self.plan, self.shape

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = DepthModel(shape[0], plan, shape[1], shape[2])
            for batch in batches:
                place = np.stack([nested(batch, c)[:, 0] for c in ("xs", "ys")], 1)
                for state in shared.value:
                    z = net.load(state).encoder.forward(place)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(batch.schema.names.index("a"))], names=["z", "a"])

        return self.table.select("xs", "ys", "a").mapInArrow(run, "z double, a array<double>")


def statistics(trainer: Trainer, metric: str = "mse") -> DataFrame:
    """(slot, variant, n, stat) of each slot's rerun of least training loss.

    metric: mse or nll_poisson_mse (the mean loss as it is) or nll_gaussian_mse.
    """
    best = trainer.losses().groupBy("slot", "variant", "n").agg(F.min_by("loss", F.struct("fit", "rerun")).alias("stat"))
    return best.withColumn("stat", nll_of_mse(F.col("stat"), F.col("n"))) if metric == "nll_gaussian_mse" else best


def fit_slots(slots: DataFrame, cells: DataFrame, expr: DataFrame, plan: Plan, reruns: int = 1, by_type: bool = False, covariate: DataFrame | None = None, masks: DataFrame | None = None) -> Trainer:
    """Models of layouts 0..n; with masks one for each variant of each layout."""
    return fit_table(cell_table(slots, cells, expr, plan, by_type, covariate, masks), plan, reruns)


def fit_table(table: DataFrame, plan: Plan, reruns: int = 1) -> Trainer:
    """Models of the layouts and variants of a cell_table; their numbers are read from it, so layouts are not drawn again."""
    n_slots, variants = table.agg(F.max(F.size("xs")), F.max(F.size("fit"))).first()
    return Trainer(table, plan, n_slots or 1, reruns, variants or 1)


def fit_nulls(cells: DataFrame, nulls: DataFrame, plan: Plan, reruns: int = 1) -> Trainer:
    """Models of one layout with the measurements of each slot."""
    return Trainer(null_table(cells, nulls), plan, nulls.agg(F.max("slot")).first()[0] + 1, reruns, nulls=True)


def test(trainer: Trainer, metric: str = "nll_gaussian_mse") -> DataFrame:
    return permutation_p(statistics(trainer, metric), [])


def fold_masks(folds: DataFrame) -> DataFrame:
    """One variant a fold: its cells judge, the others train."""
    k = folds.agg(F.max("fold")).first()[0] + 1
    every = folds.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.select("variant", "cell_id", (F.col("variant") != F.col("fold")).alias("fit"), (F.col("variant") == F.col("fold")).alias("judge"))


def by_folds(trainer: Trainer, metric: str) -> DataFrame:
    """(slot, stat): held-out statistics, weighted by the folds' sizes."""
    return statistics(trainer, metric).groupBy("slot").agg((F.sum(F.col("n") * F.col("stat")) / F.sum("n")).alias("stat"))


def draw_masks(draws: DataFrame, fractions: list[float], n_draws: int) -> DataFrame:
    """Variant 0 has all cells; then one variant for each fraction and draw, which trains and judges on its own cells."""
    spec = F.array_position(F.array(*(F.lit(float(f)) for f in fractions)), F.col("fraction")).cast("int")
    named = draws.select(((spec - 1) * n_draws + F.col("draw") + 1).cast("int").alias("variant"), "cell_id")
    whole = draws.select("cell_id").distinct().select(F.lit(0).alias("variant"), "cell_id")
    return whole.unionByName(named).select("variant", "cell_id", F.lit(True).alias("fit"), F.lit(True).alias("judge"))


def similarity(depths: DataFrame, keys: list[str], base: str, metric: str) -> DataFrame:
    """(keys, score): how alike depth and ``base`` are, both scaled to [0, 1] within the keys.

    metric: spearman_corr_mean or pearson_corr_mean, in absolute value, else the mean square difference.
    """
    from . import metrics as M
    if metric.startswith("spearman"):
        depths = M.rank_columns(depths.select(*keys, "depth", base), keys, ["depth", base])
    if "corr" in metric:
        return depths.groupBy(*keys).agg(F.abs(M.pearson("depth", base)).alias("score"))
    ends = depths.groupBy(*keys).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate(("depth", base)) for n, f in (("l", F.min), ("h", F.max))))
    d = M.minmax(F.col("depth"), F.col("_l0"), F.col("_h0")) - M.minmax(F.col(base), F.col("_l1"), F.col("_h1"))
    return depths.join(ends, keys).groupBy(*keys).agg(F.avg(d * d).alias("score"))
