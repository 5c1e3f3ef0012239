"""K-means for many k at once: every pass over the rows moves the centres of all k.

Starting centres are drawn for all k together, by rounds in which rows far from
the centres so far are the likelier ones; the draws are by hash of the row, and
sums are kept as whole numbers, so neither depends on where rows lie. A k whose
centres rest leaves the passes; the passes end with the slowest k.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions for the executors carry their code along: no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rounds of drawing, rows drawn in a round for each of the largest k, passes at most, the
# shift below which a centre rests, and the steps of a unit in which sums are kept.
ROUNDS, DRAWN, PASSES, REST, STEP = 3, 2, 20, 1e-4, 2.0**32


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, from the differences themselves."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


@dataclass
class CentreModel:
    """The centres for one k; rows belong to the first of their nearest centres."""

    centres: list[list[float]]
    score: float | None = None

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as the models of Spark's library have it
        return [np.array(c) for c in self.centres]

    def nearest(self, x: Column) -> Column:
        """The number of the nearest centre of an array column."""
        far = [
            F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for c in self.centres
        ]
        distances = F.array(*far)
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")

    def transform(self, scaled: DataFrame) -> DataFrame:
        """Add ``prediction`` to rows with a ``features`` vector."""
        return scaled.withColumn("prediction", self.nearest(vector_to_array("features")))


class _Sweep:
    def __init__(self, scaled: DataFrame, seed: int):
        self.points = scaled.select(vector_to_array("features").alias("x"))
        self.seed, self.passes = seed, 0

    def summed(self, models: dict[int, np.ndarray], measure: Callable, width: int) -> dict[tuple[int, int], list[int]]:
        """Whole-number sums of ``measure(x, centres)`` for every k and cluster, in one pass.

        ``measure`` gives each row's cluster and its ``width`` whole numbers.
        Tasks add up their rows, the cluster adds up the tasks, and the driver
        receives one row for every k and cluster.
        """
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = {k: np.zeros((len(c), width + 1), np.int64) for k, c in models.items()}

            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1)
                for k, centres in models.items():
                    cluster, values = measure(k, x, centres)
                    for j in range(width):
                        np.add.at(totals[k][:, j + 1], cluster, values[:, j])
                    totals[k][:, 0] += np.bincount(cluster, minlength=len(centres))
            rows = [(k, c, *t) for k, found in totals.items() for c, t in enumerate(found.tolist()) if t[0]]
            columns = list(zip(*rows, strict=True)) or [()] * (width + 3)
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (width + 1)]
            names = ["k", "cluster", *[f"s{j}" for j in range(width + 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        sums = [f"s{j}" for j in range(width + 1)]
        told = self.points.mapInArrow(run, "k int, cluster int, " + ", ".join(f"{s} long" for s in sums))
        added = told.groupBy("k", "cluster").agg(*[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums])
        return {(r.k, r.cluster): [int(r[s]) for s in sums] for r in added.collect()}

    def drawn(self, centres: list[list[float]], rows: int, turn: int) -> list[list[float]]:
        """``rows`` rows, those far from the centres likelier, by a race of exponential clocks.

        A row's clock is the logarithm of its hash over its squared distance;
        the first ones ring. One pass, of which each task sends ``rows`` rows.
        """
        self.passes += 1
        so_far = np.array(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
                near = _distances(x, so_far).min(axis=1) if len(so_far) else np.ones(len(x))
                far = np.flatnonzero(near > 0)
                clock = -np.log(batch.column(1).to_numpy()[far]) / near[far]
                first = np.lexsort((*x[far].T[::-1], clock))[:rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(far[first])), pa.array(clock[first], pa.float64())], names=["x", "clock"]
                )

        # The last bits of a scaled value depend on the order in which the scaler met the rows.
        steady = F.transform("x", lambda v: F.round(v, 6))
        hashed = F.pmod(F.xxhash64(steady, F.lit(self.seed), F.lit(turn)), F.lit(1 << 52))
        chance = ((hashed + 0.5) / float(1 << 52)).alias("chance")
        rung = self.points.select("x", chance).mapInArrow(run, "x array<double>, clock double")
        return [list(r.x) for r in rung.orderBy("clock", "x").limit(rows).collect()]


def _spread(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Of a few weighted candidates, ``k`` starting centres far from each other (k-means++)."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < min(k, len(candidates)):
        far = weights * _distances(candidates, candidates[chosen]).min(axis=1)
        if far.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=far / far.sum())))
    return candidates[chosen]


def _own_cluster(k: int, x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, its values and its squared norm, in whole steps."""
    cluster = _distances(x, centres).argmin(axis=1)
    values = np.column_stack([x, (x * x).sum(axis=1)])
    return cluster, np.rint(values * STEP).astype(np.int64)


def sweep(scaled: DataFrame, ks: Sequence[int], seed: int) -> tuple[dict[int, CentreModel], int]:
    """Models with their silhouettes for all ``ks``, and how often the rows were read.

    ``scaled`` has a ``features`` vector of the same length in every row.
    Fewer distinct rows than k give fewer centres. ``score`` is the mean
    squared-distance silhouette, None where only one cluster has rows.
    """
    run = _Sweep(scaled, seed)
    drawn: list[list[float]] = run.drawn([], 1, 0)
    for turn in range(1, ROUNDS):
        drawn += run.drawn(drawn, DRAWN * max(ks), turn)
    if not drawn:
        raise ValueError("no rows to cluster")
    candidates = np.unique(np.array(drawn), axis=0)
    counted = run.summed({0: candidates}, _own_cluster, candidates.shape[1] + 1)
    weights = np.array([float(counted.get((0, c), [0])[0]) for c in range(len(candidates))])
    rng = np.random.default_rng(seed)
    centres = {k: _spread(candidates, weights, k, rng) for k in ks}

    size = candidates.shape[1]
    moving = dict(centres)
    for _ in range(PASSES):
        if not moving:
            break
        sums = run.summed(moving, _own_cluster, size + 1)
        for k, old in list(moving.items()):
            new = old.copy()
            for c in range(len(old)):
                if (found := sums.get((k, c))) is not None:
                    new[c] = [s / STEP / found[0] for s in found[1 : size + 1]]
            centres[k] = moving[k] = new
            if ((new - old) ** 2).sum(axis=1).max() <= REST**2:
                del moving[k]

    scores = silhouettes(run, centres)
    models = {k: CentreModel([[float(v) for v in row] for row in c], scores[k]) for k, c in centres.items()}
    return models, run.passes


def silhouettes(run: _Sweep, centres: dict[int, np.ndarray]) -> dict[int, float | None]:
    """The mean silhouette of every k: one pass for the clusters' sums, one for the rows against them.

    The squared distances from a row to all rows of a cluster add up to
    n |x|² - 2 x·sum + sum of squares, so no two rows are ever compared.
    """
    size = next(iter(centres.values())).shape[1]
    sums = run.summed(centres, _own_cluster, size + 1)
    used = {k: sorted(c for j, c in sums if j == k) for k in centres}
    told = {
        k: np.array([[sums[k, c][0], *[s / STEP for s in sums[k, c][1:]]] for c in used[k]]) for k in centres if len(used[k]) > 1
    }

    def value(k: int, x: np.ndarray, all_centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        clusters = told[k]
        n, total, squares = clusters[:, 0], clusters[:, 1 : size + 1], clusters[:, size + 1]
        place = np.full(len(all_centres), -1)
        place[used[k]] = np.arange(len(used[k]))
        cluster = _distances(x, all_centres).argmin(axis=1)
        own, rows = place[cluster], np.arange(len(x))
        reach = n * (x * x).sum(axis=1)[:, None] - 2 * x @ total.T + squares
        within = reach[rows, own] / np.maximum(n[own] - 1, 1)
        mean = reach / n
        mean[rows, own] = np.inf
        beyond = mean.min(axis=1)
        most = np.maximum(within, beyond)
        found = np.where((n[own] == 1) | (most <= 0), 0.0, (beyond - within) / np.where(most > 0, most, 1))
        return np.zeros(len(x), np.int64), np.rint(found * STEP).astype(np.int64)[:, None]

    scored = run.summed({k: centres[k] for k in told}, value, 1) if told else {}
    return {k: scored[k, 0][1] / STEP / scored[k, 0][0] if k in told else None for k in centres}
