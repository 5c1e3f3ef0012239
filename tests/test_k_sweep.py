"""K-means for many k in the same passes, against Spark's own model and evaluator and a brute-force fit."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from retail_insight.operators import k_sweep
from retail_insight.operators.k_sweep import PASSES, ROUNDS, sweep


def points(rows, spread=0.2, groups=4):
    rng = np.random.default_rng(5)
    centres = rng.uniform(-4, 4, (groups, 3))
    return centres[rng.integers(0, groups, rows)] + rng.normal(0, spread, (rows, 3))


def frame(spark, x, parts=3):
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(parts)
    return rows.select(array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def scaled(spark):
    return frame(spark, points(900)).persist()


def test_scores_are_the_evaluators(spark, scaled):
    models, _ = sweep(scaled, [2, 3, 4, 6], seed=42)
    for model in models.values():
        assert model.score == pytest.approx(ClusteringEvaluator(featuresCol="features").evaluate(model.transform(scaled)), abs=1e-6)
    assert max(models, key=lambda k: models[k].score) == 4


def test_fits_are_as_good_as_sparks(spark, scaled):
    models, _ = sweep(scaled, [2, 3, 4, 5], seed=42)
    x = np.array([r.features.toArray() for r in scaled.collect()])
    cost = lambda c: k_sweep._distances(x, np.array(c)).min(axis=1).sum()
    for k, model in models.items():
        theirs = KMeans(featuresCol="features", k=k, seed=42).fit(scaled).clusterCenters()
        assert cost(model.centres) <= 1.1 * cost(theirs)


def test_centres_rest_where_a_fit_in_memory_rests(spark, scaled):
    models, _ = sweep(scaled, [4], seed=42)
    x = np.array([r.features.toArray() for r in scaled.collect()])
    centres = np.array(models[4].centres)
    near = k_sweep._distances(x, centres).argmin(axis=1)
    assert np.allclose(centres, [x[near == c].mean(axis=0) for c in range(4)], atol=1e-3)


def test_one_pass_moves_all_k(spark, scaled):
    alone = {k: sweep(scaled, [k], seed=42)[1] for k in (2, 8)}
    _, together = sweep(scaled, list(range(2, 9)), seed=42)
    around = ROUNDS + 1 + 2  # draws, weights and the two passes of the scores
    assert together <= around + PASSES < 7 * min(alone.values())


def test_layout_does_not_matter(spark):
    x = points(400, spread=1.5)
    found = [sweep(frame(spark, x[order], parts), [2, 3, 5], seed=7)[0] for order, parts in ((np.arange(400), 1), (np.arange(400)[::-1], 7))]
    assert all(found[0][k].centres == found[1][k].centres and found[0][k].score == found[1][k].score for k in (2, 3, 5))


def test_few_distinct_rows(spark):
    x = np.array([[0.0, 0, 0]] * 20 + [[1.0, 1, 1]] * 10)
    models, _ = sweep(frame(spark, x), [2, 5], seed=1)
    assert [len(models[k].centres) for k in (2, 5)] == [2, 2] and models[5].score == pytest.approx(1.0)
    models, _ = sweep(frame(spark, x[:20]), [2], seed=1)
    assert len(models[2].centres) == 1 and models[2].score is None
    with pytest.raises(ValueError, match="no rows"):
        sweep(frame(spark, x[:1]).where(F.lit(False)), [2], seed=1)
