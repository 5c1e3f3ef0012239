"""The grid of counts against numpy's two-dimensional histogram."""

import numpy as np
import pytest

from retail_insight.operators.histogram import grid


@pytest.mark.parametrize("bins", [1, 3, 20])
def test_grid_against_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    x, y = np.round(rng.normal(0, 9, 700), 1), rng.integers(0, 12, 700).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, None)]
    found = grid(spark.createDataFrame(rows, "x double, y double").repartition(4), "x", "y", bins).collect()
    counts, xs, ys = np.histogram2d(x, y, bins)
    assert sum(r.n for r in found) == 700
    assert {(r.x_bin, r.y_bin): r.n for r in found} == {(i, j): n for (i, j), n in np.ndenumerate(counts) if n}
    assert all(r.x_center == pytest.approx((xs[r.x_bin] + xs[r.x_bin + 1]) / 2) for r in found)


def test_one_value_and_no_rows(spark):
    one = spark.createDataFrame([(2.0, 5.0)] * 3, "x double, y double")
    (row,) = grid(one, "x", "y", 4).collect()
    assert tuple(row) == (2, 2, 2.125, 5.125, 3)
    assert grid(one.limit(0), "x", "y", 4).count() == 0
    with pytest.raises(ValueError, match="bins"):
        grid(one, "x", "y", 0)
