"""Kernel density from moments of bins against the direct sum; plans without unkeyed windows and nested loops."""

import numpy as np
import pytest

from strandline import queries
from strandline.operators import stats


def direct(x, points=64):
    q1, q3 = np.quantile(x, [0.25, 0.75])
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    spread = min(sd, (q3 - q1) / 1.34) if q3 > q1 else sd
    h = max(0.9 * spread * len(x) ** -0.2, 1e-9)
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    return grid, np.array([np.exp(-0.5 * ((g - x) / h) ** 2).sum() for g in grid]) / (len(x) * h * np.sqrt(2 * np.pi)), h


def test_moments_give_the_direct_sum(spark):
    r = np.random.default_rng(3)
    groups = {"plain": r.normal(5, 2, 700), "two": np.r_[r.normal(0, 1, 300), r.normal(50, 3, 200)], "far": np.r_[r.normal(0, 1, 400), 1e4], "ties": np.round(r.normal(0, 2, 300)), "flat": np.full(9, 2.5), "one": np.array([3.0]), "skew": r.exponential(3, 500) ** 2}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("plain", None), ("plain", float("nan"))], "g string, v double").repartition(5)
    got = {}
    for row in stats.kernel_density(df, "g", "v").collect():
        got.setdefault(row.g, {})[row.k] = row
    assert set(got) == set(groups)
    for k, x in groups.items():
        grid, want, h = direct(x)
        assert sorted(got[k]) == list(range(64))
        assert [got[k][p].x for p in range(64)] == pytest.approx(grid.tolist())
        # in shares of the peak of one value, as bandwidths differ by orders of magnitude
        assert np.abs(np.array([got[k][p].density for p in range(64)]) - want).max() < 1e-6 / (h * np.sqrt(2 * np.pi))


def test_values_do_not_meet_the_grid(spark):
    df = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(4).normal(0, 1, 20_000)], "g string, v double")
    stats.kernel_density(df, "g", "v").collect()
    plan = stats.kernel_density(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    grid = plan.split("Generate explode(sequence(cast(greatest")
    assert len(grid) == 2 and "sum(" in grid[1].split("Relation")[0]  # values are summed to bins below the generator


def test_binned_mixtures_keep_their_place_beside_outliers(spark):
    r = np.random.default_rng(5)
    x = np.r_[r.normal(0, 1, 3000), r.normal(6, 1, 3000), 300.0]
    got = stats.mixtures(spark.createDataFrame([("a", float(v)) for v in x], "g string, v double"), "g", "v").first()
    want = stats.choose(x)
    assert got.components == want["components"] and got.means == pytest.approx(want["means"], abs=1e-4)


@pytest.mark.parametrize("name", ["overlay", "delta_fields", "delta_of_delta", "rmsip"])
def test_no_unkeyed_window_and_no_nested_loop(spark, name):
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    df = queries.QUERIES[name](spark, path)
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
    if name == "rmsip":
        assert "BroadcastNestedLoopJoin" not in plan
