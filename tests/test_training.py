"""Model store, feature screen and backtests from running sums."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.plans import backtests, models, training

KEY = ["meter_id"]
NAMES = ["a", "b", "c", "d", "e", "f"]


def ridge_residual(a, r, chosen):
    """What the ridge fit on the chosen features leaves of a standardised target, up to a constant."""
    s = list(chosen)
    return -r[s] @ np.linalg.solve(a[np.ix_(s, s)], r[s])


def test_forward_selection_takes_the_best_next_feature():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        x = rnd.normal(size=(200, 6)) @ rnd.normal(size=(6, 6))
        y = x @ rnd.normal(size=6) * rnd.integers(0, 2) + rnd.normal(size=200)
        z = (x - x.mean(0)) / x.std(0)
        a, r = z.T @ z / 200 + 0.01 * np.eye(6), z.T @ (y - y.mean()) / 200
        chosen, beta = models.select_and_solve(a, r, np.ones(6, dtype=bool), 4, 0.0)
        want = []
        for _ in range(4):
            want.append(min((j for j in range(6) if j not in want), key=lambda j: ridge_residual(a, r, [*want, j])))
        assert chosen == want
        assert np.allclose(beta[chosen], np.linalg.solve(a[np.ix_(chosen, chosen)], r[chosen])) and np.count_nonzero(beta) == 4


def test_screen_leaves_out_constant_and_useless_features(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        x = [rnd.random() for _ in range(4)]
        rows.append(("m", i, *x, 7.0, 2 * x[0] + 1, 5 + 3 * x[0] - 2 * x[2]))
    df = spark.createDataFrame(rows, f"meter_id string, ts int, {', '.join(n + ' double' for n in NAMES)}, y double")
    one = models.fit_ridge(df, KEY, NAMES, "y", ridge=0.0, keep_min=6).first()
    assert set(one["features"]) in ({"a", "c"}, {"f", "c"})  # f is twice a and one; nothing else adds anything
    b, a, _, c, _, _, f = one["coef"]
    assert np.allclose([b + f, a + 2 * f, c], [5, 3, -2])


def fleet(spark, n=400):
    """Three meters: linear, mostly still (log scale), too short."""
    rnd, rows = random.Random(6), []
    for i in range(n):
        x = rnd.random()
        rows.append(("line", i, x, 10 + 4 * x + rnd.gauss(0, 0.1)))
        rows.append(("still", i, x, max(0.0, float(np.expm1(2 * x - 1)))))
        if i < 8:
            rows.append(("short", i, x, 1.0))
    df = spark.createDataFrame(rows, "meter_id string, i int, x double, demand_kwh double")
    return df.selectExpr("meter_id", "timestamp_seconds(1704067200 + i * 3600) as ts", "x", "demand_kwh")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / "models")
    df = fleet(spark)
    for version, cutoff in ((1, "2024-01-10 00:00:00"), (2, "2024-01-14 00:00:00")):
        training.save(training.train(df, KEY, ["x"], "demand_kwh", cutoff, keep_min=1), folder, version)
    return folder, df


def test_store_keeps_versions_scales_and_failures(spark, stored):
    folder, df = stored
    rows = {(r.meter_id, r.version): r for r in training.manifest(spark, folder).collect()}
    assert len(rows) == 6 and rows["short", 2].error == "train too short (6)" and rows["line", 1].error is None
    assert rows["still", 2].zero_pct > 30 and str(rows["line", 1].train_cutoff).startswith("2024-01-10") and rows["line", 2].holdout_mape < 2
    assert set(rows["line", 2].historical_block_mape) == {"night", "morning", "solar", "peak"}
    use = {r.meter_id: r for r in training.load(spark, folder, KEY).collect()}
    assert set(use) == {"line", "still"} and {r.version for r in use.values()} == {2} and use["still"].use_log and not use["line"].use_log
    assert {r.version for r in training.load(spark, folder, KEY, version=1).collect()} == {1}
    with pytest.raises(ValueError, match="already"):
        training.save(spark.range(1), folder, 2)
    with pytest.raises(ValueError, match="already"):
        training.save(spark.range(1), folder, 1)


def test_newest_usable_version_of_each_meter_is_loaded(spark, stored, tmp_path):
    _, df = stored
    folder = str(tmp_path / "models")
    training.save(training.train(df, KEY, ["x"], "demand_kwh", "2024-01-14 00:00:00", keep_min=1), folder, 1)
    late = df.filter("meter_id = 'still' or ts < '2024-01-01 10:00:00'")  # the line is too short now
    training.save(training.train(late, KEY, ["x"], "demand_kwh", "2024-01-15 00:00:00", keep_min=1), folder, 2)
    assert {(r.meter_id, r.version) for r in training.load(spark, folder, KEY).collect()} == {("line", 1), ("still", 2)}


def test_scoring_does_not_fit(spark, stored):
    folder, df = stored
    out = training.predict(df, training.load(spark, folder, KEY), KEY, ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Python" not in plan and "Window" not in plan
    rows = out.filter("ts > '2024-01-15 00:00:00'").collect()
    line = [r for r in rows if r.meter_id == "line"]
    still = [r for r in rows if r.meter_id == "still"]
    assert all(abs(r.predicted_kwh - 10 - 4 * r.x) < 0.3 and r.q10_kwh <= r.predicted_kwh <= r.q90_kwh for r in line)
    assert np.mean([abs(r.predicted_kwh - r.demand_kwh) for r in still]) < 0.3 and min(r.predicted_kwh for r in still) >= 0
    assert all(r.predicted_kwh is None and r.q10_kwh is None for r in out.filter("meter_id = 'short'").collect())


def test_pipelines_are_stored(spark, stored, tmp_path):
    _, df = stored
    fitted = models.fit_trees(df, ["x"], "demand_kwh", rounds=2, depth=2)
    again = training.load_pipeline(training.save_pipeline(fitted, str(tmp_path / "s"), "pooled", 3))
    a, b = (p.transform(models.with_missing(df, ["x"])).agg(F.sum("tree_kwh")).first()[0] for p in (fitted, again))
    assert a == b


def test_running_sums_equal_fits_on_the_rows_of_each_fold(spark):
    df = backtests.by_day(fleet(spark).filter("meter_id = 'line'"), KEY)
    sums = backtests.block_sums(df, KEY, ["block"], ["x"], "demand_kwh")
    assert sums.count() == 17
    for width in (None, 4):
        grams = backtests.expanding_folds(sums, KEY, ["x"], 5, 3, 2, width)
        got = {r.fold: r for r in models.solve_sums(grams, [*KEY, "fold"], ["x"]).collect()}
        assert sorted(got) == [0, 1, 2, 3]
        for fold, r in got.items():
            end = 5 + 3 * fold
            rows = df.filter((F.col("block") < end) & (F.col("block") >= (0 if width is None else end - width)))
            one = models.fit_ridge(rows, KEY, ["x"], "demand_kwh").first()
            assert np.allclose(one["coef"], r["coef"]) and one["n_train"] == r["n_train"]


def test_test_rows_go_into_the_folds_that_test_them(spark):
    for initial, step, horizon, blocks in itertools.product((3, 5), (1, 2, 4), (1, 3, 5), (4, 9, 14)):
        got = spark.range(blocks).select("id", backtests.test_folds(F.col("id"), F.lit(blocks), initial, step, horizon).alias("f")).collect()
        folds = [f for f in range(blocks) if initial + f * step + horizon <= blocks]
        for r in got:
            assert r.f == [f for f in folds if initial + f * step <= r.id < initial + f * step + horizon]
