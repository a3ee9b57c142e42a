"""What the third round of findings was about: rates of many projects, groups that do not vary, ties."""

import os
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from wattloom.catalog import ORACLES, QUERIES
from wattloom.operators import economics, frames
from wattloom.plans import features, models, training

SMALL = "/root/testdata/sf0.001"


def one_rate(flows, steps=100):
    """Bisection of one project, step by step."""
    worth = lambda r: sum(x / (1 + r) ** t for t, x in enumerate(flows))
    lo, hi, at_lo, mid = -0.99, 1.0, worth(-0.99), 0.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        v = worth(mid)
        if abs(v) < 1e-2:
            return mid
        if at_lo * v < 0:
            hi = mid
        else:
            lo, at_lo = mid, v
    return mid


def test_rates_of_a_batch_equal_those_of_one_project(spark):
    rng = np.random.default_rng(4)
    paths = [[-float(rng.uniform(1, 1e9)), *rng.uniform(-10, 1e6, rng.integers(1, 15)).tolist()] for _ in range(300)]
    paths += [[-1000.0, *[0.0] * 10], [-1000.0, *[1e7] * 10], [-5.0], [0.0, 5.0], []]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(9999, None)], "i int, f array<double>").select("i", economics.irr(F.col("f")).alias("r")).collect()
    got = {r.i: r.r for r in got}
    for i, p in enumerate(paths):
        assert got[i] == (pytest.approx(one_rate(p), abs=1e-9) if p and p[0] < 0 else None)
    assert got[9999] is None


@pytest.mark.parametrize("name", ["eco_irr", "eco_sensitivity", "eco_irr_heatmap", "eco_site_commercial"])
def test_rates_are_not_interpreted_row_by_row(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_the_first_of_two_level_features_is_taken():
    """Gains of multiples of one feature differ by rounding only."""
    a = np.array([[1.01, 1.0, 0.2], [1.0, 1.01, 0.2], [0.2, 0.2, 1.01]])
    for noise in (-1e-13, 0.0, 1e-13):
        chosen, _ = models.select_and_solve(a, np.array([0.5, 0.5 + noise, 0.1]), np.ones(3, dtype=bool), 3, 0.0)
        assert chosen[0] == 0
    assert models.select_and_solve(a, np.array([0.5, 0.51, 0.1]), np.ones(3, dtype=bool), 1, 0.0)[0] == [1]


def test_a_fit_keeps_its_digits_where_values_vary_little(spark):
    """A feature far from 0 that moves by thousandths, of which the second is a multiple; in any order of rows."""
    rng = np.random.default_rng(6)
    x, e = 1e4 + rng.uniform(0, 1e-2, 400), rng.normal(0, 1, 400)
    y = 5e4 + 3e3 * (x - x.mean()) + e
    z = (x - x.mean()) / x.std()
    slope = (z @ (y - y.mean()) / 400) / 1.01 / x.std()
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(400)
        df = spark.createDataFrame([("m", float(x[i]), float(2 * x[i]), float(y[i])) for i in order], "meter_id string, a double, b double, y double")
        for got in (models.fit_ridge(df, ["meter_id"], ["a", "b"], "y", keep_min=1, keep_share=0.0).first(), training.fit(df, ["meter_id"], ["a", "b"], "y", keep_min=1, keep_share=0.0).first()):
            assert got.features == ["a"] and got.coef[1] == pytest.approx(slope, rel=1e-9)
            assert got.coef[0] == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9)


def small_tables(spark, folder, **tables):
    """The smallest tables with some of them replaced."""
    for path in sorted(pathlib.Path(SMALL).glob("*.parquet")):
        if path.stem not in tables:
            os.symlink(path, folder / path.name)
    for name, df in tables.items():
        df.coalesce(1).toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def test_groups_that_do_not_vary_have_no_correlation(spark, tmp_path):
    """Two equal readings in an hour of the day, which is one fewer than a gain asks for."""
    events = spark.sql("""select id as event_id, timestampadd(HOUR, cast(id % 3 * 24 + id div 3 as int), timestamp_ntz'2024-01-01 00:00:00') as ts, 1L as user_id, 'view' as event_type,
        case when id < 6 and id % 3 < 2 then 5.0d else cast(id * id as double) end as value, '{"k": 1}' as props from range(36) where id % 3 < 2 or id > 12""")
    folder = small_tables(spark, tmp_path, events=events)
    got = QUERIES["top_feature_select"](spark, folder).toPandas()
    assert len(got) == 8 and compare(got, duck(folder).execute(ORACLES["top_feature_select"]).df()) == ""


def test_a_price_that_equals_the_mean_is_not_above_it(spark, tmp_path):
    """Prices of a month whose sum in doubles depends on the order of the rows."""
    prices = [2.1, 2.2, 2.3, 2.4, 2.5, 2.6, 2.7, 6.8, 7.4, 2.9, 3.39]
    prices += [round(sum(prices) / len(prices), 2)]
    for order in range(8):
        rows = [(1, int(h), float(prices[h])) for h in np.random.default_rng(order).permutation(len(prices))]
        df = spark.createDataFrame(rows, "month int, hour int, price double").coalesce(1)
        got = {r.hour: r.up for r in df.select("hour", features.above_mean("price", ["month"]).alias("up")).collect()}
        assert got == {h: int(round(p * 100) * len(prices) > sum(round(p * 100) for p in prices)) for h, p in enumerate(prices)}
    assert got[len(prices) - 1] == 0


def test_price_above_mean_on_a_month_with_a_tie(spark):
    """At 0.1 the price of hour 15 of February is the mean of its month."""
    folder = "/root/testdata/sf0.1"
    got = QUERIES["win_price_above_mean"](spark, folder).toPandas()
    assert got.set_index(["month", "hour"]).loc[(2, 15)].tolist() == [6.18, 0]
    assert compare(got, duck(folder).execute(ORACLES["win_price_above_mean"]).df()) == ""


def test_rolling_moments_are_one_window(series):
    """All widths in one pass, so that wide rows are not copied once per step."""
    names = {6: ("m6", "s6"), 336: ("m336", None), 1440: ("m1440", "s1440")}
    df = frames.with_rolling_moments(series([1.0, 2.0, 4.0]), ["meter_id"], "v", list(names), names, min_periods={1440: 2})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    rows = df.orderBy("i").collect()
    assert [r.m6 for r in rows] == [None, 1.0, 1.5] and [r.s1440 for r in rows] == [None, None, pytest.approx(0.5**0.5)]
