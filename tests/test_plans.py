"""Features, quantiles, forecasts, models, dispatch and economics against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.functions import labels, money, text
from wattloom.operators import accuracy, dispatch, economics, history, network
from wattloom.operators.frames import with_rolling_moments
from wattloom.operators.quantiles import exact_quantiles
from wattloom.plans import features, forecasts, models, splits
from wattloom.sources import readers

KEY = ["meter_id"]


@pytest.mark.parametrize("narrow_rows", [0, 10_000])
def test_bracketed_quantiles_equal_percentile_on_heavy_tails(spark, narrow_rows):
    """Values over three magnitudes and more; without the rule for narrow groups, groups need enough rows."""
    rnd = random.Random(8)
    rows = [("tail", rnd.uniform(0, 100)) for _ in range(15000)] + [("tail", 8e4), ("tail", 9e7), ("tail", -1e6)] + [("log", rnd.lognormvariate(0, 4)) for _ in range(12000)] + [("tie", float(k // 4000)) for k in range(12000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs, narrow_rows=narrow_rows).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("q")).collect():
        assert got[r.g] == pytest.approx(tuple(r.q), rel=1e-12)


def test_quantiles_equal_percentile_on_skewed_groups(spark):
    rnd = random.Random(7)
    rows = [("hot", round(rnd.lognormvariate(0, 3), 3)) for _ in range(3000)] + [("hot", 5.0)] * 700 + [("cold", 1.0)] + [("pair", 1.0), ("pair", 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.95}
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("q")).collect()
    assert len(got) == 4
    for r in want:
        assert got[r.g] == pytest.approx(tuple(r.q), rel=1e-12)


def test_rolling_moments_after_a_level_shift(series):
    """A step from 1e6 to 5 leaves no trace in windows behind it."""
    rnd = random.Random(5)
    values = [1e6 + rnd.uniform(0, 10) for _ in range(150)] + [5 + rnd.uniform(0, 0.02) for _ in range(250)]
    got = with_rolling_moments(series(values), KEY, "v", [48, 100], {48: ("m", "s"), 100: (None, "t")}, include_current=True).orderBy("i").toPandas()
    tail = pd.Series(values[150:])
    np.testing.assert_allclose(got["s"][200:], tail.rolling(48).std()[50:], rtol=1e-9)
    np.testing.assert_allclose(got["t"][260:], tail.rolling(100).std()[110:], rtol=1e-9)
    np.testing.assert_allclose(got["m"][200:], tail.rolling(48).mean()[50:], rtol=1e-12)


def test_rolling_moments_equal_pandas(series):
    rnd = random.Random(3)
    values = [None if rnd.random() < 0.1 else rnd.uniform(0, 1e4) for _ in range(300)]
    df = with_rolling_moments(series(values), KEY, "v", [5, 48], {5: ("m5", "s5"), 48: ("m48", "s48")}, min_periods={48: 10})
    got = df.orderBy("i").toPandas()
    past = pd.Series(values, dtype=float).shift(1)
    for n, k in ((5, 1), (48, 10)):
        np.testing.assert_allclose(got[f"m{n}"].astype(float), past.rolling(n, min_periods=k).mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"s{n}"].astype(float), past.rolling(n, min_periods=k).std(), rtol=1e-7)


def test_the_tables_reach_the_longest_windows(spark):
    """The registered queries see rows in which long lags exist and the 14- and 30-day means differ."""
    from wattloom.catalog import QUERIES

    folder = "/root/testdata/sf0.01"
    assert QUERIES["win_momentum"](spark, folder).filter("rmean_14d <> rmean_30d").count() > 20
    assert QUERIES["pipe_features_hourly"](spark, folder).filter("demand_kwh_lag_24h is not null and temp_rmean_24h is not null").count() > 1000
    assert {r.location_id for r in QUERIES["fn_price_premium"](spark, folder).select("location_id").distinct().collect()} == {"L0", "L1"}


def test_momentum_leaks_only_on_request(series):
    df = series([1, 4, 9, 16, 25, 36, 49])
    safe = features.add_momentum(df, KEY, "v").orderBy("i").collect()
    leaky = features.add_momentum(df, KEY, "v", leaky=True).orderBy("i").collect()
    assert safe[3].demand_diff_1 == 5.0 and leaky[3].demand_diff_1 == 7.0


def test_history_equals_pandas_on_long_meters_with_gaps(spark):
    """Several groups of blocks, missing values in runs and at both ends, a short meter, one without values, other columns."""
    rnd = np.random.default_rng(3)
    long = [None if i < 5 or i % 97 < 6 or i > 6490 or 3000 < i < 3200 else float(rnd.integers(0, 500)) for i in range(6500)]
    meters = {"long": long, "short": [3.0, None, 4.0], "none": [None] * 100, None: [1.0, 2.0, 9.0]}
    rows = [(m, i, v, f"x{i}") for m, values in meters.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "meter_id string, i int, v double, note string").selectExpr("note", "meter_id", "timestamp_seconds(1704067200 + i * 1800) as ts", "v", "i")
    out = history.add_history(df, KEY, "v", [6, 48, 336], [6, 48])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
    got = out.toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["note", "meter_id", "ts", "v", "i", "rmedian_6", "rmedian_48", "rmedian_336", "ema_6", "ema_48"]
    for m, values in meters.items():
        mine = got[got["meter_id"].isna() if m is None else got["meter_id"] == m].sort_values("i")
        past = pd.Series(values, dtype=float).shift(1)
        for n in (6, 48, 336):
            np.testing.assert_allclose(mine[f"rmedian_{n}"], past.rolling(n, min_periods=1).median())
        for s in (6, 48):
            np.testing.assert_allclose(mine[f"ema_{s}"], past.ewm(span=s, adjust=False, min_periods=1).mean(), rtol=1e-12)


def test_no_task_of_the_history_holds_a_meter(spark):
    """One meter of 30 000 rows: its rows are dealt by time chunk, by block and by group of blocks."""
    df = spark.range(30000).selectExpr("'m' as meter_id", "timestamp_seconds(id * 1800) as ts", "double(id % 11) as v")
    rows = history.number_rows(df, KEY)
    assert rows.selectExpr("count(distinct _rn) as n", "max(_rn) as m").first().asDict() == {"n": 30000, "m": 29999}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = history.add_history(df, KEY, "v", [336], [6]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(out) >= 4 and max(r["count"] for r in out) < 15000


def test_row_median_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, 9.0), (1.0, None, 9.0), (None, None, 4.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(forecasts.row_median([F.col(c) for c in "abc"])).collect()] == [5.0, 5.0, 4.0, None]


def test_seasonal_anchor_repeats_a_weekly_pattern(series):
    values = [float(i % 168) for i in range(5 * 168)]
    df = series(values, step="1 hour", name="demand_kwh")
    out = forecasts.seasonal_anchor(df, forecasts.horizon_after(df, KEY, "1 hour", "7 days"), KEY).orderBy("ts").collect()
    assert [r.mean_kwh for r in out] == values[:168] and all(r.q10_kwh <= r.mean_kwh <= r.q90_kwh for r in out)


def test_block_accuracy_drops_zero_load_and_keeps_energy(spark):
    rows = [("m", i, 2.0, 1.0) for i in range(4)] + [("m", 4, 3.0, 0.0), ("m", 5, 1.0, 0.0001)]
    df = spark.createDataFrame(rows, "meter_id string, i int, predicted_kwh double, actual_kwh double").selectExpr("meter_id", "timestamp_seconds(1704067200 + i * 1800) as ts", "predicted_kwh", "actual_kwh")
    out = accuracy.block_accuracy(df, df, list(accuracy.BLOCK_ID)).collect()
    by = {c: [r for r in out if r.cadence == c] for c in accuracy.BLOCK_ID}
    assert {c: len(v) for c, v in by.items()} == {"dam_15min": 8, "native_30min": 4, "hourly": 2, "tod_4h": 1}
    assert all(r.ape == pytest.approx(100.0) for c in ("dam_15min", "native_30min", "hourly") for r in by[c])
    assert by["tod_4h"][0].predicted_kwh == pytest.approx(12.0) and sorted(r.block_id for r in by["dam_15min"]) == list(range(8))


def test_point_metrics_literal(spark):
    df = spark.createDataFrame([("m", 10.0, 11.0), ("m", 20.0, 18.0), ("m", 0.0, 1.0)], "meter_id string, y double, p double")
    r = accuracy.point_metrics(df, KEY, "y", "p").collect()[0]
    assert r.mape == pytest.approx(10.0) and r.mae == pytest.approx(4 / 3) and r.n_nonzero == 2 and r.within10 == pytest.approx(100.0)
    assert r.r2 == pytest.approx(1 - 6 / 200) and r.wape == pytest.approx(400 / 30)


def test_splits_partition_rows(series):
    df = series(range(24 * 12), step="1 hour")
    for out in (splits.by_span(df, KEY), splits.by_rows(df, KEY), splits.every_nth_day(df, KEY, 4, 0, 24), splits.last_days(df, KEY, 3)):
        counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert sum(counts.values()) == 288 and counts["test"] == 72
    folds = splits.rolling_origin(df, KEY, 5, 3, 2).groupBy("fold", "split").count().collect()
    assert {(r.fold, r["split"]): r["count"] for r in folds} == {(0, "train"): 120, (0, "test"): 48, (1, "train"): 192, (1, "test"): 48}


def test_ridge_recovers_a_line_and_isolates_failures(spark):
    rows = [(k, float(x), float((x * 7) % 5), 3.0 + 2.0 * x) for k in ("a", "b") for x in range(60)] + [("short", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "meter_id string, x double, z double, y double")
    fit = models.fit_ridge(df, KEY, ["x", "z"], "y", ridge=1e-9, keep_min=1, keep_share=0.5)
    got = {r.meter_id: r for r in fit.collect()}
    assert got["short"].coef is None and "too short" in got["short"].error
    assert got["a"].features == ["x"] and got["a"].coef == pytest.approx([3.0, 2.0, 0.0], abs=1e-5)
    out = models.score(df, fit, KEY, ["x", "z"]).collect()
    assert all((r.predicted_kwh is None) if r.meter_id == "short" else abs(r.predicted_kwh - r.y) < 1e-4 for r in out)


def test_recursive_forecast_equals_a_plain_loop(spark, series):
    values = [20 + 5 * math.sin(i / 24 * 2 * math.pi) + (i % 5) for i in range(200)]
    df = series(values, step="1 hour", name="demand_kwh")
    coef = [1.0, 0.3, 0.2, 0.1, 0.3, 0.5, -0.4, 0.7]
    m = spark.createDataFrame([("m", coef)], "meter_id string, coef array<double>")
    got = [r.predicted_kwh for r in models.recursive_forecast(df, m, KEY, steps=60).orderBy("step").collect()]
    path = list(values)
    for s in range(60):
        n = len(path)
        hour, dow = n % 24, (1 + n // 24) % 7
        x = [1.0, path[-1], path[-24], path[-168], sum(path[-24:]) / 24, math.sin(hour * 2 * math.pi / 24), math.cos(hour * 2 * math.pi / 24), float(dow >= 5)]
        path.append(max(sum(a * b for a, b in zip(coef, x)), 0.0))
    assert got == pytest.approx(path[200:], rel=1e-9)


def test_missing_features_and_schema_choice(spark):
    df = spark.createDataFrame([("m", 1.0, None)], "meter_id string, a double, b double")
    row = models.with_missing(df, ["a", "b", "c"]).collect()[0]
    assert (row.a, row.b, row.c) == (1.0, 0.0, 0.0)
    assert models.numeric_features(df) == ["a", "b"]


def day(strategy, cap, kw):
    rnd = np.random.default_rng(5)
    d, s, x = rnd.uniform(20, 200, (40, 24)), rnd.uniform(0, 150, (40, 24)), rnd.uniform(3, 12, (40, 24))
    return d, s, dispatch.run_days(d, s, x, np.full(40, cap), np.full(40, kw), np.array([strategy] * 40), 6.5)


@pytest.mark.parametrize("strategy", ["solar_surplus", "full_solar", "cheap_grid"])
def test_dispatch_invariants(strategy):
    d, s, r = day(strategy, 400.0, 100.0)
    assert (r["soc"] <= 0.9 * 400 + 100 + 1e-9).all() and (r["soc"] >= 0.1 * 400 - 1e-9).all()
    served = r["solar_direct"] + r["discharge"] + r["grid"] + r["iex"]
    assert (served >= d - 1e-6).all() and (r["solar_direct"] <= s + 1e-9).all() and (r["charge"] <= 100 + 1e-9).all()
    assert ((r["discharge"] > 0).sum(axis=1) <= 4).all()


def test_no_battery_only_buys():
    d, s, r = day("cheap_grid", 0.0, 0.0)
    assert not r["charge"].any() and not r["discharge"].any() and np.allclose(r["solar_direct"] + r["grid"] + r["iex"], d)


def test_irr_and_payback(spark):
    df = spark.createDataFrame([(1000.0, 250.0), (1000.0, 10.0), (0.0, 5.0)], "c double, a double")
    rows = economics.project_irr(df, "c", "a", 10, escalation_pct=0.0, degradation_pct=0.0).orderBy(F.desc("a")).collect()
    assert rows[0].irr_pct == pytest.approx(21.41, abs=0.01) and rows[0].payback_years == 4.0
    assert rows[0].npv_inr == pytest.approx(sum(250 / 1.1**y for y in range(1, 11)) - 1000)
    assert rows[1].payback_years is None and rows[2].irr_pct is None


def test_quote_limits_and_bad_input(spark):
    df = spark.createDataFrame([(2.0, 10.0), (20.0, 10.0), (45.0, 10.0)], "m double, kw double")
    rows = money.add_firm_quote(df, "m", "kw").orderBy("m").collect()
    assert [r.firmness_pct for r in rows] == [95.0, 80.0, 70.0] and [round(r.offered_price, 2) for r in rows] == [6.9, 8.1, 8.9]
    assert "too high" in rows[2].rationale and "80% firm" in rows[1].rationale
    with pytest.raises(Exception):
        money.add_firm_quote(spark.createDataFrame([(2.0, 0.0)], "m double, kw double"), "m", "kw").collect()


def test_audit_sentences_match_their_pattern(spark):
    rows = [(a, k, p, m) for a in ("charge", "discharge", "hold", "curtail_solar", "peak_shave") for k in (0.0, 12.0, 120.5) for p in (2.8, 9.9) for m in (9.0, 40.0)]
    df = spark.createDataFrame(rows, "action string, kwh double, iex double, mape double").withColumn("ts", F.lit("2026-04-17 02:00:00").cast("timestamp"))
    c = F.col
    out = df.withColumn("s", text.audit_sentence(c("ts"), c("action"), c("kwh"), c("iex"), F.lit(6.9), c("mape"), F.lit(12.0))).withColumn("ok", text.is_audit_sentence(c("s"))).collect()
    assert all(r.ok for r in out)
    first = next(r.s for r in out if r.action == "charge" and r.kwh == 120.5 and r.iex == 2.8 and r.mape == 9.0)
    assert first == "[02:00] charge 120.5 kWh because IEX price ₹2.80/kWh is ₹4.10 below landed grid tariff (confidence 91%)."


def test_labels_and_scenarios(spark):
    df = spark.createDataFrame([(4.0,), (5.0,), (25.0,), (float("nan"),)], "m double")
    assert [r[0] for r in df.select(labels.cohort_band(F.col("m"))).collect()] == ["A': 4-5%", "B: 5-10%", "E: >=25%", "X: invalid"]
    assert [r[0] for r in df.limit(3).select(labels.cohort(F.col("m"))).collect()] == ["A", "B", "D"]
    assert labels.resolve_scenario("P90") == "optimistic"
    with pytest.raises(ValueError):
        labels.resolve_scenario("p42")


def test_clean_forecast_handles_bad_numbers(spark):
    df = spark.createDataFrame([(float("nan"), -1.0, float("inf")), (5.0, 6.0, 4.0)], "p double, lo double, hi double")
    assert [tuple(r) for r in labels.clean_forecast(df, "p", "lo", "hi").collect()] == [(0.0, 0.0, 0.0), (5.0, 5.0, 5.0)]


def test_readers_parse_text(spark):
    df = spark.createDataFrame([("1,234.5", "n/a", "12", None)], "a string, b string, c string, d string")
    r = df.select(readers.number("a"), readers.number("b"), readers.row_mean([readers.number(x) for x in "bcd"])).collect()[0]
    assert tuple(r) == (1234.5, None, 12.0)


def test_missing_quality_table_is_empty(spark):
    tables = readers.quality_tables(spark, {})
    assert len(tables) == 5 and all(t.count() == 0 for t in tables.values())


def test_neighborhood_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "src string, dst string")
    assert {r.node_id: r.hops for r in network.neighborhood(e, "a", 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
