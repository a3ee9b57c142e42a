"""Detectors, repair and packet rules on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from wattloom.operators import ami, detectors, events, grids, joins
from wattloom.operators.frames import MICROS
from wattloom.operators.impute import impute
from wattloom.plans.quality import clean_meters, quality_report

KEY = ["meter_id"]


def flags(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def test_frozen_needs_four_equal_values_and_flags_the_last_three(series):
    got = flags(detectors.frozen(series([5, 5, 5, 1, 2, 2, 2, 2, None, 2]), KEY, "v"), "is_frozen")
    assert got == [False] * 5 + [True] * 3 + [False] * 2


def test_zscore_uses_population_deviation(series):
    values = [10.0] * 20 + [100.0]
    assert flags(detectors.global_z(series(values), KEY, "v"), "is_zscore_outlier") == [False] * 20 + [True]
    assert not any(flags(detectors.global_z(series([1, 50]), KEY, "v"), "is_zscore_outlier"))


def test_iqr_ignores_nulls_and_short_series(series):
    assert flags(detectors.iqr(series([1, 2, 3, 4, 100, None]), KEY, "v"), "is_iqr_outlier") == [False] * 4 + [True, False]
    assert not any(flags(detectors.iqr(series([1, 2, 900]), KEY, "v"), "is_iqr_outlier"))


@pytest.mark.parametrize("fn", [detectors.global_z, detectors.iqr, detectors.contextual, detectors.rolling])
def test_non_positive_threshold_raises(series, fn):
    with pytest.raises(ValueError):
        fn(series([1, 2, 3]), KEY, "v", **({"factor": 0} if fn is detectors.iqr else {"threshold": 0}))


def test_rolling_spike_is_flagged_and_clean_data_is_not(series):
    wave = [500 + 200 * math.sin(i / 96 * 2 * math.pi) for i in range(192)]
    assert not any(flags(detectors.rolling(series(wave), KEY, "v"), "is_rolling_outlier"))
    wave[100] = 5000
    got = flags(detectors.rolling(series(wave), KEY, "v"), "is_rolling_outlier")
    assert got[100] and sum(got) == 1


def test_joint_outlier_share_and_minimum(spark, series):
    df = series([i % 17 for i in range(40)]).withColumn("w", F.when(F.col("i") == 20, 90.0).otherwise(F.col("v") * 2 + F.col("i") % 3))
    got = flags(detectors.joint_distance(df, KEY, "v", "w", 0.05), "is_multivariate_outlier")
    assert got[20] and sum(got) == 2
    assert not any(flags(detectors.joint_distance(df.filter("i < 9"), KEY, "v", "w"), "is_multivariate_outlier"))


def test_gaps(series):
    df = series(range(10)).filter("i not in (3, 4, 8)")
    rows = grids.detect_gaps(df, KEY, "ts", 15).orderBy("gap_start").collect()
    assert [(str(r.gap_start)[11:16], str(r.gap_end)[11:16], r.gap_intervals, r.gap_duration_min) for r in rows] == [("00:45", "01:00", 2, 30.0), ("02:00", "02:00", 1, 15.0)]


def packets(spark, rows):
    return spark.createDataFrame(rows, "meter_id string, minute int, delay double, kw double").selectExpr(
        "meter_id", "timestamp_seconds(1700000000 + minute * 60) as ts", "timestamp_micros(cast((1700000000 + minute * 60) * 1000000L + delay * 60000000 as bigint)) as arrival_ts", "kw", "delay")


def test_late_boundaries(spark):
    got = ami.flag_late(packets(spark, [("m", 0, d, 1.0) for d in (30.0, 30.5, 120.0, 120.5)])).orderBy("delay").collect()
    assert [(r.packet_delay_min, r.is_late) for r in got] == [(30.0, False), (30.5, True), (120.0, True)]
    assert [r.is_late for r in ami.flag_late(packets(spark, [("m", 0, 5.0, 1.0)]).drop("arrival_ts")).collect()] == [False]


def test_latest_packet_wins(spark):
    df = packets(spark, [("m", 0, 5.0, 1.0), ("m", 0, 9.0, 2.0), ("n", 0, 1.0, 3.0)]).select("meter_id", "ts", "arrival_ts", "kw")
    assert sorted((r.meter_id, r.kw) for r in grids.one_per_slot(df, ["meter_id", "ts"], "arrival_ts").collect()) == [("m", 2.0), ("n", 3.0)]


def test_channels_ranges_consistency_and_score(spark):
    df = spark.createDataFrame([(1, 100.0, 75.0, 125.0, 415.0, 10.0, 0.8), (2, None, 75.0, 125.0, 415.0, 10.0, 0.8), (3, 100.0, 75.0, 125.0, 900.0, 10.0, 0.5)], "i int, kw double, kvar double, kva double, voltage double, current double, pf double")
    rows = ami.interval_score(ami.check_consistency(ami.check_limits(ami.sync_channels(df)))).orderBy("i").collect()
    assert [r.channels_complete for r in rows] == [True, False, True]
    assert [r.physically_consistent for r in rows] == [True, False, False]
    assert [r.voltage_range_valid for r in rows] == [True, True, False]
    assert rows[1].kw_range_valid and rows[0].quality_score == pytest.approx(1.0)
    assert rows[1].quality_score == pytest.approx(0.4 * 5 / 6 + 0.3 + 0.2)


def test_missing_required_channel_is_added(spark):
    df = ami.sync_channels(spark.createDataFrame([(1.0,)], "kw double"), ["kw", "pf"])
    assert df.collect()[0].channels_complete is False and "pf" in df.columns


def test_impute_hybrid_rules(series):
    week = [float(i % 7) for i in range(20)]
    v = week.copy()
    v[0] = None
    v[5] = v[6] = None
    v[10] = v[11] = v[12] = v[13] = None
    v[19] = None
    got = flags(impute(series(v), KEY, "v", rows_per_week=7, out="r"), "r")
    assert got[0] is None
    assert got[5:7] == [pytest.approx(4 + (0 - 4) / 3), pytest.approx(4 + (0 - 4) * 2 / 3)]
    assert got[10:14] == [3.0, 4.0, got[5], got[6]]
    assert got[19] == 4.0


def test_impute_interpolate_limits(series):
    v = [0.0] + [None] * 12 + [13.0]
    got = flags(impute(series(v), KEY, "v", method="interpolate", out="r"), "r")
    assert got[1:7] == [pytest.approx(i) for i in range(1, 7)] and got[7:10] == [6.0] * 3 and got[10:13] == [13.0] * 3
    with pytest.raises(ValueError):
        impute(series(v), KEY, "v", method="zero")


def test_generator_periods(series):
    imports = [100.0] * 20 + [1.0, 1.0] + [100.0] * 5 + [1.0]
    df = events.generator_periods(events.generator_on(series(imports, name="grid_import"), KEY), KEY).orderBy("i").collect()
    assert [r.is_dg for r in df][20:22] == [True, True] and sum(r.is_dg for r in df) == 3
    assert [r.dg_event_type for r in df][20:23] == ["grid_to_dg", "dg_running", "dg_to_grid"]
    assert [r.dg_period_id for r in df][19:23] == [-1, 1, 1, -1] and df[-1].dg_period_id == 2
    with pytest.raises(ValueError):
        events.generator_on(series(imports, name="grid_import"), KEY, drop_pct=100)


def test_capacitor_switch_in_and_normalised(series):
    df = series([300.0 + (i % 3) for i in range(20)], name="kw").withColumns({"pf": F.when(F.col("i") < 12, 0.75).otherwise(0.97)}).withColumn("kva", F.col("kw") / F.col("pf"))
    df = df.withColumn("kw", F.when(F.col("i") == 11, 301.0).when(F.col("i") == 12, 301.2).otherwise(F.col("kw"))).withColumn("kva", F.col("kw") / F.col("pf"))
    rows = events.normalise_capacitor(events.capacitor_events(df, KEY), KEY).orderBy("i").collect()
    assert [r.i for r in rows if r.is_apfc_event] == [12] and rows[12].apfc_event_type == "cap_switch_in"
    assert rows[12].kva_normalised == pytest.approx(301.2 / 0.75)


def test_artefact_needs_abnormal_frequency(series):
    df = series([100.0 + i % 5 for i in range(60)], name="kva").withColumns({"kw": F.lit(50.0) + F.col("i") % 3, "frequency": F.when(F.col("i") == 40, 48.0).otherwise(50.0)})
    df = df.withColumn("kva", F.when(F.col("i").isin(40, 50), 400.0).otherwise(F.col("kva")))
    got = flags(events.ct_artefacts(df, KEY), "is_ct_artefact")
    assert [i for i, f in enumerate(got) if f] == [40]


def test_interval_flag_counts_overlaps_and_bounds(spark, series):
    df = series(range(8))
    gaps = spark.createDataFrame([("m", 2, 4), ("m", 3, 3), ("x", 0, 7)], "meter_id string, a int, b int").selectExpr("meter_id", "timestamp_seconds(unix_timestamp(timestamp'2025-04-01') + a * 900) as s", "timestamp_seconds(unix_timestamp(timestamp'2025-04-01') + b * 900) as e")
    assert flags(joins.flag_inside(df, gaps, KEY, "ts", "s", "e"), "in_interval") == [False, False, True, True, True, False, False, False]


def test_quality_run_flags_spike_and_reports(series):
    values = [50 + 10 * math.sin(i / 24 * 2 * math.pi) + (i * 7 % 5) * 0.3 for i in range(336)]
    values[100] = 900.0
    for i in range(200, 206):
        values[i] = 42.0
    df = clean_meters(series(values, step="1 hour", name="demand_kwh"), KEY, rows_per_week=168).orderBy("i").collect()
    assert df[100].is_anomaly and df[100].demand_kwh_clean < 100 and df[202].is_frozen
    r = quality_report(clean_meters(series(values, step="1 hour", name="demand_kwh"), KEY, rows_per_week=168), KEY).collect()[0]
    assert r.total_intervals == 336 and 0 < r.total_anomaly_pct < 10 and r.mean_quality_score == pytest.approx(1.0)


def test_centred_frame_is_half_open(spark, series):
    from wattloom.operators.frames import centred_time

    df = series(range(9), step="1 hour")
    got = flags(df.withColumn("n", F.count("v").over(centred_time(KEY, 4 * MICROS["hour"]))), "n")
    assert got == [3, 4, 4, 4, 4, 4, 4, 3, 2]


def test_chunks_equal_whole_series(series):
    from wattloom.operators.frames import in_chunks

    rnd = [((i * 7919) % 101) * 1.0 for i in range(400)]
    rnd[96] = rnd[191] = rnd[300] = 2000.0
    df = series(rnd)
    whole = flags(detectors.rolling(df, KEY, "v", hours=6), "is_rolling_outlier")
    split = flags(in_chunks(df, KEY, MICROS["day"], 3 * MICROS["hour"], 3 * MICROS["hour"], lambda d, k: detectors.rolling(d, k, "v", hours=6)), "is_rolling_outlier")
    assert whole == split and whole[96] and whole[191] and whole[300]
    with pytest.raises(ValueError):
        in_chunks(df, KEY, MICROS["hour"], MICROS["day"], 0, lambda d, k: d)
