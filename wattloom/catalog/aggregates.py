"""Aggregations and rollups."""

from pyspark.sql import Window, functions as F

from wattloom.catalog.joins import registries
from wattloom.catalog.registry import query
from wattloom.catalog.views import located, weather_at
from wattloom.functions import calendar as cal, labels
from wattloom.operators import accuracy, detectors, events, grids, load
from wattloom.operators.quantiles import attach_quantiles
from wattloom.plans import features

KEY = ["meter_id"]


@query("agg_fleet_ts", "ts:t fleet_mean:5 fleet_std:5 fleet_count:i", "SELECT ts, avg(demand_kwh) AS fleet_mean, stddev_samp(demand_kwh) AS fleet_std, count(demand_kwh) AS fleet_count FROM readings GROUP BY 1 HAVING count(demand_kwh) >= 5")
def _(t):
    return features.fleet_aggregate(t.readings)


TOD = "CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 6 WHEN hour(ts) < 14 THEN 10 WHEN hour(ts) < 18 THEN 14 WHEN hour(ts) < 22 THEN 18 ELSE 22 END"
STARTS = {
    "dam_15min": "time_bucket(INTERVAL 15 MINUTES, ts)", "native_30min": "time_bucket(INTERVAL 30 MINUTES, ts)", "hourly": "date_trunc('hour', ts)",
    "tod_4h": f"date_trunc('day', ts) + to_hours({TOD})",
}
IDS = {"dam_15min": "hour(b) * 4 + minute(b) // 15", "native_30min": "hour(b) * 2 + minute(b) // 30", "hourly": "hour(b)", "tod_4h": "CASE hour(b) WHEN 0 THEN 0 ELSE (hour(b) - 2) // 4 END"}


def blocks_sql(cadence):
    src = "fc30" if cadence != "dam_15min" else "(SELECT meter_id, ts + to_minutes(15 * p) AS ts, predicted_kwh / 2.0 AS predicted_kwh, actual_kwh / 2.0 AS actual_kwh FROM fc30, (VALUES (0), (1)) parts(p))"
    return f"""SELECT meter_id, {IDS[cadence]} AS block_id, b AS block_start_ts, p AS predicted_kwh, a AS actual_kwh, abs(p - a) AS abs_error_kwh, 100.0 * abs(p - a) / greatest(a, 0.0005) AS ape,
        p - a AS mbe_kwh, 100.0 * (p - a) / greatest(a, 0.0005) AS signed_pct_error, '{cadence}' AS cadence FROM (
        SELECT meter_id, {STARTS[cadence]} AS b, sum(predicted_kwh) AS p, sum(actual_kwh) AS a FROM {src} GROUP BY 1, 2) WHERE a >= 0.0005"""


ALL_BLOCKS = " UNION ALL ".join(blocks_sql(c) for c in STARTS)
BLOCK_COLS = "meter_id:s block_id:i block_start_ts:t predicted_kwh:5 actual_kwh:5 abs_error_kwh:5 ape:3 mbe_kwh:5 signed_pct_error:3 cadence:s"


def all_blocks(t):
    return accuracy.block_accuracy(t.fc30, t.fc30, list(accuracy.BLOCK_ID))


@query("agg_block_energy", "meter_id:s block_start_ts:t demand_kwh:4", f"SELECT meter_id, {STARTS['tod_4h']} AS block_start_ts, sum(demand_kwh) AS demand_kwh FROM readings GROUP BY 1, 2")
def _(t):
    return t.readings.groupBy("meter_id", cal.block_start("ts", "tod_4h").alias("block_start_ts")).agg(F.sum("demand_kwh").alias("demand_kwh"))


@query("agg_block_mape", BLOCK_COLS, ALL_BLOCKS)
def _(t):
    return all_blocks(t)


COHORT = "CASE substr(meter_id, -1) WHEN '0' THEN 'A' WHEN '1' THEN 'B' WHEN '2' THEN 'C' ELSE 'D' END"


def site_cohorts(t):
    """One row per meter, labelled from its (derived) reference error."""
    mape = F.substring("meter_id", -1, 1).cast("int") * 10.0 + 3.0
    return t.sites.select("meter_id").distinct().withColumn("cohort", labels.cohort(mape))


@query("agg_cohort_rollup", "cohort:s cadence:s mean_mape:3 median_mape:3 p95_mape:2 mbe_kwh:4 n_blocks:i n_meters:i", f"""SELECT {COHORT} AS cohort, cadence, avg(ape) AS mean_mape, median(ape) AS median_mape, quantile_cont(ape, 0.95) AS p95_mape,
    avg(mbe_kwh) AS mbe_kwh, count(*) AS n_blocks, count(DISTINCT meter_id) AS n_meters FROM ({ALL_BLOCKS}) GROUP BY 1, 2""")
def _(t):
    return accuracy.cohort_rollup(all_blocks(t), site_cohorts(t))


@query("agg_fleet_mape", "mean_mape:3 median_mape:3 p25_mape:3 p75_mape:3 p95_mape:2 max_mape:2 mbe_kwh:4 n_blocks:i n_meters:i", f"""SELECT avg(ape) AS mean_mape, median(ape) AS median_mape, quantile_cont(ape, 0.25) AS p25_mape, quantile_cont(ape, 0.75) AS p75_mape,
    quantile_cont(ape, 0.95) AS p95_mape, max(ape) AS max_mape, avg(mbe_kwh) AS mbe_kwh, count(*) AS n_blocks, count(DISTINCT meter_id) AS n_meters FROM ({blocks_sql('hourly')})""")
def _(t):
    return accuracy.fleet_mape(accuracy.block_accuracy(t.fc30, t.fc30, ["hourly"]))


@query("agg_meter_cadence_summary", "meter_id:s cadence:s mean_ape:3 median_ape:3 p95_ape:2 total_predicted:4 total_actual:4 n_blocks:i under_5pct:4", f"""SELECT meter_id, cadence, avg(ape) AS mean_ape, median(ape) AS median_ape, quantile_cont(ape, 0.95) AS p95_ape,
    sum(predicted_kwh) AS total_predicted, sum(actual_kwh) AS total_actual, count(*) AS n_blocks, avg((ape < 5)::INT) * 100 AS under_5pct FROM ({ALL_BLOCKS}) GROUP BY 1, 2""")
def _(t):
    return accuracy.meter_cadence_summary(all_blocks(t))


METRICS_SQL = """SELECT meter_id, coalesce(avg(e), 0) AS mape, avg(abs(a - p)) AS mae, avg(p - a) AS mbe, sqrt(avg((a - p) * (a - p))) AS rmse,
    CASE WHEN var_pop(a) * count(*) > 1e-12 THEN 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) ELSE 0 END AS r2, coalesce(100.0 * count(*) FILTER (e <= 5) / nullif(count(e), 0), 0) AS within5, coalesce(100.0 * count(*) FILTER (e <= 10) / nullif(count(e), 0), 0) AS within10,
    100.0 * avg((a BETWEEN lo AND hi)::INT) AS coverage_80, 100.0 * avg(2 * abs(a - p) / greatest(abs(a) + abs(p), 0.5)) AS smape, 100.0 * sum(abs(a - p)) / sum(abs(a)) AS wape,
    count(*) AS n, count(*) FILTER (a > 0.5) AS n_nonzero, 100.0 * count(*) FILTER (a <= 0.5) / count(*) AS zero_pct FROM (
    SELECT meter_id, actual_kwh AS a, predicted_kwh AS p, q10_kwh AS lo, q90_kwh AS hi, CASE WHEN actual_kwh > 0.5 THEN abs(actual_kwh - predicted_kwh) / actual_kwh * 100 END AS e FROM fc) GROUP BY 1"""
BASIC = "meter_id:s mape:3 mae:4 mbe:4 rmse:4 r2:4 within5:4 within10:4 coverage_80:4"


def metrics(t):
    return accuracy.point_metrics(t.fc, KEY, "actual_kwh", "predicted_kwh", "q10_kwh", "q90_kwh")


@query("agg_point_metrics", BASIC, METRICS_SQL)
def _(t):
    return metrics(t)


@query("agg_point_metrics_ext", BASIC + " smape:4 wape:4 n:i n_nonzero:i zero_pct:4", METRICS_SQL)
def _(t):
    return metrics(t)


@query("agg_metrics_variants", "meter_id:s mape_positive:3 mape_half:3 mape_replay:3 bias:4", """SELECT meter_id, avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0) AS mape_positive,
    avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0.5) AS mape_half,
    CASE WHEN count(*) FILTER (actual_kwh > 10) >= 4 THEN avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 10) END AS mape_replay,
    avg(predicted_kwh - actual_kwh) FILTER (actual_kwh > 0.5) AS bias FROM fc GROUP BY 1""")
def _(t):
    m = lambda floor, n=1: accuracy.masked_mape("actual_kwh", "predicted_kwh", floor, n)
    bias = F.avg(F.when(F.col("actual_kwh") > 0.5, F.col("predicted_kwh") - F.col("actual_kwh")))
    return t.fc.groupBy("meter_id").agg(m(0.0).alias("mape_positive"), m(0.5).alias("mape_half"), m(10.0, 4).alias("mape_replay"), bias.alias("bias"))


def block_metric_sql():
    hours = {"morning": "hour(ts) BETWEEN 6 AND 9", "solar": "hour(ts) BETWEEN 10 AND 17", "peak": "hour(ts) BETWEEN 18 AND 21", "night": "(hour(ts) >= 22 OR hour(ts) < 6)"}
    parts = []
    for b, c in hours.items():
        parts.append(f"""CASE WHEN count(*) FILTER ({c}) >= 5 THEN coalesce(avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER ({c} AND actual_kwh > 0.5), 0) END AS {b}_mape,
            CASE WHEN count(*) FILTER ({c}) >= 5 THEN avg(abs(actual_kwh - predicted_kwh)) FILTER ({c}) END AS {b}_mae, count(*) FILTER ({c}) AS {b}_n,
            CASE WHEN count(*) FILTER ({c}) >= 5 THEN avg(actual_kwh) FILTER ({c}) END AS {b}_mean_demand""")
    return f"SELECT meter_id, {', '.join(parts)} FROM fc GROUP BY 1"


@query("agg_tod_block_metrics", "meter_id:s" + "".join(f" {b}_mape:3 {b}_mae:4 {b}_n:i {b}_mean_demand:4" for b in ("morning", "solar", "peak", "night")), block_metric_sql())
def _(t):
    return accuracy.day_block_metrics(t.fc, KEY, "actual_kwh", "predicted_kwh").fillna(0, [f"{b}_n" for b in ("morning", "solar", "peak", "night")])


def first_origin():
    return F.lit("2024-01-08").cast("timestamp")

HOR_SQL = """SELECT *, (epoch(ts) - epoch(TIMESTAMP '2024-01-08 00:00:00')) / 3600.0 AS lead_h, predicted_kwh - actual_kwh AS mbe_kwh,
    CASE WHEN actual_kwh >= 0.0005 THEN 100.0 * abs(predicted_kwh - actual_kwh) / actual_kwh END AS mape, (actual_kwh BETWEEN q10_kwh AND q90_kwh)::INT AS in_band FROM fc"""


@query("agg_horizon_rows", "meter_id:s ts:t lead_h:3 mape:3 mbe_kwh:4 in_band:i", HOR_SQL)
def _(t):
    return accuracy.horizon_rows(t.fc, first_origin())


@query("agg_horizon_metrics", "meter_id:s mape_7d:3 mape_p95:2 mbe_kwh_mean:4 cov_q10_q90:5 n:i", f"""SELECT meter_id, avg(mape) AS mape_7d, quantile_cont(mape, 0.95) AS mape_p95, avg(mbe_kwh) AS mbe_kwh_mean, avg(in_band) AS cov_q10_q90, count(*) AS n
    FROM ({HOR_SQL}) WHERE mape IS NOT NULL GROUP BY 1""")
def _(t):
    return accuracy.horizon_summary(accuracy.horizon_rows(t.fc, first_origin()))


@query("agg_horizon_decay", "meter_id:s mape_0_24h:3 mape_24_72h:3 mape_72h_7d:3", f"""SELECT meter_id, avg(mape) FILTER (actual_kwh > 0.5 AND lead_h <= 24) AS mape_0_24h, avg(mape) FILTER (actual_kwh > 0.5 AND lead_h > 24 AND lead_h <= 72) AS mape_24_72h,
    avg(mape) FILTER (actual_kwh > 0.5 AND lead_h > 72) AS mape_72h_7d FROM ({HOR_SQL}) WHERE lead_h <= 168 GROUP BY 1""")
def _(t):
    return accuracy.horizon_decay(accuracy.horizon_rows(t.fc, first_origin()), KEY)


MO_SQL = "SELECT meter_id, date_trunc('week', ts) AS origin, avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0.5) AS mape FROM fc GROUP BY 1, 2"


def meter_origins(t):
    return t.fc.groupBy("meter_id", F.date_trunc("week", "ts").alias("origin")).agg(accuracy.masked_mape("actual_kwh", "predicted_kwh", 0.5).alias("mape"))


STATS = """count(*) AS n, avg(mape) AS mape_mean, stddev_samp(mape) AS mape_std, min(mape) AS mape_min, max(mape) AS mape_max, median(mape) AS mape_median, quantile_cont(mape, 0.9) AS mape_p90,
    count(*) FILTER (mape < 4) AS under_4pct, count(*) FILTER (mape < 10) AS under_10pct"""


@query("agg_origin_rollups", "level:s item:s n:i mape_mean:3 mape_std:2 mape_min:3 mape_max:2 mape_median:3 mape_p90:2 under_4pct:i under_10pct:i", f"""WITH m AS ({MO_SQL})
    SELECT 'meter' AS level, meter_id AS item, {STATS} FROM m GROUP BY 2 UNION ALL SELECT 'origin', strftime(origin, '%Y-%m-%d'), {STATS} FROM m GROUP BY 2 UNION ALL SELECT 'fleet', 'fleet', {STATS} FROM m""")
def _(t):
    return accuracy.origin_rollups(meter_origins(t))


@query("agg_fleet_stats", "n:i mape_mean:4 mape_max:2 under_4:i under_10:i mape_median:4 mape_p90:4", """SELECT count(*) AS n, avg(mape) AS mape_mean, max(mape) AS mape_max, count(*) FILTER (mape < 4) AS under_4, count(*) FILTER (mape < 10) AS under_10,
    median(mape) AS mape_median, quantile_cont(mape, 0.9) AS mape_p90 FROM registry""")
def _(t):
    m = F.col("mape")
    stats = lambda d: d.agg(
        F.count("*").alias("n"), F.avg(m).alias("mape_mean"), F.max(m).alias("mape_max"), F.count_if(m < 4).alias("under_4"), F.count_if(m < 10).alias("under_10"))
    return attach_quantiles(t.registry.select("mape"), stats, [], "mape", {"mape_median": 0.5, "mape_p90": 0.9})


@query("agg_cohort_histogram", "tier:s cohort:s n:i delta_mean:4", """SELECT tier, CASE WHEN mape < 5 THEN 'A' WHEN mape < 15 THEN 'B' WHEN mape < 25 THEN 'C' ELSE 'D' END AS cohort, count(*) AS n, avg(peak_mape - mape) AS delta_mean
    FROM registry WHERE k % 7 <> 0 AND k % 5 <> 0 GROUP BY 1, 2""")
def _(t):
    old, new = registries(t)
    df = old.join(new, "msn")
    return df.groupBy("tier", labels.cohort(F.col("mape_old")).alias("cohort")).agg(F.count("*").alias("n"), F.avg(F.col("mape_new") - F.col("mape_old")).alias("delta_mean"))


@query("agg_derived_load", "meter_id:s peak_kw:6 peak_ts:t average_kw:6 load_factor:5 total_energy_kwh:6 horizon_hours:2", """SELECT meter_id, max(kw) AS peak_kw, arg_max(ts, (kw, -epoch_us(ts))) AS peak_ts, avg(kw) AS average_kw, avg(kw) / max(kw) AS load_factor,
    sum(demand_kwh) / 1000.0 AS total_energy_kwh, count(*) * 0.5 AS horizon_hours FROM (SELECT *, demand_kwh * 2.0 / 1000.0 AS kw FROM readings) GROUP BY 1""")
def _(t):
    return load.derived_load(t.readings, KEY, "demand_kwh")


@query("agg_diversity_factor", "sum_individual_peaks:5 coincident_peak_kw:5 coincident_ts:t diversity_factor:5", """WITH m AS (SELECT sum(p) AS s FROM (SELECT max(demand_kwh) * 0.002 AS p FROM readings GROUP BY meter_id)),
    c AS (SELECT max(k) AS k, arg_max(ts, (k, -epoch_us(ts))) AS ts FROM (SELECT ts, sum(demand_kwh) * 0.002 AS k FROM readings GROUP BY 1))
    SELECT s AS sum_individual_peaks, k AS coincident_peak_kw, ts AS coincident_ts, s / k AS diversity_factor FROM m, c""")
def _(t):
    return load.diversity(t.readings, "meter_id", "demand_kwh")


@query("agg_substation_forecast", "substation_id:s ts:t forecast_kwh:4 confidence_low:4 confidence_high:4 block_label:s block_mape:4", """SELECT split_part(meter_id, '-', 1) AS substation_id, ts, sum(predicted_kwh) AS forecast_kwh, sum(predicted_kwh) * 0.85 AS confidence_low, sum(predicted_kwh) * 1.15 AS confidence_high,
    CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 10 AND 17 THEN 'solar' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'peak' ELSE 'night' END AS block_label,
    avg(CAST(split_part(meter_id, '-', 2) AS INT) * 3.0) AS block_mape FROM fc GROUP BY 1, 2, 6""")
def _(t):
    dim = t.sites.select("meter_id").distinct().select("meter_id", F.split_part("meter_id", F.lit("-"), F.lit(1)).alias("substation_id"), (F.split_part("meter_id", F.lit("-"), F.lit(2)).cast("int") * 3.0).alias("mape"))
    total = t.fc.join(dim, "meter_id").groupBy("substation_id", "ts").agg(F.sum("predicted_kwh").alias("forecast_kwh"), F.avg("mape").alias("block_mape"))
    return total.withColumns({"confidence_low": F.col("forecast_kwh") * 0.85, "confidence_high": F.col("forecast_kwh") * 1.15, "block_label": cal.day_block(F.hour("ts"))})


@query("agg_fleet_summary", "n_meters:i mean_mape:4 median_mape:4 mean_peak_mape:4 min_peak_mape:2 max_peak_mape:2 n_green:i n_amber:i n_red:i n_ht:i n_large:i n_medium:i n_small:i", """SELECT count(*) AS n_meters, avg(mape) AS mean_mape, median(mape) AS median_mape,
    avg(nullif(peak_mape, 0)) AS mean_peak_mape, min(nullif(peak_mape, 0)) AS min_peak_mape, max(nullif(peak_mape, 0)) AS max_peak_mape, count(*) FILTER (mape < 8) AS n_green, count(*) FILTER (mape >= 8 AND mape < 12) AS n_amber, count(*) FILTER (mape >= 12) AS n_red,
    count(*) FILTER (tier LIKE 'HT%') AS n_ht, count(*) FILTER (tier LIKE 'Large%') AS n_large, count(*) FILTER (tier LIKE 'Medium%') AS n_medium, count(*) FILTER (tier LIKE 'Small%') AS n_small FROM registry""")
def _(t):
    return attach_quantiles(t.registry, load.registry_summary, [], "mape", {"median_mape": 0.5})


@query("agg_actuals_range", "first_ts:t last_ts:t n_meters:i", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT meter_id) AS n_meters FROM readings")
def _(t):
    per_meter = t.readings.groupBy("meter_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per_meter.agg(F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.count("*").alias("n_meters"))


@query("agg_hourly_resample", "meter_id:s ts:t demand_kwh:4", "SELECT meter_id, time_bucket(INTERVAL 2 HOURS, ts) AS ts, sum(demand_kwh) AS demand_kwh FROM grid GROUP BY 1, 2")
def _(t):
    return load.resample_sum(t.grid, KEY, "demand_kwh", 120)


@query("agg_meanpool", "meter_id:s pool_ts:t pooled:5", """SELECT meter_id, min(ts) AS pool_ts, avg(v) AS pooled FROM (SELECT meter_id, ts, coalesce(demand_kwh, 0.0) AS v, (row_number() OVER (PARTITION BY meter_id ORDER BY ts) - 1) // 12 AS pool FROM grid) GROUP BY meter_id, pool HAVING count(*) = 12""")
def _(t):
    return load.mean_pool(t.grid.fillna(0.0, ["demand_kwh"]), KEY, "demand_kwh", 12)


@query("agg_fleet_series", "strategy:s ts:t fleet_kwh:4 smoothed:5", """WITH f AS (SELECT strategy, ts, sum(predicted_kwh) AS fleet_kwh FROM strategies GROUP BY 1, 2),
    s AS (SELECT *, avg(fleet_kwh) OVER (PARTITION BY strategy ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS smoothed, row_number() OVER (PARTITION BY strategy ORDER BY ts) - 1 AS i FROM f) SELECT * FROM s WHERE i % 4 = 0""")
def _(t):
    return load.fleet_series(t.strategies, ["strategy"], "predicted_kwh")


@query("agg_headline", "strategy:s total_kwh:2 peak_day:d peak_day_kwh:3 peak_hod:i", """WITH d AS (SELECT strategy, date_trunc('day', ts) AS day, sum(predicted_kwh) AS k FROM strategies GROUP BY 1, 2), h AS (SELECT strategy, hour(ts) AS h, sum(predicted_kwh) AS k FROM strategies GROUP BY 1, 2)
    SELECT d.strategy, sum(k) AS total_kwh, arg_max(day, (k, -epoch_us(day))) AS peak_day, max(k) AS peak_day_kwh, any_value(p) AS peak_hod FROM d JOIN (SELECT strategy, arg_max(h, (k, -h)) AS p FROM h GROUP BY 1) x ON x.strategy = d.strategy GROUP BY 1""")
def _(t):
    return load.headline(t.strategies)


@query("agg_strategy_rollup", "strategy:s total_kwh:2 mean_kwh:4 n_rows:i n_meters:i kwh_per_slot:4", """SELECT strategy, sum(predicted_kwh) AS total_kwh, avg(predicted_kwh) AS mean_kwh, count(*) AS n_rows, count(DISTINCT meter_id) AS n_meters, sum(predicted_kwh) / count(DISTINCT ts) AS kwh_per_slot FROM strategies GROUP BY 1""")
def _(t):
    return load.strategy_rollup(t.strategies)


@query("agg_profile_quantiles", "meter_id:s dow:i hour:i minute:i mean_kwh:5 q10_kwh:5 q90_kwh:5", """WITH m AS (SELECT *, max(ts) OVER (PARTITION BY meter_id) AS last FROM readings), r AS (SELECT *, count(*) FILTER (ts >= last - INTERVAL 28 DAYS) OVER (PARTITION BY meter_id) AS nr FROM m)
    SELECT meter_id, isodow(ts) - 1 AS dow, hour(ts) AS hour, 0 AS minute, median(demand_kwh) AS mean_kwh, quantile_cont(demand_kwh, 0.1) AS q10_kwh, quantile_cont(demand_kwh, 0.9) AS q90_kwh FROM r WHERE ts >= last - INTERVAL 28 DAYS OR nr < 96 GROUP BY 1, 2, 3""")
def _(t):
    return load.slot_profile(t.readings, KEY, "demand_kwh")[0]


@query("agg_daily_error", "kind:s item:s mape:3", """SELECT 'daily_total' AS kind, 'all' AS item, avg(abs(a - p) / a * 100) FILTER (a > 0) AS mape FROM (SELECT sum(actual_kwh) AS a, sum(predicted_kwh) AS p FROM fc GROUP BY meter_id, date_trunc('day', ts))
    UNION ALL SELECT 'period', CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 'peak' ELSE 'off_peak' END, avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0) FROM fc GROUP BY 2
    UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0) FROM fc GROUP BY 2""")
def _(t):
    return load.daily_errors(t.fc, "actual_kwh", "predicted_kwh")


@query("agg_day_cards", "meter_id:s day:d n:i mape:3 peak_actual:4 min_actual:4 mean_actual:4 std_actual:4", """WITH d AS (SELECT meter_id, date_trunc('day', ts) AS day, count(*) AS n, coalesce(avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0.5), 0) AS mape, max(actual_kwh) AS peak_actual, min(actual_kwh) AS min_actual,
    avg(actual_kwh) AS mean_actual, stddev_samp(actual_kwh) AS std_actual, row_number() OVER (PARTITION BY meter_id ORDER BY date_trunc('day', ts)) - 1 AS i, count(*) OVER (PARTITION BY meter_id) AS nd FROM fc GROUP BY 1, 2)
    SELECT * FROM d WHERE i % greatest(nd // 8, 1) = 0 AND i // greatest(nd // 8, 1) < 8 AND n >= 4""")
def _(t):
    df = load.spaced_days(t.fc, KEY, 8)
    a = F.col("actual_kwh")
    return df.groupBy("meter_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("n"), accuracy.masked_mape("actual_kwh", "predicted_kwh", 0.5, empty=0.0).alias("mape"), F.max(a).alias("peak_actual"), F.min(a).alias("min_actual"), F.avg(a).alias("mean_actual"), F.stddev_samp(a).alias("std_actual"),
    ).filter("n >= 4")


@query("agg_forecast_sanity", "meter_id:s n_rows:i n_null:i n_negative:i n_extreme:i total_kwh:3 complete:b", """WITH h AS (SELECT meter_id, quantile_cont(demand_kwh, 0.95) AS p95 FROM sites GROUP BY 1),
    f AS (SELECT meter_id, CASE WHEN hour(ts) <> 5 THEN predicted_kwh * CASE WHEN hour(ts) = 3 THEN -1.0 WHEN hour(ts) = 4 THEN 20.0 ELSE 1.0 END END AS p FROM strategies WHERE strategy = 'A')
    SELECT meter_id, count(*) AS n_rows, count(*) FILTER (p IS NULL) AS n_null, count(*) FILTER (p < 0) AS n_negative, count(*) FILTER (p > 10 * p95) AS n_extreme, sum(p) AS total_kwh, count(*) = 168 AS complete FROM f LEFT JOIN h USING (meter_id) GROUP BY 1""")
def _(t):
    h = F.hour("ts")
    spoiled = F.when(h != 5, F.col("predicted_kwh") * F.when(h == 3, -1.0).when(h == 4, 20.0).otherwise(1.0))
    return load.forecast_sanity(t.strategies.filter("strategy = 'A'").withColumn("predicted_kwh", spoiled), t.sites, 168)


@query("agg_gap_disagreement", "meter_id:s total_A:3 total_B:3 diff:3", """SELECT meter_id, sum(predicted_kwh) FILTER (strategy = 'A') AS total_A, sum(predicted_kwh) FILTER (strategy = 'B') AS total_B,
    abs(sum(predicted_kwh) FILTER (strategy = 'A') - sum(predicted_kwh) FILTER (strategy = 'B')) AS diff FROM strategies GROUP BY 1 ORDER BY diff DESC NULLS LAST, meter_id LIMIT 3""")
def _(t):
    df = load.strategy_totals(t.strategies, ["A", "B"]).withColumn("diff", F.abs(F.col("total_A") - F.col("total_B")))
    return df.orderBy(F.desc_nulls_last("diff"), "meter_id").limit(3)


@query("agg_soc_known_states", "meter_id:s state_start:t state_end:t duration_min:2 mean_soc:5 state_type:s", """WITH c AS (SELECT *, quantile_cont(abs(current), 0.95) OVER (PARTITION BY meter_id) * 0.02 AS lim FROM (SELECT meter_id, ts, soc, CASE WHEN tag % 4 < 2 THEN 0.5 ELSE current END AS current FROM channels)),
    r AS (SELECT *, abs(current) < lim AS rest, lag(abs(current) < lim) OVER (PARTITION BY meter_id ORDER BY ts) AS prior FROM c),
    g AS (SELECT *, sum((rest AND NOT coalesce(prior, false))::INT) OVER (PARTITION BY meter_id ORDER BY ts) AS id FROM r)
    SELECT meter_id, min(ts) AS state_start, max(ts) AS state_end, count(*) * 60.0 AS duration_min, avg(soc) AS mean_soc, CASE WHEN avg(soc) < 5 THEN 'full_discharge' WHEN avg(soc) > 98 THEN 'full_charge' ELSE 'rest' END AS state_type
    FROM g WHERE rest GROUP BY meter_id, id HAVING count(*) * 60.0 >= 120""")
def _(t):
    df = t.channels.withColumn("current", F.when(F.col("tag") % 4 < 2, 0.5).otherwise(F.col("current")))
    return events.rest_states(df, KEY, 60.0, 120.0)


@query("agg_linear_fit", "meter_id:s hour:i n:i slope:4 intercept:3", f"""SELECT meter_id, hour(s.ts) AS hour, count(*) AS n, CASE WHEN count(*) >= 10 AND max(temperature) - min(temperature) >= 1 THEN regr_slope(demand_kwh, temperature) ELSE 0 END AS slope,
    CASE WHEN count(*) >= 10 AND max(temperature) - min(temperature) >= 1 THEN regr_intercept(demand_kwh, temperature) ELSE avg(demand_kwh) END AS intercept FROM sites s JOIN weather wx ON {weather_at('s')} GROUP BY 1, 2""")
def _(t):
    df = located(t.sites).join(t.weather.select("location_id", "ts", "temperature"), ["location_id", "ts"]).withColumn("hour", F.hour("ts"))
    return load.temperature_fit(df, ["meter_id", "hour"], min_n=10)


SOC_SQL = "SELECT l_suppkey AS site_id, 380.0 + l_tax * 1000.0 AS voltage, l_quantity * 2.0 AS bms_soc, (l_tax * 1000.0 - 35.0) * 0.1 + (l_discount - 0.05) * 20.0 + l_tax * l_tax * 300.0 AS soc_error FROM lineitem"


def soc_rows(t):
    tax = F.col("l_tax")
    return t.read("lineitem").select(F.col("l_suppkey").alias("site_id"), (380.0 + tax * 1000.0).alias("voltage"), (F.col("l_quantity") * 2.0).alias("bms_soc"),
                                     ((tax * 1000.0 - 35.0) * 0.1 + (F.col("l_discount") - 0.05) * 20.0 + tax * tax * 300.0).alias("soc_error"))


LIN_SQL = f"""WITH r AS ({SOC_SQL}), k AS (SELECT site_id, count(*) AS n_points, regr_slope(soc_error, voltage - 415.0) AS c1, regr_intercept(soc_error, voltage - 415.0) AS c0, regr_r2(soc_error, voltage - 415.0) AS r_squared,
    avg(abs(soc_error)) AS mean_error_before, min(voltage) AS v_min, max(voltage) AS v_max FROM r GROUP BY 1)"""


@query("agg_poly_calibration", "site_id:i n_points:i c0:4 c1:5 mean_error_before:4 mean_residual_after:4 max_residual:4 r_squared:4 v_min:2 v_max:2", f"""{LIN_SQL}
    SELECT k.*, m.* EXCLUDE (s) FROM k JOIN (SELECT r.site_id AS s, avg(abs(soc_error - c0 - c1 * (voltage - 415.0))) AS mean_residual_after, max(abs(soc_error - c0 - c1 * (voltage - 415.0))) AS max_residual FROM r JOIN k ON k.site_id = r.site_id GROUP BY 1) m ON m.s = k.site_id""")
def _(t):
    return load.calibrate(soc_rows(t), "site_id", "voltage", "soc_error", degree=1)


QUAD_SQL = f"""WITH r AS (SELECT *, voltage - 415.0 AS x FROM ({SOC_SQL})), s AS (SELECT site_id, CAST(count(*) AS DOUBLE) AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(soc_error) AS t0, sum(soc_error * x) AS t1, sum(soc_error * x * x) AS t2,
        avg(abs(soc_error)) AS mean_error_before, var_pop(soc_error) AS ve FROM r GROUP BY 1), d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
    c AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS c0, (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1,
        (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d)
    SELECT c.site_id, any_value(n) AS n_points, 2 AS degree, any_value(mean_error_before) AS mean_error_before, avg(abs(soc_error - c0 - c1 * x - c2 * x * x)) AS mean_residual_after, 1 - avg(pow(soc_error - c0 - c1 * x - c2 * x * x, 2)) / any_value(ve) AS r_squared
    FROM r JOIN c ON c.site_id = r.site_id GROUP BY 1"""


@query("agg_poly_calibration_deg2", "site_id:i n_points:i degree:i mean_error_before:4 mean_residual_after:4 r_squared:4", QUAD_SQL)
def _(t):
    return load.calibrate(soc_rows(t), "site_id", "voltage", "soc_error", degree=2)


@query("fn_soc_correct", "site_id:i voltage:2 bms_soc:2 corrected_soc:4", f"{LIN_SQL} SELECT r.site_id, voltage, bms_soc, least(greatest(bms_soc - (c0 + c1 * (voltage - 415.0)), 0.0), 100.0) AS corrected_soc FROM r JOIN k USING (site_id)")
def _(t):
    rows = soc_rows(t)
    return load.correct_soc(rows, load.calibrate(rows, "site_id", "voltage", "soc_error", degree=1), "site_id", "voltage", "bms_soc")


@query("agg_calibration_drift", "meter_id:s n_days:i days_over:i longest_run:i has_drifted:b", """WITH d AS (SELECT meter_id, date_trunc('day', ts) AS day, avg(abs(CAST(tag % 11 - 5 AS DOUBLE))) > 2.5 AS x FROM sites GROUP BY 1, 2),
    h AS (SELECT meter_id, day, CAST(day AS DATE) - DATE '1970-01-01' - row_number() OVER (PARTITION BY meter_id ORDER BY day) AS g FROM d WHERE x),
    l AS (SELECT meter_id, max(c) AS longest FROM (SELECT meter_id, g, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT meter_id, CAST(max(day) AS DATE) - CAST(min(day) AS DATE) + 1 AS n_days, count(*) FILTER (x) AS days_over FROM d GROUP BY 1)
    SELECT s.*, coalesce(longest, 0) AS longest_run, CASE WHEN n_days < 7 THEN days_over = n_days ELSE coalesce(longest, 0) >= 7 END AS has_drifted FROM s LEFT JOIN l USING (meter_id)""")
def _(t):
    return load.calibration_drift(t.sites.withColumn("residual", (F.col("tag") % 11 - 5).cast("double")), KEY, "residual", threshold=2.5)


@query("agg_multivariate_outlier", "meter_id:s ts:t is_multivariate_outlier:b", """WITH s AS (SELECT meter_id AS m, count(*) AS n, avg(kw) AS ma, avg(kvar) AS mb, var_samp(kw) AS va, var_samp(kvar) AS vb, covar_samp(kw, kvar) AS c FROM channels GROUP BY 1),
    d AS (SELECT meter_id, ts, CASE WHEN n >= 10 THEN (vb * (kw - ma) * (kw - ma) - 2 * c * (kw - ma) * (kvar - mb) + va * (kvar - mb) * (kvar - mb)) / (va * vb - c * c) END AS d2 FROM channels JOIN s ON m = meter_id)
    SELECT meter_id, ts, coalesce(d2 > quantile_cont(d2, 0.95) OVER (PARTITION BY meter_id), false) AS is_multivariate_outlier FROM d""")
def _(t):
    return detectors.joint_distance(t.channels, KEY, "kw", "kvar")
