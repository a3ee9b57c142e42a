"""Window operators: lags, rolling statistics, detectors, artefacts, generator periods, imputation."""

from pyspark.sql import Window, functions as F

from wattloom.catalog.registry import query
from wattloom.operators import detectors, events, frames, history, impute
from wattloom.operators.frames import MICROS, at_least, median, ordered, previous_rows, last_rows
from wattloom.plans import features
from wattloom.plans.forecasts import price_percentile

KEY = ["meter_id"]
W = "OVER (PARTITION BY meter_id ORDER BY ts)"
ID = "meter_id:s ts:t demand_kwh:4"


def prev(n):
    return f"OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def incl(n):
    return f"OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def by_week(df, apply, before, after):
    """Bounded frames in weekly chunks, reaching the given hours into the neighbours."""
    return frames.in_chunks(df, KEY, 7 * MICROS["day"], before * MICROS["hour"], after * MICROS["hour"], apply)


HOURS = [1, 2, 3, 6, 12, 24, 48, 168]


@query("win_lag_hours", ID + "".join(f" demand_kwh_lag_{n}h:4" for n in HOURS),
       f"SELECT meter_id, ts, demand_kwh, {', '.join(f'lag(demand_kwh, {n}) {W} AS demand_kwh_lag_{n}h' for n in HOURS)} FROM readings")
def _(t):
    return features.add_lags(t.readings, KEY, "demand_kwh", {n: f"demand_kwh_lag_{n}h" for n in HOURS})


SLOTS = [1, 2, 4, 6, 12, 24, 48, 96, 336]


@query("win_lag_slots", ID + "".join(f" lag_{n}:4" for n in SLOTS),
       f"SELECT meter_id, ts, demand_kwh, {', '.join(f'lag(demand_kwh, {n}) {W} AS lag_{n}' for n in SLOTS)} FROM grid")
def _(t):
    return features.add_lags(t.grid, KEY, "demand_kwh", {n: f"lag_{n}" for n in SLOTS})


ROLL = [3, 6, 12, 24, 48, 168]


@query("win_rolling_incl", ID + "".join(f" rmean_{n}:5 rstd_{n}:5 rmin_{n}:4 rmax_{n}:4" for n in ROLL),
       "SELECT meter_id, ts, demand_kwh, " + ", ".join(
           f"avg(demand_kwh) {incl(n)} AS rmean_{n}, stddev_samp(demand_kwh) {incl(n)} AS rstd_{n}, min(demand_kwh) {incl(n)} AS rmin_{n}, max(demand_kwh) {incl(n)} AS rmax_{n}" for n in ROLL) + " FROM readings")
def _(t):
    return features.add_rolling_inclusive(t.readings, KEY, "demand_kwh", ROLL)


@query("win_rolling_excl", ID + "".join(f" rmean_{n}:5 rstd_{n}:5" for n in (6, 12, 48, 336)),
       "SELECT meter_id, ts, demand_kwh, " + ", ".join(
           f"avg(demand_kwh) {prev(n)} AS rmean_{n}, stddev_samp(demand_kwh) {prev(n)} AS rstd_{n}" for n in (6, 12, 48, 336)) + " FROM readings")
def _(t):
    n = [6, 12, 48, 336]
    return frames.with_rolling_moments(t.readings, KEY, "demand_kwh", n, {i: (f"rmean_{i}", f"rstd_{i}") for i in n})


@query("win_momentum", ID + " diff_1:4 diff_4:4 rmean_14d:5 rmean_30d:5 trend_ratio:5", f"""SELECT *, rmean_14d / greatest(rmean_30d, 1.0) AS trend_ratio FROM (
    SELECT meter_id, ts, demand_kwh, lag(demand_kwh, 1) {W} - lag(demand_kwh, 2) {W} AS diff_1, lag(demand_kwh, 1) {W} - lag(demand_kwh, 5) {W} AS diff_4,
    CASE WHEN count(demand_kwh) {prev(672)} >= 48 THEN avg(demand_kwh) {prev(672)} END AS rmean_14d,
    CASE WHEN count(demand_kwh) {prev(1440)} >= 48 THEN avg(demand_kwh) {prev(1440)} END AS rmean_30d FROM halves)""")
def _(t):
    return features.add_momentum(t.halves, KEY, "demand_kwh", diff_names=("diff_1", "diff_4"))


@query("win_rolling_median", ID + "".join(f" rmedian_{n}:5" for n in (6, 12, 48, 336)),
       "SELECT meter_id, ts, demand_kwh, " + ", ".join(f"median(demand_kwh) {prev(n)} AS rmedian_{n}" for n in (6, 12, 48, 336)) + " FROM readings")
def _(t):
    return history.add_history(t.readings, KEY, "demand_kwh", [6, 12, 48, 336], [])


@query("win_ema", ID + " ema_6:5 ema_24:5 ema_48:5", """WITH RECURSIVE o AS MATERIALIZED (
    SELECT meter_id, ts, demand_kwh, row_number() OVER (PARTITION BY meter_id ORDER BY ts) AS rn FROM readings),
    e AS (SELECT meter_id, rn, demand_kwh AS a, demand_kwh AS b, demand_kwh AS c FROM o WHERE rn = 1
    UNION ALL SELECT o.meter_id, o.rn, o.demand_kwh * 2.0 / 7.0 + e.a * 5.0 / 7.0, o.demand_kwh * 2.0 / 25.0 + e.b * 23.0 / 25.0,
    o.demand_kwh * 2.0 / 49.0 + e.c * 47.0 / 49.0 FROM e JOIN o ON o.meter_id = e.meter_id AND o.rn = e.rn + 1)
    SELECT o.meter_id, o.ts, o.demand_kwh, e.a AS ema_6, e.b AS ema_24, e.c AS ema_48 FROM o LEFT JOIN e ON e.meter_id = o.meter_id AND e.rn = o.rn - 1""")
def _(t):
    return history.add_history(t.readings, KEY, "demand_kwh", [], [6, 24, 48])


@query("win_persistence", ID + " persistence_24h:4 persistence_168h:4 persist_ratio_24_168:5", f"""SELECT *, CASE WHEN persistence_168h IS NOT NULL THEN persistence_24h / greatest(persistence_168h, 1.0) END AS persist_ratio_24_168 FROM (
    SELECT meter_id, ts, demand_kwh, lag(demand_kwh, 24) {W} AS persistence_24h, lag(demand_kwh, 168) {W} AS persistence_168h FROM grid)""")
def _(t):
    return features.add_persistence(t.grid, KEY, "demand_kwh", 24, 168)


SIM = "OVER (PARTITION BY meter_id, hour(ts), isodow(ts) ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("win_similar_day", ID + " similar_day_k5:5 sdh_mean_60d:5 sdh_std_60d:5 sdh_deviation:5", f"""SELECT *, prior - sdh_mean_60d AS sdh_deviation FROM (
    SELECT meter_id, ts, demand_kwh, lag(demand_kwh) {W} AS prior,
    CASE WHEN count(demand_kwh) {SIM.format(n=5)} >= 2 THEN avg(demand_kwh) {SIM.format(n=5)} END AS similar_day_k5,
    CASE WHEN count(demand_kwh) {SIM.format(n=9)} >= 2 THEN avg(demand_kwh) {SIM.format(n=9)} END AS sdh_mean_60d,
    CASE WHEN count(demand_kwh) {SIM.format(n=9)} >= 2 THEN stddev_samp(demand_kwh) {SIM.format(n=9)} END AS sdh_std_60d FROM grid)""")
def _(t):
    return features.add_similar_day(t.grid, KEY, "demand_kwh")


@query("win_expanding_hour", ID + " deviation_from_hourly:5", f"""SELECT meter_id, ts, demand_kwh, lag(demand_kwh) {W} -
    CASE WHEN count(demand_kwh) OVER h >= 8 THEN avg(demand_kwh) OVER h END AS deviation_from_hourly FROM grid
    WINDOW h AS (PARTITION BY meter_id, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    return features.add_slot_deviation(t.grid, KEY, "demand_kwh", min_periods=8)


@query("win_variability", ID + " rstd_ratio_48_336:5 rmean_ratio_12_336:5 cv_48:5", f"""SELECT meter_id, ts, demand_kwh,
    stddev_samp(demand_kwh) {prev(48)} / greatest(stddev_samp(demand_kwh) {prev(336)}, 1.0) AS rstd_ratio_48_336,
    avg(demand_kwh) {prev(12)} / greatest(avg(demand_kwh) {prev(336)}, 1.0) AS rmean_ratio_12_336,
    stddev_samp(demand_kwh) {prev(48)} / greatest(avg(demand_kwh) {prev(48)}, 1.0) AS cv_48 FROM readings""")
def _(t):
    n = [12, 48, 336]
    return features.add_variability(frames.with_rolling_moments(t.readings, KEY, "demand_kwh", n, {i: (f"rmean_{i}", f"rstd_{i}") for i in n}))


WXID = "location_id:s ts:t"
LW = "OVER (PARTITION BY location_id ORDER BY ts)"


def lprev(n):
    return f"OVER (PARTITION BY location_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def lincl(n):
    return f"OVER (PARTITION BY location_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


HEAT_SQL = "temperature + 0.33 * (humidity / 100.0 * 6.105 * exp(17.27 * temperature / (237.7 + temperature))) - 4.0"


@query("win_weather_deriv", WXID + " pressure_delta_3h:4 temp_delta_3h:4 temp_rmean_6h:5 ghi_rmean_6h:5 cloud_delta_3h:4 is_raining:i diffuse_fraction:5 heat_index:5", f"""SELECT location_id, ts,
    pressure - lag(pressure, 6) {LW} AS pressure_delta_3h, temperature - lag(temperature, 6) {LW} AS temp_delta_3h, avg(temperature) {lincl(12)} AS temp_rmean_6h,
    avg(ghi) {lincl(12)} AS ghi_rmean_6h, cloud_cover - lag(cloud_cover, 6) {LW} AS cloud_delta_3h, (precipitation > 0)::INT AS is_raining,
    least(greatest(dhi / greatest(ghi, 1.0), 0.0), 1.0) AS diffuse_fraction, {HEAT_SQL} AS heat_index FROM weather""")
def _(t):
    return features.add_weather_derivatives(t.weather, ["location_id"])


@query("win_weather_anom", WXID + " temp_anom_24h:5 hum_anom_24h:5 ghi_anom_24h:5 cloud_anom_24h:5", "SELECT location_id, ts, " + ", ".join(
    f"{c} - CASE WHEN count({c}) {lprev(48)} >= 12 THEN avg({c}) {lprev(48)} END AS {n}_anom_24h" for c, n in (("temperature", "temp"), ("humidity", "hum"), ("ghi", "ghi"), ("cloud_cover", "cloud"))) + " FROM weather")
def _(t):
    return features.add_weather_anomalies(t.weather, ["location_id"])


@query("win_cdd_accum", WXID + " cdd_21:4 cdd_21_rmean_48:5 cdd_21_rmean_336:5", f"""SELECT location_id, ts, cdd_21, CASE WHEN count(*) {lprev(48)} >= 6 THEN avg(cdd_21) {lprev(48)} END AS cdd_21_rmean_48,
    CASE WHEN count(*) {lprev(336)} >= 48 THEN avg(cdd_21) {lprev(336)} END AS cdd_21_rmean_336 FROM (SELECT *, greatest(temperature - 21.0, 0.0) AS cdd_21 FROM weather)""")
def _(t):
    return features.add_cooling_history(t.weather, ["location_id"])


@query("win_voltage", ID + " voltage_lag1:4 voltage_rstd_6:5 voltage_rmean_48:5", f"""SELECT meter_id, ts, demand_kwh, lag(voltage) {W} AS voltage_lag1,
    stddev_samp(voltage) {prev(6)} AS voltage_rstd_6, avg(voltage) {prev(48)} AS voltage_rmean_48 FROM readings""")
def _(t):
    return features.add_voltage_history(t.readings, KEY)


@query("win_weather_lag", WXID + " temperature_lag24:4 humidity_lag24:4 cloud_cover_lag24:4", "SELECT location_id, ts, " + ", ".join(
    f"lag({c}, 48) {LW} AS {c}_lag24" for c in ("temperature", "humidity", "cloud_cover")) + " FROM weather")
def _(t):
    w = ordered(["location_id"])
    return t.weather.withColumns({f"{c}_lag24": F.lag(c, 48).over(w) for c in ("temperature", "humidity", "cloud_cover")})


@query("win_hourly_weather", WXID + " temp_delta_1h:4 temp_delta_3h:4 temp_rmean_6h:5 temp_rmean_24h:5 temp_rmax_24h:4 pressure_delta_3h:4 ghi_rmean_3h:5 ghi_rstd_3h:5 ghi_rmean_6h:5 ghi_lag_1h:4 ghi_lag_24h:4 pm25_rmean_24h:5 pm25_rmean_72h:5 aod_rmean_24h:5",
       f"""SELECT location_id, ts, temperature - lag(temperature, 1) {LW} AS temp_delta_1h, temperature - lag(temperature, 3) {LW} AS temp_delta_3h, avg(temperature) {lincl(6)} AS temp_rmean_6h,
    avg(temperature) {lincl(24)} AS temp_rmean_24h, max(temperature) {lincl(24)} AS temp_rmax_24h, pressure - lag(pressure, 3) {LW} AS pressure_delta_3h, avg(ghi) {lincl(3)} AS ghi_rmean_3h,
    coalesce(stddev_samp(ghi) {lincl(3)}, 0.0) AS ghi_rstd_3h, avg(ghi) {lincl(6)} AS ghi_rmean_6h, lag(ghi, 1) {LW} AS ghi_lag_1h, lag(ghi, 24) {LW} AS ghi_lag_24h,
    avg(pm2_5) {lincl(24)} AS pm25_rmean_24h, avg(pm2_5) {lincl(72)} AS pm25_rmean_72h, avg(aod) {lincl(24)} AS aod_rmean_24h FROM weather""")
def _(t):
    return features.add_hourly_weather_windows(t.weather, ["location_id"])


@query("win_group_transform", ID + " daily_range_ratio:5 hourly_share:5 deviation_from_typical:5", """SELECT meter_id, ts, demand_kwh, CASE WHEN max(demand_kwh) OVER d > 0 THEN (max(demand_kwh) OVER d - min(demand_kwh) OVER d) / max(demand_kwh) OVER d ELSE 0 END AS daily_range_ratio,
    CASE WHEN sum(demand_kwh) OVER d > 0 THEN demand_kwh / sum(demand_kwh) OVER d ELSE 0 END AS hourly_share,
    CASE WHEN stddev_samp(demand_kwh) OVER h > 0 THEN (demand_kwh - avg(demand_kwh) OVER h) / stddev_samp(demand_kwh) OVER h ELSE 0 END AS deviation_from_typical
    FROM readings WINDOW d AS (PARTITION BY meter_id, date_trunc('day', ts)), h AS (PARTITION BY meter_id, hour(ts))""")
def _(t):
    return features.add_consumption_shape(t.readings, KEY, "demand_kwh")


@query("win_price_above_mean", "month:i hour:i price:2 price_above_mean:i", "SELECT *, (CAST(price AS DECIMAL(18, 2)) * count(price) OVER (PARTITION BY month) > sum(CAST(price AS DECIMAL(18, 2))) OVER (PARTITION BY month))::INT AS price_above_mean FROM prices")
def _(t):
    return t.prices.withColumn("price_above_mean", features.above_mean("price", ["month"]))


@query("win_price_percentile", "month:i hour:i price:2 price_percentile:6", "SELECT *, (rank() OVER (PARTITION BY month ORDER BY price) - 1) / count(*) OVER (PARTITION BY month) AS price_percentile FROM prices")
def _(t):
    return price_percentile(t.prices)


@query("win_frozen", "meter_id:s ts:t level:2 is_frozen:b", f"""WITH b AS (SELECT meter_id, ts, floor(demand_kwh / 60) AS level FROM readings),
    s AS (SELECT *, coalesce(level = lag(level) {W}, false) AS same FROM b),
    r AS (SELECT *, sum((NOT same)::INT) {W} AS run FROM s)
    SELECT meter_id, ts, level, same AND sum(same::INT) OVER (PARTITION BY meter_id, run) >= 3 AS is_frozen FROM r""")
def _(t):
    return detectors.frozen(t.readings.withColumn("level", F.floor(F.col("demand_kwh") / 60)), KEY, "level")


@query("win_outlier_zscore", ID + " is_zscore_outlier:b", """SELECT meter_id, ts, demand_kwh, coalesce(count(demand_kwh) OVER k >= 3 AND abs(demand_kwh - avg(demand_kwh) OVER k) / nullif(stddev_pop(demand_kwh) OVER k, 0) > 3, false) AS is_zscore_outlier
    FROM readings WINDOW k AS (PARTITION BY meter_id)""")
def _(t):
    return detectors.global_z(t.readings, KEY, "demand_kwh")


@query("win_outlier_iqr", ID + " is_iqr_outlier:b", """SELECT r.meter_id, ts, demand_kwh, n >= 4 AND (demand_kwh < q1 - 1.5 * (q3 - q1) OR demand_kwh > q3 + 1.5 * (q3 - q1)) AS is_iqr_outlier FROM readings r JOIN (
    SELECT meter_id, count(*) AS n, quantile_cont(demand_kwh, 0.25) AS q1, quantile_cont(demand_kwh, 0.75) AS q3 FROM readings GROUP BY 1) USING (meter_id)""")
def _(t):
    return detectors.iqr(t.readings, KEY, "demand_kwh")


@query("win_outlier_contextual", ID + " by_hour:b by_hour_weekday:b", """SELECT meter_id, ts, demand_kwh,
    coalesce(count(demand_kwh) OVER h >= 5 AND stddev_samp(demand_kwh) OVER h > 0 AND abs(demand_kwh - avg(demand_kwh) OVER h) / nullif(stddev_samp(demand_kwh) OVER h, 0) > 2, false) AS by_hour,
    coalesce(count(demand_kwh) OVER d >= 3 AND stddev_samp(demand_kwh) OVER d > 0 AND abs(demand_kwh - avg(demand_kwh) OVER d) / nullif(stddev_samp(demand_kwh) OVER d, 0) > 1, false) AS by_hour_weekday
    FROM grid WINDOW h AS (PARTITION BY meter_id, hour(ts)), d AS (PARTITION BY meter_id, hour(ts), isodow(ts))""")
def _(t):
    df = detectors.contextual(t.grid, KEY, "demand_kwh", threshold=2.0, out="by_hour")
    return detectors.contextual(df, KEY, "demand_kwh", threshold=1.0, by_weekday=True, min_group=3, out="by_hour_weekday")


CENTRED = "OVER (PARTITION BY meter_id ORDER BY ts RANGE BETWEEN INTERVAL '1439 minutes' PRECEDING AND INTERVAL '24 hours' FOLLOWING)"
TRAIL = "OVER (PARTITION BY meter_id ORDER BY ts RANGE BETWEEN INTERVAL '2879 minutes' PRECEDING AND CURRENT ROW)"
SHORT = "OVER (PARTITION BY meter_id ORDER BY ts RANGE BETWEEN INTERVAL '149 minutes' PRECEDING AND INTERVAL '150 minutes' FOLLOWING)"


@query("win_outlier_rolling", ID + " is_rolling_outlier:b", f"""SELECT meter_id, ts, demand_kwh, coalesce(count(demand_kwh) {CENTRED} >= 10 AND
    abs(demand_kwh - median(demand_kwh) {CENTRED}) / nullif(stddev_samp(demand_kwh) {CENTRED}, 0) > 3, false) AS is_rolling_outlier FROM grid""")
def _(t):
    return by_week(t.grid, lambda d, k: detectors.rolling(d, k, "demand_kwh"), before=24, after=24)


BASE_SQL = f"""SELECT *, CASE WHEN count(kva) {TRAIL} >= 10 THEN median(kva) {TRAIL} END AS kva_base, CASE WHEN count(kva) {TRAIL} >= 10 THEN stddev_samp(kva) {TRAIL} END AS kva_sigma,
    CASE WHEN count(kw) {TRAIL} >= 10 THEN stddev_samp(kw) {TRAIL} END AS kw_sigma,
    CASE WHEN count(kva) {SHORT} >= 3 THEN median(kva) {SHORT} END AS kva_local, CASE WHEN count(kw) {SHORT} >= 3 THEN median(kw) {SHORT} END AS kw_local FROM channels"""
ART_SQL = f"""SELECT *, coalesce(abs(kva - kva_base) / nullif(kva_sigma, 0) > 2 AND (frequency < 49.5 OR frequency > 50.5), false) AS is_ct_artefact,
    coalesce(abs(kva - kva_base) / nullif(kva_sigma, 0) > 4, false) AS no_freq,
    coalesce(abs(kva - kva_local) / nullif(kva_sigma, 0) > 1 AND abs(kw - kw_local) / nullif(kw_sigma, 0) < 1, false) AS is_pf_artefact FROM ({BASE_SQL})"""


@query("win_ct_artefact", "meter_id:s ts:t kva_base:5 kva_sigma:5 is_ct_artefact:b no_freq:b", ART_SQL)
def _(t):
    def both_rules(d, k):
        d = events.ct_artefacts(d, k, sigma=2.0).withColumnRenamed("is_ct_artefact", "with_freq")
        return events.ct_artefacts(d, k, sigma=3.0, frequency=None).withColumnsRenamed({"is_ct_artefact": "no_freq", "with_freq": "is_ct_artefact"})

    return by_week(t.channels, both_rules, before=48, after=0)


@query("win_pf_artefact", "meter_id:s ts:t kva_local:5 is_pf_artefact:b", ART_SQL)
def _(t):
    return by_week(t.channels, lambda d, k: events.pf_artefacts(d, k, sigma=1.0, short_us=5 * MICROS["hour"]), before=48, after=3)


@query("win_clean_signal", "meter_id:s ts:t is_artefact:b kva_clean:4", f"""WITH a AS ({ART_SQL.replace('nullif(kva_sigma, 0) > 2', 'nullif(kva_sigma, 0) > 1')}),
    b AS (SELECT *, is_ct_artefact OR is_pf_artefact AS is_artefact, CASE WHEN is_ct_artefact OR is_pf_artefact THEN kva_local ELSE kva END AS c FROM a)
    SELECT meter_id, ts, is_artefact, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(c IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kva_clean FROM b""")
def _(t):
    return events.clean_signal(t.channels, KEY, sigma=1.0, short_us=5 * MICROS["hour"])


DG_SQL = f"""SELECT c.*, coalesce(grid_import / nullif(CASE WHEN count(grid_import) {TRAIL} >= 10 THEN greatest(median(grid_import) {TRAIL}, p10) END, 0) < 0.05, false) AS is_dg,
    coalesce(kw / nullif(CASE WHEN count(kw) {TRAIL} >= 10 THEN greatest(median(kw) {TRAIL}, w10) END, 0) > 0.5, false) AS load_on,
    coalesce(CASE WHEN count(voltage) {SHORT} >= 3 THEN stddev_samp(voltage) {SHORT} / avg(voltage) {SHORT} END > 0.05, false) AS is_dg_voltage
    FROM channels c JOIN (SELECT meter_id AS m, quantile_cont(grid_import, 0.1) AS p10, quantile_cont(kw, 0.1) AS w10 FROM channels GROUP BY 1) ON m = meter_id"""


@query("win_dg_detect", "meter_id:s ts:t is_dg:b confirmed:b", f"SELECT *, is_dg AND load_on AS confirmed FROM ({DG_SQL})")
def _(t):
    df = events.generator_on(t.channels, KEY, site_load="kw").withColumnRenamed("is_dg", "confirmed")
    return events.generator_on(df, KEY)


@query("win_dg_voltage", "meter_id:s ts:t is_dg_voltage:b", DG_SQL)
def _(t):
    return by_week(t.channels, lambda d, k: events.voltage_signature(d, k, width_us=5 * MICROS["hour"]), before=3, after=3)


PERIOD_SQL = f"""WITH d AS ({DG_SQL}), w AS (SELECT *, lag(is_dg) {W} AS was FROM d)
    SELECT *, CASE WHEN NOT is_dg THEN 'none' WHEN is_dg_voltage THEN 'high' ELSE 'medium' END AS dg_confidence,
    CASE WHEN is_dg AND NOT was THEN 'grid_to_dg' WHEN NOT is_dg AND was THEN 'dg_to_grid' WHEN is_dg THEN 'dg_running' END AS dg_event_type,
    CASE WHEN is_dg THEN sum((coalesce(is_dg AND NOT was, false))::INT) {W} ELSE -1 END AS dg_period_id FROM w"""


def generator_table(t):
    df = events.voltage_signature(events.generator_on(t.channels, KEY), KEY, width_us=5 * MICROS["hour"])
    return events.generator_periods(df, KEY)


@query("win_dg_periods", "meter_id:s ts:t is_dg:b dg_confidence:s dg_event_type:s dg_period_id:i", PERIOD_SQL)
def _(t):
    return generator_table(t)


@query("flt_exclude_dg", "meter_id:s ts:t kw:4", f"SELECT meter_id, ts, kw FROM ({DG_SQL}) WHERE NOT is_dg")
def _(t):
    return events.generator_on(t.channels, KEY).filter("not is_dg")


APFC_SQL = f"""WITH a AS (SELECT *, abs(kva - lag(kva) {W}) AS dkva, abs(kw - lag(kw) {W}) AS dkw, lag(pf) {W} AS ppf, lag(kva) {W} AS pkva, lag(kw) {W} AS pkw,
    CASE WHEN count(kw) {TRAIL} >= 10 THEN stddev_samp(kw) {TRAIL} END AS sd FROM channels),
    b AS (SELECT *, coalesce(dkva > 20 AND dkw / nullif(sd, 0) < 1 AND ppf < 0.95 AND pf - ppf > 0.02, false) AS si,
    coalesce(dkva > 20 AND dkw / nullif(sd, 0) < 1 AND ppf BETWEEN 0.95 AND 1.0 AND pf - ppf < -0.02, false) AS so FROM a)
    SELECT *, si OR so AS is_apfc_event, CASE WHEN si THEN 'cap_switch_in' WHEN so THEN 'cap_switch_out' END AS apfc_event_type,
    CASE WHEN si OR so THEN dkva ELSE 0 END AS kva_step_magnitude, CASE WHEN (si OR so) AND pkva > 0 AND pkw / nullif(pkva, 0) > 0 THEN kw / (pkw / pkva) ELSE kva END AS kva_normalised FROM b"""


@query("win_apfc", "meter_id:s ts:t is_apfc_event:b apfc_event_type:s kva_step_magnitude:4", APFC_SQL)
def _(t):
    return events.capacitor_events(t.channels, KEY, kva_step=20.0)


@query("win_apfc_normalise", "meter_id:s ts:t kva_normalised:4", APFC_SQL)
def _(t):
    return events.normalise_capacitor(events.capacitor_events(t.channels, KEY, kva_step=20.0), KEY)


def fill_sql(src, value, tag):
    back = "OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for name, e in (("v", value), ("t", f"CASE WHEN {value} IS NOT NULL THEN epoch_us(ts) END"), ("r", f"CASE WHEN {value} IS NOT NULL THEN rn END")):
        parts += [f"last_value({e} IGNORE NULLS) {back} AS p{name}{tag}", f"first_value({e} IGNORE NULLS) {ahead} AS n{name}{tag}"]
    return f"SELECT *, {', '.join(parts)} FROM {src}"


def line_sql(value, tag):
    return f"""CASE WHEN {value} IS NOT NULL THEN {value} WHEN pv{tag} IS NOT NULL AND nv{tag} IS NULL THEN pv{tag}
        WHEN pv{tag} IS NOT NULL THEN pv{tag} + (nv{tag} - pv{tag}) * ((epoch_us(ts) - pt{tag}) / nullif(nt{tag} - pt{tag}, 0)) END"""


IMPUTE_SQL = f"""WITH z AS (SELECT *, CASE WHEN demand_kwh <= 150 THEN demand_kwh END AS v0, row_number() {W} AS rn, count(*) OVER (PARTITION BY meter_id) AS len FROM grid),
    a AS ({fill_sql('z', 'v0', 'a')}),
    b AS (SELECT *, CASE WHEN v0 IS NOT NULL OR coalesce(nra, len + 1) - coalesce(pra, 0) - 1 < 4 THEN {line_sql('v0', 'a')} END AS v1 FROM a),
    c AS (SELECT *, coalesce(v1, lag(v1, 168) {W}) AS v2, coalesce(v0, lag(v0, 168) {W}) AS s2 FROM b),
    d AS ({fill_sql('c', 'v2', 'b')}), e AS ({fill_sql('d', 's2', 'c')}),
    f AS (SELECT *, CASE WHEN v2 IS NOT NULL OR rn - coalesce(prb, 0) <= 6 THEN {line_sql('v2', 'b')} END AS hybrid,
    CASE WHEN s2 IS NOT NULL OR rn - coalesce(prc, 0) <= 6 THEN {line_sql('s2', 'c')} END AS seasonal,
    CASE WHEN v0 IS NOT NULL OR rn - coalesce(pra, 0) <= 6 THEN {line_sql('v0', 'a')} END AS i1 FROM e),
    g AS ({fill_sql('f', 'i1', 'd')}), h AS (SELECT *, CASE WHEN i1 IS NOT NULL OR rn - coalesce(prd, 0) <= 3 THEN coalesce(i1, pvd) END AS i2 FROM g),
    k AS ({fill_sql('h', 'i2', 'e')}) SELECT *, coalesce(i2, CASE WHEN nre - rn <= 3 THEN nve END) AS interpolated FROM k"""


@query("win_impute", ID + " hybrid:5 seasonal:5 interpolated:5", IMPUTE_SQL)
def _(t):
    df = t.grid.withColumn("bad", F.col("demand_kwh") > 150)
    for method, name in (("hybrid", "hybrid"), ("seasonal", "seasonal"), ("interpolate", "interpolated")):
        df = impute.impute(df, KEY, "demand_kwh", "bad", method, rows_per_week=168, out=name)
    return df


@query("win_ffill_bfill", ID + " filled:4", """SELECT meter_id, ts, demand_kwh, coalesce(last_value(demand_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(demand_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM grid""")
def _(t):
    return t.grid.withColumn("filled", frames.fill_both("demand_kwh", KEY))


@query("win_cadence_detect", "meter_id:s median_min:4 cadence_min:i", f"""SELECT *, CASE WHEN abs(median_min - 30) < 1 THEN 30 WHEN abs(median_min - 15) < 1 THEN 15 END AS cadence_min FROM (
    SELECT meter_id, median(d) AS median_min FROM (SELECT meter_id, epoch_us(ts - lag(ts) {W}) / 60000000.0 AS d FROM grid) WHERE d IS NOT NULL GROUP BY 1)""")
def _(t):
    return features.detect_cadence(t.grid, KEY)
