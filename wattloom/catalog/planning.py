"""Feature tables, the quality run, splits, forecasts and evaluations."""

from pyspark.sql import Window, functions as F

from wattloom.catalog import windows as win
from wattloom.catalog.joins import PROFILE_SQL, both, sparse_weather
from wattloom.catalog.registry import query
from wattloom.catalog.views import LOCATION, located, weather_at
from wattloom.catalog.scalars import HI, HOL, TEMPORAL
from wattloom.functions import calendar as cal
from wattloom.operators import accuracy, load
from wattloom.plans import evaluation, features, forecasts, quality, splits

KEY = ["meter_id"]
ID = "meter_id:s ts:t demand_kwh:4"
PLACE = ["location_id"]
W = "OVER (PARTITION BY meter_id ORDER BY ts)"
prev, incl = win.prev, win.incl


def dense(t):
    extra = t.channels.select("meter_id", "ts", "kva", "kw", "pf", "voltage", "frequency", "grid_import")
    return t.grid.join(extra, ["meter_id", "ts"], "left")


def cleaned(t):
    return quality.clean_meters(dense(t), KEY, rows_per_week=168)


def on_dense(sql):
    return sql.replace("FROM channels", "FROM dense")


FLAG_SQL = f"""WITH dense AS MATERIALIZED (SELECT g.meter_id, g.ts, g.demand_kwh, kva, kw, pf, voltage, frequency, grid_import FROM grid g LEFT JOIN channels c ON c.meter_id = g.meter_id AND c.ts = g.ts),
    a AS (SELECT *, coalesce(demand_kwh = lag(demand_kwh) {W}, false) AS same FROM dense),
    b AS (SELECT *, sum((NOT same)::INT) {W} AS run FROM a),
    q AS (SELECT meter_id AS m, count(demand_kwh) AS n, avg(demand_kwh) AS mu, stddev_pop(demand_kwh) AS sp, quantile_cont(demand_kwh, 0.25) AS q1, quantile_cont(demand_kwh, 0.75) AS q3 FROM dense GROUP BY 1),
    c AS (SELECT b.*, same AND sum(same::INT) OVER (PARTITION BY meter_id, run) >= 3 AS is_frozen, coalesce(n >= 3 AND abs(demand_kwh - mu) / nullif(sp, 0) > 3, false) AS is_zscore_outlier,
        coalesce(n >= 4 AND (demand_kwh < q1 - 1.5 * (q3 - q1) OR demand_kwh > q3 + 1.5 * (q3 - q1)), false) AS is_iqr_outlier,
        coalesce(count(demand_kwh) OVER h >= 5 AND stddev_samp(demand_kwh) OVER h > 0 AND abs(demand_kwh - avg(demand_kwh) OVER h) / nullif(stddev_samp(demand_kwh) OVER h, 0) > 3, false) AS is_contextual_outlier,
        coalesce(count(demand_kwh) {win.CENTRED} >= 10 AND abs(demand_kwh - median(demand_kwh) {win.CENTRED}) / nullif(stddev_samp(demand_kwh) {win.CENTRED}, 0) > 3, false) AS is_rolling_outlier,
        coalesce(count(kva) {win.TRAIL} >= 10 AND abs(kva - median(kva) {win.TRAIL}) / nullif(stddev_samp(kva) {win.TRAIL}, 0) > 3 AND (frequency < 49.5 OR frequency > 50.5), false) AS is_ct_artefact
        FROM b JOIN q ON m = meter_id WINDOW h AS (PARTITION BY meter_id, hour(ts))),
    d AS (SELECT *, is_frozen OR is_zscore_outlier OR is_iqr_outlier OR is_contextual_outlier OR is_rolling_outlier OR is_ct_artefact AS is_anomaly FROM c),
    z AS (SELECT *, CASE WHEN NOT is_anomaly THEN demand_kwh END AS v0, row_number() {W} AS rn, count(*) OVER (PARTITION BY meter_id) AS len FROM d),
    za AS ({win.fill_sql('z', 'v0', 'a')}), zb AS (SELECT *, CASE WHEN v0 IS NOT NULL OR coalesce(nra, len + 1) - coalesce(pra, 0) - 1 < 4 THEN {win.line_sql('v0', 'a')} END AS v1 FROM za),
    zc AS (SELECT *, coalesce(v1, lag(v1, 168) {W}) AS v2 FROM zb), zd AS ({win.fill_sql('zc', 'v2', 'b')}),
    e AS (SELECT *, is_anomaly OR demand_kwh IS NULL AS is_imputed, CASE WHEN v2 IS NOT NULL OR rn - coalesce(prb, 0) <= 6 THEN {win.line_sql('v2', 'b')} END AS demand_kwh_clean,
        0.4 * ((kw IS NOT NULL)::INT + (kva IS NOT NULL)::INT + (voltage IS NOT NULL)::INT + (pf IS NOT NULL)::INT) / 4.0 + 0.6 AS quality_score FROM zd)
    SELECT * FROM e"""


@query("pipe_quality", ID + " is_frozen:b is_zscore_outlier:b is_iqr_outlier:b is_contextual_outlier:b is_rolling_outlier:b is_ct_artefact:b is_anomaly:b is_imputed:b demand_kwh_clean:4 quality_score:5", FLAG_SQL)
def _(t):
    return cleaned(t)


@query("agg_quality_report", "meter_id:s total_intervals:i missing_pct:4 frozen_pct:4 zscore_outlier_pct:4 iqr_outlier_pct:4 contextual_outlier_pct:4 rolling_outlier_pct:4 ct_artefact_pct:4 total_anomaly_pct:4 imputed_pct:4 dg_period_pct:4 apfc_event_count:i mean_quality_score:5", f"""SELECT x.*, dg_period_pct, apfc_event_count FROM (SELECT meter_id, count(*) AS total_intervals,
    avg((demand_kwh IS NULL)::INT) * 100 AS missing_pct, avg(is_frozen::INT) * 100 AS frozen_pct, avg(is_zscore_outlier::INT) * 100 AS zscore_outlier_pct, avg(is_iqr_outlier::INT) * 100 AS iqr_outlier_pct, avg(is_contextual_outlier::INT) * 100 AS contextual_outlier_pct,
    avg(is_rolling_outlier::INT) * 100 AS rolling_outlier_pct, avg(is_ct_artefact::INT) * 100 AS ct_artefact_pct, avg(is_anomaly::INT) * 100 AS total_anomaly_pct, avg(is_imputed::INT) * 100 AS imputed_pct, avg(quality_score) AS mean_quality_score FROM ({FLAG_SQL}) GROUP BY 1) x
    JOIN (SELECT meter_id, 100.0 * sum(is_dg::INT) / any_value(n) AS dg_period_pct FROM ({win.DG_SQL}) JOIN (SELECT meter_id AS g, count(*) AS n FROM grid GROUP BY 1) ON g = meter_id GROUP BY 1) y ON y.meter_id = x.meter_id
    JOIN (SELECT meter_id, count(*) FILTER (is_apfc_event) AS apfc_event_count FROM (WITH dense AS (SELECT g.meter_id, g.ts, kva, kw, pf FROM grid g LEFT JOIN channels c ON c.meter_id = g.meter_id AND c.ts = g.ts) {on_dense(win.APFC_SQL).replace('dkva > 20', 'dkva > 50').replace('WITH a AS', 'SELECT * FROM (WITH a AS', 1)})) GROUP BY 1) v ON v.meter_id = x.meter_id""")
def _(t):
    return quality.quality_report(cleaned(t), KEY)


LAGS = [1, 2, 4, 6, 12, 24, 48, 96, 336]
WX = features.WEATHER_COLUMNS
CYCLES = [(f"{n}_{f}", f"{f}(2.0 * pi() * ({e}) / {p})") for n, e, p in (("hour", "hour(ts) + minute(ts) / 60.0", "24.0"), ("dow", "isodow(ts) - 1", "7.0"), ("month", "month(ts)", "12.0"), ("doy", "dayofyear(ts) + hour(ts) / 24.0", "365.25")) for f in ("sin", "cos")]
NEAR = " OR ".join(HOL.replace("ts", f"(ts + to_days({d}))") for d in (-1, 0, 1))
HOURLY = "OVER (PARTITION BY meter_id, hour(ts) + minute(ts) / 60.0 ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
# Column, decimals and SQL of everything that the slot tables add to a reading, in steps that build on one another.
SLOT_STEPS = [
    [*[(c, 5, e) for c, e in CYCLES], ("hour", 4, "hour(ts) + minute(ts) / 60.0"), ("dow", "i", "isodow(ts) - 1"), ("month", "i", "month(ts)"), ("is_weekend", "i", "(isodow(ts) >= 6)::INT"), ("is_holiday", "i", f"({HOL})::INT"), ("near_holiday", "i", f"({NEAR})::INT"),
     ("tod_multiplier", 2, "CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1.2 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 0.9 ELSE 1.0 END"), ("is_peak", "i", "(hour(ts) BETWEEN 18 AND 21)::INT"),
     *[(f"lag_{n}", 5, f"lag(demand_kwh, {n}) {W}") for n in LAGS], *[(f"rmean_{n}", 5, f"avg(demand_kwh) {prev(n)}") for n in (6, 12, 48, 336)], *[(f"rstd_{n}", 4, f"stddev_samp(demand_kwh) {prev(n)}") for n in (6, 12, 48, 336)],
     *[(f"rmean_{d}d", 5, f"CASE WHEN count(demand_kwh) {prev(n)} >= 48 THEN avg(demand_kwh) {prev(n)} END") for d, n in ((14, 672), (30, 1440))],
     ("demand_diff_1", 5, f"lag(demand_kwh) {W} - lag(demand_kwh, 2) {W}"), ("demand_diff_4", 5, f"lag(demand_kwh) {W} - lag(demand_kwh, 5) {W}"),
     *[(c, "i" if c == "is_raining" else 5, both(c)) for c in WX], ("fleet_mean", 5, f"coalesce({both('fm')}, 0)"), ("fleet_std", 4, f"coalesce({both('fs')}, 0)"),
     ("voltage_lag1", 4, f"lag(voltage) {W}"), ("voltage_rstd_6", 4, f"stddev_samp(voltage) {prev(6)}"), ("voltage_rmean_48", 5, f"avg(voltage) {prev(48)}"),
     ("deviation_from_hourly", 5, f"lag(demand_kwh) {W} - CASE WHEN count(demand_kwh) {HOURLY} >= 2 THEN avg(demand_kwh) {HOURLY} END"),
     ("similar_day_k5", 5, f"CASE WHEN count(demand_kwh) {win.SIM.format(n=5)} >= 2 THEN avg(demand_kwh) {win.SIM.format(n=5)} END"), ("target", 5, "demand_kwh")],
    [("trend_ratio", 5, "CASE WHEN rmean_30d IS NOT NULL THEN rmean_14d / greatest(rmean_30d, 1.0) END"), ("cooling_deg", 5, "greatest(temperature - 25.0, 0.0)"), ("heating_deg", 5, "greatest(18.0 - temperature, 0.0)"), ("hdd_21", 5, "greatest(21.0 - temperature, 0.0)"),
     ("hour_x_temp", 5, "hour * temperature / 100.0"), ("peak_x_temp", 5, "(hour(ts) BETWEEN 12 AND 17)::INT * temperature"), ("cdd_21", 5, "greatest(temperature - 21.0, 0.0)"),
     *[(f"{n}_anom_24h", 5, f"{c} - CASE WHEN count({c}) {prev(48)} >= 12 THEN avg({c}) {prev(48)} END") for n, c in (("temp", "temperature"), ("hum", "humidity"), ("ghi", "ghi"), ("cloud", "cloud_cover"))],
     ("fleet_mean_lag1", 5, f"lag(fleet_mean) {W}"), ("fleet_std_lag1", 4, f"lag(fleet_std) {W}")],
    [*[(f"cdd_21_rmean_{n}", 5, f"CASE WHEN count(cdd_21) {prev(n)} >= {k} THEN avg(cdd_21) {prev(n)} END") for n, k in ((48, 6), (336, 48))], ("cdd_21_x_hour", 5, "cdd_21 * hour / 24.0"), ("cdd_21_x_peak", 5, "is_peak * cdd_21"), ("vs_fleet_ratio", 5, "CASE WHEN fleet_mean_lag1 IS NOT NULL THEN lag_1 / greatest(fleet_mean_lag1, 1.0) END")],
]


def enough(n, k, what):
    return f"CASE WHEN count(demand_kwh) {win.SIM.format(n=n)} >= {k} THEN {what}(demand_kwh) {win.SIM.format(n=n)} END"


LONG_STEPS = [
    [*[(f"rmedian_{n}", 5, f"median(demand_kwh) {prev(n)}") for n in (6, 12, 48, 336)], *[(f"ema_{n}", 5, c) for n, c in ((6, "a"), (24, "b"), (48, "c"))], ("persistence_24h", 5, f"lag(demand_kwh, 48) {W}"), ("persistence_168h", 5, f"lag(demand_kwh, 336) {W}"),
     ("sdh_mean_60d", 5, enough(9, 2, "avg")), ("sdh_std_60d", 4, enough(9, 2, "stddev_samp")), ("similar_day_k10", 5, enough(10, 3, "avg")), ("sdh_mean_90d", 5, enough(13, 3, "avg")),
     *[(f"{c}_lag24", 5, f"lag({c}, 48) {W}") for c in ("temperature", "humidity", "cloud_cover")],
     *[(n, 4, f"CASE WHEN {y} IS NOT NULL THEN {x} / greatest({y}, 1.0) ELSE {x} END") for n, x, y in (("rstd_ratio_48_336", "rstd_48", "rstd_336"), ("rmean_ratio_12_336", "rmean_12", "rmean_336"), ("cv_48", "rstd_48", "rmean_48"))]],
    [("persist_ratio_24_168", 5, "CASE WHEN persistence_168h IS NOT NULL THEN persistence_24h / greatest(persistence_168h, 1.0) END"), ("sdh_deviation", 5, f"lag(demand_kwh) {W} - sdh_mean_60d")],
]


def contract(steps):
    return "".join(f" {c}:{d}" for step in steps for c, d, _ in step)


def nested(rows, steps):
    """Each step as a select around the one before, so its columns may use all earlier ones; filled weather takes the place of the raw one."""
    for step in steps:
        old = [c for c, _, e in step if c in WX and e == both(c)]
        rows = f"(SELECT *{f' EXCLUDE ({", ".join(old)})' if old else ''}, {', '.join(f'{e} AS {c}' for c, _, e in step)} FROM {rows})"
    return rows


BASE_SQL = f"""f AS (SELECT ts, avg(demand_kwh) AS fm, stddev_samp(demand_kwh) AS fs FROM readings GROUP BY 1 HAVING count(demand_kwh) >= 5),
    wd AS (SELECT *, pressure - lag(pressure, 6) {win.LW} AS pressure_delta_3h, temperature - lag(temperature, 6) {win.LW} AS temp_delta_3h, avg(temperature) {win.lincl(12)} AS temp_rmean_6h, avg(ghi) {win.lincl(12)} AS ghi_rmean_6h, cloud_cover - lag(cloud_cover, 6) {win.LW} AS cloud_delta_3h,
        (precipitation > 0)::INT AS is_raining, least(greatest(dhi / greatest(ghi, 1.0), 0.0), 1.0) AS diffuse_fraction, {win.HEAT_SQL} AS heat_index FROM weather),
    k AS (SELECT r.*, fm, fs, {', '.join(WX)}, row_number() OVER (PARTITION BY r.meter_id ORDER BY r.ts) AS rn, count(*) OVER (PARTITION BY r.meter_id) AS len FROM readings r LEFT JOIN f ON f.ts = r.ts LEFT JOIN wd wx ON {weather_at('r')}),
    r AS MATERIALIZED (SELECT * FROM {nested('k', SLOT_STEPS)})"""
EMA_SQL = """e AS (SELECT meter_id, rn AS ern, demand_kwh AS a, demand_kwh AS b, demand_kwh AS c FROM r WHERE rn = 1
    UNION ALL SELECT r.meter_id, r.rn, r.demand_kwh * 2.0 / 7.0 + e.a * 5.0 / 7.0, r.demand_kwh * 2.0 / 25.0 + e.b * 23.0 / 25.0, r.demand_kwh * 2.0 / 49.0 + e.c * 47.0 / 49.0 FROM e JOIN r ON r.meter_id = e.meter_id AND r.rn = e.ern + 1)"""
SLOT_COLS = ID + contract(SLOT_STEPS)


def derived_weather(t):
    return features.add_weather_derivatives(t.weather, PLACE)


def slot_table(t, warmup=24):
    return features.slot_features(located(t.readings), derived_weather(t), features.fleet_aggregate(t.readings), KEY, warmup=warmup, min_hourly=2, place=PLACE)


@query("pipe_features_v4", SLOT_COLS, f"WITH {BASE_SQL} SELECT * FROM r WHERE rn > 24")
def _(t):
    return slot_table(t)


@query("pipe_features_v5", SLOT_COLS + contract(LONG_STEPS), f"WITH RECURSIVE {BASE_SQL}, {EMA_SQL}, x AS (SELECT r.*, a, b, c FROM r LEFT JOIN e ON e.meter_id = r.meter_id AND e.ern = r.rn - 1) SELECT * FROM {nested('x', LONG_STEPS)} WHERE rn > least(672, floor(len / 3))")
def _(t):
    return features.extended_features(located(t.readings), derived_weather(t), features.fleet_aggregate(t.readings), KEY, min_hourly=2, place=PLACE)


HOUR_LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
TEMPORAL_COLS = " hour:i day_of_week:i day_of_month:i month:i week_of_year:i day_of_year:i hour_frac:4 is_weekend:i is_holiday:i season:s tod_multiplier:2 is_working_day:i is_peak_hour:i is_business_hour:i"
# Column, decimals and SQL of what the hourly table takes from the weather of a location.
HOURLY_WEATHER = [
    [("wind_above_5ms", "i", "(wind_speed > 5)::INT"), ("cloud_fraction", 5, "cloud_cover / 100.0"), ("is_overcast", "i", "(cloud_cover > 80)::INT"), ("is_raining", "i", "(precipitation > 0.1)::INT"), ("is_heavy_rain", "i", "(precipitation > 5.0)::INT"),
     ("cdh", 5, "greatest(temperature - 26.0, 0.0)"), ("cdh_squared", 4, "greatest(temperature - 26.0, 0.0) * greatest(temperature - 26.0, 0.0)"), ("hdh", 5, "greatest(18.0 - temperature, 0.0)"), ("cooling_deg", 5, "greatest(temperature - 25.0, 0.0)"), ("heating_deg", 5, "greatest(18.0 - temperature, 0.0)"),
     ("cdd_21", 5, "greatest(temperature - 21.0, 0.0)"), ("hdd_21", 5, "greatest(21.0 - temperature, 0.0)"), ("is_extreme_heat", "i", "(temperature > 35)::INT"), ("rh_above_70", "i", "(humidity > 70)::INT"), ("heat_index", 4, HI), ("comfort_cdh", 4, f"greatest({HI} - 26.0, 0.0)"),
     ("temp_delta_1h", 5, f"temperature - lag(temperature, 1) {win.LW}"), ("temp_delta_3h", 5, f"temperature - lag(temperature, 3) {win.LW}"), ("temp_rmean_6h", 5, f"avg(temperature) {win.lincl(6)}"), ("temp_rmean_24h", 5, f"avg(temperature) {win.lincl(24)}"), ("temp_rmax_24h", 5, f"max(temperature) {win.lincl(24)}"),
     ("pressure_delta_3h", 5, f"pressure - lag(pressure, 3) {win.LW}"), ("ghi_rmean_3h", 5, f"avg(ghi) {win.lincl(3)}"), ("ghi_rstd_3h", 4, f"coalesce(stddev_samp(ghi) {win.lincl(3)}, 0.0)"), ("ghi_rmean_6h", 5, f"avg(ghi) {win.lincl(6)}"), ("ghi_lag_1h", 5, f"lag(ghi, 1) {win.LW}"), ("ghi_lag_24h", 5, f"lag(ghi, 24) {win.LW}"),
     ("pm25_rmean_24h", 5, f"avg(pm2_5) {win.lincl(24)}"), ("pm25_rmean_72h", 5, f"avg(pm2_5) {win.lincl(72)}"), ("aod_rmean_24h", 5, f"avg(aod) {win.lincl(24)}"),
     ("solar_producing", "i", "(ghi > 10)::INT"), ("solar_peak", "i", "(ghi > 500)::INT"), ("dni_ghi_ratio", 5, "CASE WHEN ghi > 10 THEN dni / ghi ELSE 0 END"), ("diffuse_fraction", 5, "least(greatest(CASE WHEN ghi > 10 THEN dhi / ghi ELSE 0 END, 0.0), 1.0)"),
     ("clearsky_ratio", 5, "least(greatest(CASE WHEN clear_sky > 10 THEN ghi / clear_sky ELSE 0 END, 0.0), 1.5)"), ("cloud_ghi_interaction", 4, "cloud_cover / 100.0 * ghi"), ("aqi_poor", "i", "(pm2_5 > 35)::INT"), ("aqi_very_poor", "i", "(pm2_5 > 75)::INT"), ("aod_high", "i", "(aod > 0.4)::INT"), ("dust_event", "i", "(dust > 50)::INT")],
    [("ghi_variability", 4, "CASE WHEN ghi_rmean_3h > 10 THEN ghi_rstd_3h / ghi_rmean_3h ELSE 0 END"), ("soiling_index", 5, "(pm25_rmean_72h / 100.0 + aod_rmean_24h + dust / 200.0) / 3.0")],
]
WEATHER_BASE = ["temperature", "humidity", "pressure", "cloud_cover", "precipitation", "wind_speed", "pm2_5", "aod", "dust", "ghi", "dni", "dhi", "clear_sky"]
# Column, decimals and SQL of what it adds to a reading itself.
HOURLY_LOAD = [[
    *[(c, 5, e) for c, e in CYCLES], *[(f"demand_kwh_lag_{n}h", 5, f"lag(demand_kwh, {n}) {W}") for n in HOUR_LAGS],
    *[(f"demand_kwh_{short}_{n}", 4 if short == "rstd" else 5, f"{what}(demand_kwh) {incl(n)}") for n in (3, 6, 12, 24, 48, 168) for short, what in (("rmean", "avg"), ("rstd", "stddev_samp"), ("rmin", "min"), ("rmax", "max"))],
    ("daily_range_ratio", 5, "CASE WHEN max(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts)) > 0 THEN (max(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts)) - min(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts))) / max(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts)) ELSE 0 END"),
    ("hourly_share", 5, "CASE WHEN sum(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts)) > 0 THEN demand_kwh / sum(demand_kwh) OVER (PARTITION BY meter_id, date_trunc('day', ts)) ELSE 0 END"),
    ("deviation_from_typical", 4, "CASE WHEN stddev_samp(demand_kwh) OVER (PARTITION BY meter_id, hour(ts)) > 0 THEN (demand_kwh - avg(demand_kwh) OVER (PARTITION BY meter_id, hour(ts))) / stddev_samp(demand_kwh) OVER (PARTITION BY meter_id, hour(ts)) ELSE 0 END")]]
CROSS = [("cdh_x_business", "cdh * is_business_hour"), ("cdh_x_peak", "cdh * is_peak_hour"), ("cdh_x_weekend", "cdh * is_weekend"), ("ghi_x_business", "ghi * is_business_hour")]


@query("pipe_features_hourly", ID + TEMPORAL_COLS + contract(HOURLY_LOAD) + " price:2 price_above_mean:i" + "".join(f" {c}:4" for c in WEATHER_BASE) + contract(HOURLY_WEATHER) + "".join(f" {c}:4" for c, _ in CROSS), f"""WITH p AS (SELECT *, (price > avg(price) OVER (PARTITION BY month))::INT AS price_above_mean FROM prices),
    x AS (SELECT ts AS wts, location_id, * EXCLUDE (ts, location_id) FROM {nested('weather', HOURLY_WEATHER)}), r AS (SELECT * FROM {nested(f'({TEMPORAL})', HOURLY_LOAD)})
    SELECT r.*, price, price_above_mean, x.* EXCLUDE (wts, location_id), {', '.join(f'{e} AS {c}' for c, e in CROSS)}
    FROM r LEFT JOIN p ON p.month = r.month AND p.hour = r.hour LEFT JOIN x ON wts = r.ts AND x.location_id = {LOCATION.format(m='r.')} WHERE demand_kwh_lag_24h IS NOT NULL""")
def _(t):
    return features.hourly_features(located(t.readings), t.weather, t.prices, KEY, longest_lag=24, place=PLACE)


@query("pipe_features_real", ID + " tod:i is_business_hour:i lag_3h:4 lag_24h:4 rmean_48:4 rstd_12:4 rmin_24:4 rmax_24:4 daily_mean:4 demand_ratio:4", f"""SELECT *, demand_kwh / greatest(daily_mean, 0.001) AS demand_ratio FROM (SELECT meter_id, ts, demand_kwh, CASE WHEN hour(ts) BETWEEN 6 AND 8 THEN 1 WHEN hour(ts) BETWEEN 9 AND 17 THEN 2 WHEN hour(ts) BETWEEN 18 AND 21 THEN 3 ELSE 0 END AS tod,
    (hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5)::INT AS is_business_hour, lag(demand_kwh, 3) {W} AS lag_3h, lag(demand_kwh, 24) {W} AS lag_24h, avg(demand_kwh) {incl(48)} AS rmean_48, stddev_samp(demand_kwh) {incl(12)} AS rstd_12, min(demand_kwh) {incl(24)} AS rmin_24, max(demand_kwh) {incl(24)} AS rmax_24,
    avg(demand_kwh) {incl(24)} AS daily_mean FROM readings)""")
def _(t):
    return features.load_features(t.readings, KEY, "demand_kwh", slots_per_hour=1)


@query("split_chrono_span", ID + " split:s", "SELECT *, CASE WHEN epoch_us(ts) < min(epoch_us(ts)) OVER k + (max(epoch_us(ts)) OVER k - min(epoch_us(ts)) OVER k) * 0.75 THEN 'train' ELSE 'test' END AS split FROM readings WINDOW k AS (PARTITION BY meter_id)")
def _(t):
    return splits.by_span(t.readings, KEY)


@query("split_chrono_rows", ID + " split:s", f"SELECT *, CASE WHEN row_number() {W} <= floor(count(*) OVER (PARTITION BY meter_id) * 0.75) THEN 'train' ELSE 'test' END AS split FROM readings")
def _(t):
    return splits.by_rows(t.readings, KEY)


def nth_sql(every, offset, slots, cap="true", keep="true"):
    return f"""WITH d AS (SELECT meter_id, date_trunc('day', ts) AS day, count(*) >= {slots} AS f FROM readings GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY meter_id, f ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY meter_id, f) AS n FROM d)
    SELECT r.*, CASE WHEN f AND i >= {offset} AND (i - {offset}) % {every} = 0 AND {cap} THEN 'test' ELSE 'train' END AS split FROM readings r JOIN e ON e.meter_id = r.meter_id AND e.day = date_trunc('day', r.ts) WHERE {keep}"""


@query("split_every_nth_day", ID + " split:s", nth_sql(4, 0, 2))
def _(t):
    return splits.every_nth_day(t.readings, KEY, 4, 0, 2)


@query("split_every_nth_day_capped", ID + " split:s", nth_sql(4, 2, 2, "(i - 2) // 4 < greatest(1, floor(n * 0.2))", "f"))
def _(t):
    return splits.every_nth_day(t.readings, KEY, 4, 2, 2, cap_share=0.2, keep_incomplete=False)


@query("split_rolling_origin", ID + " fold:i split:s", """WITH d AS (SELECT meter_id, date_trunc('day', ts) AS day FROM readings GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY meter_id) AS n FROM d),
    f AS (SELECT *, unnest(range(0, 40)) AS fold FROM e)
    SELECT r.*, fold, CASE WHEN i < 10 + fold * 5 THEN 'train' ELSE 'test' END AS split FROM readings r JOIN f ON f.meter_id = r.meter_id AND f.day = date_trunc('day', r.ts) WHERE 10 + fold * 5 + 4 <= n AND i < 10 + fold * 5 + 4""")
def _(t):
    return splits.rolling_origin(t.readings, KEY, initial=10, step=5, horizon=4)


@query("split_last_days", ID + " split:s", "SELECT *, CASE WHEN ts > max(ts) OVER (PARTITION BY meter_id) - INTERVAL 7 DAYS THEN 'test' ELSE 'train' END AS split FROM readings")
def _(t):
    return splits.last_days(t.readings, KEY, 7)


@query("split_expanding_cv", ID + " fold:i split:s", f"""WITH r AS (SELECT meter_id, ts, demand_kwh, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY meter_id) AS n FROM readings), s AS (SELECT *, floor((n - 20) / 5) AS z FROM r), f AS (SELECT *, unnest(range(0, 5)) AS fold FROM s WHERE z > 0)
    SELECT *, CASE WHEN i < 20 + fold * z THEN 'train' ELSE 'test' END AS split FROM f WHERE i < 20 + (fold + 1) * z""")
def _(t):
    return splits.expanding_folds(t.readings, KEY, 5, 20)


@query("fc_seasonal_anchor", "meter_id:s ts:t mean_kwh:5 q10_kwh:5 q90_kwh:5", PROFILE_SQL)
def _(t):
    return forecasts.seasonal_anchor(t.readings, forecasts.horizon_after(t.readings, KEY, "1 hour", "7 days"), KEY)


@query("fc_weather_adjusted", "meter_id:s ts:t mean_kwh:3 q10_kwh:3 q90_kwh:3", f"""WITH h AS (SELECT meter_id, ts, demand_kwh FROM sites WHERE ts < TIMESTAMP '2024-01-24 00:00:00'),
    m AS (SELECT *, max(ts) OVER (PARTITION BY meter_id) AS last FROM h), r AS (SELECT *, count(*) FILTER (ts >= last - INTERVAL 28 DAYS) OVER (PARTITION BY meter_id) AS nr FROM m), a AS (SELECT *, isodow(ts) - 1 AS dow, hour(ts) AS hour FROM r WHERE ts >= last - INTERVAL 28 DAYS OR nr < 96),
    p AS (SELECT meter_id, dow, hour, median(demand_kwh) AS med, quantile_cont(demand_kwh, 0.1) AS q10, quantile_cont(demand_kwh, 0.9) AS q90 FROM a GROUP BY 1, 2, 3), g AS (SELECT meter_id, median(demand_kwh) AS level FROM a GROUP BY 1),
    s AS (SELECT meter_id, hour(ts) AS hour, CASE WHEN count(*) >= 8 AND max(temperature) - min(temperature) >= 1 THEN regr_slope(demand_kwh, temperature) ELSE 0 END AS slope FROM (SELECT h.*, temperature FROM h JOIN weather wx ON {weather_at('h')}) GROUP BY 1, 2),
    c AS (SELECT meter_id, count(*) AS nrow FROM h JOIN weather wx ON {weather_at('h')} GROUP BY 1), t AS (SELECT meter_id, hour(a.ts) AS hour, median(temperature) AS tmed FROM a JOIN weather wx ON {weather_at('a')} GROUP BY 1, 2),
    z AS (SELECT meter_id, unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 168 HOURS, INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1),
    y AS (SELECT z.meter_id, z.ts, coalesce(med, level) AS b, coalesce(q10, level * 0.7) AS lo, coalesce(q90, level * 1.3) AS hi, CASE WHEN nrow >= 96 THEN coalesce(0.6 * coalesce(slope, 0) * (coalesce(temperature, tmed) - tmed), 0) ELSE 0 END AS adj
        FROM z JOIN g USING (meter_id) LEFT JOIN p ON p.meter_id = z.meter_id AND p.dow = isodow(z.ts) - 1 AND p.hour = hour(z.ts) LEFT JOIN s ON s.meter_id = z.meter_id AND s.hour = hour(z.ts) LEFT JOIN t ON t.meter_id = z.meter_id AND t.hour = hour(z.ts) LEFT JOIN c ON c.meter_id = z.meter_id LEFT JOIN weather wx ON {weather_at('z')})
    SELECT meter_id, ts, greatest(b + adj, 0.0) AS mean_kwh, greatest(lo + adj, 0.0) AS q10_kwh, greatest(hi + adj, 0.0) AS q90_kwh FROM y""")
def _(t):
    seen = located(t.sites).filter("ts < timestamp'2024-01-24 00:00:00'")
    return forecasts.weather_adjusted(seen, t.weather, forecasts.horizon_after(seen, KEY, "1 hour", "7 days"), KEY, min_n=8, place=PLACE)


@query("fc_priming_context", "meter_id:s ts:t demand_kwh:4 source:s", """WITH m AS (SELECT *, max(ts) OVER (PARTITION BY meter_id) AS last FROM readings), r AS (SELECT *, count(*) FILTER (ts >= last - INTERVAL 28 DAYS) OVER (PARTITION BY meter_id) AS nr FROM m), a AS (SELECT *, isodow(ts) - 1 AS dow, hour(ts) AS hour FROM r WHERE ts >= last - INTERVAL 28 DAYS OR nr < 96),
    p AS (SELECT meter_id, dow, hour, median(demand_kwh) AS med FROM a GROUP BY 1, 2, 3), g AS (SELECT meter_id, median(demand_kwh) AS level FROM a GROUP BY 1),
    z AS (SELECT meter_id, max(ts) AS last, unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 5 DAYS, INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY 1)
    SELECT meter_id, ts, demand_kwh, 'real' AS source FROM m WHERE ts >= last - INTERVAL 10 DAYS UNION ALL SELECT z.meter_id, z.ts, coalesce(med, level), CASE WHEN z.ts <= z.last + INTERVAL 2 DAYS THEN 'pseudo' ELSE 'horizon' END
    FROM z JOIN g USING (meter_id) LEFT JOIN p ON p.meter_id = z.meter_id AND p.dow = isodow(z.ts) - 1 AND p.hour = hour(z.ts)""")
def _(t):
    return forecasts.priming_context(t.readings, KEY, "1 hour", horizon_days=3, pseudo_days=2, tail_days=10)


@query("fc_blend_median", "meter_id:s ts:t predicted_kwh:5", "SELECT meter_id, ts, median(predicted_kwh) AS predicted_kwh FROM strategies GROUP BY 1, 2")
def _(t):
    return forecasts.blend_median(t.strategies, ["A", "B", "C"], ["predicted_kwh"])


@query("fc_fallback", "meter_id:s ts:t predicted_kwh:4 method:s", """SELECT a.meter_id, a.ts, coalesce(b.predicted_kwh, a.predicted_kwh) AS predicted_kwh, CASE WHEN b.meter_id IS NOT NULL THEN 'model' ELSE 'seasonal_anchor' END AS method FROM (SELECT * FROM strategies WHERE strategy = 'A') a
    LEFT JOIN (SELECT * FROM strategies WHERE strategy = 'B' AND meter_id NOT LIKE 'view%') b ON b.meter_id = a.meter_id AND b.ts = a.ts""")
def _(t):
    a, b = (t.strategies.filter(F.col("strategy") == s) for s in "AB")
    return forecasts.with_fallback(b.filter("meter_id not like 'view%'"), a, ["meter_id", "ts"], "predicted_kwh")


@query("fc_std_band", "meter_id:s ts:t predicted_kwh:4 lower:4 upper:4", """SELECT meter_id, ts, predicted_kwh, greatest(predicted_kwh - w, 0.0) AS lower, predicted_kwh + w AS upper FROM (SELECT *, stddev_pop(predicted_kwh) OVER (PARTITION BY meter_id) * 0.15 * 1.645 AS w FROM fc)""")
def _(t):
    return forecasts.deviation_band(t.fc, KEY, "predicted_kwh")


@query("fc_price", "meter_id:s ts:t price:4 landed_cost:4 price_percentile:6", f"""WITH p AS (SELECT meter_id, s.ts, CASE WHEN temperature > 35 THEN price + 0.02 * (temperature - 35.0) * price ELSE price END AS price FROM sites s JOIN (SELECT location_id, ts, temperature * 1.3 AS temperature FROM weather) wx ON {weather_at('s')} JOIN prices ON prices.month = month(s.ts) AND prices.hour = hour(s.ts))
    SELECT *, price / (0.961 * 0.9725 * 0.9728) + 1.19 AS landed_cost, (rank() OVER (PARTITION BY month(ts) ORDER BY price) - 1) / count(*) OVER (PARTITION BY month(ts)) AS price_percentile FROM p""")
def _(t):
    df = located(t.sites.select("meter_id", "ts")).join(t.weather.select("location_id", "ts", (F.col("temperature") * 1.3).alias("temperature")), ["location_id", "ts"])
    return forecasts.price_forecast(df, t.prices, temperature="temperature")


@query("fc_naive_benchmark", "meter_id:s mape:3 mae:4 n:i", f"""WITH r AS (SELECT *, lag(demand_kwh, 168) {W} AS naive, row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC) AS r FROM sites)
    SELECT meter_id, coalesce(avg(abs(demand_kwh - naive) / demand_kwh * 100), 0) AS mape, avg(abs(demand_kwh - naive)) AS mae, count(*) AS n FROM r WHERE r <= 168 AND naive IS NOT NULL GROUP BY 1""")
def _(t):
    df = forecasts.naive_week(t.sites, KEY, "demand_kwh").filter("naive is not null")
    return accuracy.point_metrics(df, KEY, "demand_kwh", "naive", zero=0.0)


@query("fit_inverse_mape_blend", "meter_id:s weight:4 mae:5", """WITH f AS (SELECT a.meter_id, a.ts, s.demand_kwh AS y, a.predicted_kwh AS a, b.predicted_kwh AS b FROM strategies a JOIN strategies b ON b.meter_id = a.meter_id AND b.ts = a.ts AND b.strategy = 'B' JOIN sites s ON s.meter_id = a.meter_id AND s.ts = a.ts WHERE a.strategy = 'A'),
    w AS (SELECT meter_id, w / 20.0 AS weight, avg(abs(y - (a * (w / 20.0) + b * (1.0 - w / 20.0)))) AS mae FROM f, range(21) g(w) GROUP BY 1, 2) SELECT meter_id, arg_min(weight, (mae, weight)) AS weight, min(mae) AS mae FROM w GROUP BY 1""")
def _(t):
    wide = t.strategies.groupBy("meter_id", "ts").pivot("strategy", ["A", "B"]).agg(F.max("predicted_kwh")).dropna().join(t.sites.select("meter_id", "ts", "demand_kwh"), ["meter_id", "ts"])
    return forecasts.search_weight(wide, KEY, "demand_kwh", "A", "B")


@query("fit_inverse_error_weights", "meter_id:s strategy:s weight:5", """WITH e AS (SELECT meter_id, strategy, avg(abs(demand_kwh - predicted_kwh) / demand_kwh * 100) FILTER (demand_kwh > 0.5) AS m FROM strategies JOIN sites USING (meter_id, ts) GROUP BY 1, 2)
    SELECT meter_id, strategy, (1 / m) / sum(1 / m) OVER (PARTITION BY meter_id) AS weight FROM e""")
def _(t):
    e = t.strategies.join(t.sites.select("meter_id", "ts", "demand_kwh"), ["meter_id", "ts"]).groupBy("meter_id", "strategy").agg(accuracy.masked_mape("demand_kwh", "predicted_kwh", 0.5).alias("m"))
    return forecasts.inverse_error_weights(e, "meter_id", "strategy", "m")


@query("fit_bias_gate", "meter_id:s trail_mbe_raw:4 mape_raw:3 mape_corrected:3 trail_mbe_capped:4 bias_gate:s", """WITH d AS (SELECT *, predicted_kwh * 1.5 AS p, row_number() OVER (PARTITION BY meter_id ORDER BY ts) > floor(count(*) OVER (PARTITION BY meter_id) * 0.85) AS v, ts > max(ts) OVER (PARTITION BY meter_id) - INTERVAL 21 DAYS AS tr FROM fc),
    s AS (SELECT meter_id, avg(actual_kwh) AS mu, avg(p - actual_kwh) FILTER (tr) AS raw, count(*) FILTER (tr) AS nt, count(*) FILTER (v) AS nv FROM d GROUP BY 1), c AS (SELECT *, greatest(least(raw * 0.5, mu * 0.3), -mu * 0.3) AS cand FROM s),
    e AS (SELECT d.meter_id, count(*) FILTER (actual_kwh > 0.5) AS ns, avg(abs(actual_kwh - p) / actual_kwh * 100) FILTER (actual_kwh > 0.5) AS mr, avg(abs(actual_kwh - greatest(p - cand, 0.0)) / actual_kwh * 100) FILTER (actual_kwh > 0.5) AS mc FROM d JOIN c ON c.meter_id = d.meter_id WHERE v GROUP BY 1),
    g AS (SELECT c.*, mr, mc, CASE WHEN nt >= 48 AND nv >= 12 AND abs(cand) > 0.5 AND ns >= 10 THEN CASE WHEN mc + 0.1 < mr THEN 'applied' ELSE 'gated_out' END ELSE 'below_threshold' END AS bias_gate FROM c LEFT JOIN e USING (meter_id))
    SELECT meter_id, CASE WHEN nt >= 12 THEN raw ELSE 0 END AS trail_mbe_raw, mr AS mape_raw, mc AS mape_corrected, CASE WHEN bias_gate = 'applied' THEN cand ELSE 0 END AS trail_mbe_capped, bias_gate FROM g""".replace("nt >= 48 AND", "nt >= 12 AND"))
def _(t):
    return evaluation.bias_gate(t.fc.withColumn("p", F.col("predicted_kwh") * 1.5), KEY, "actual_kwh", "p", min_rows=12, min_scored=10)


REPLAY_SQL = """SELECT meter_id, count(*) AS n_points, avg(predicted_kwh) AS forecast_mean, avg(a) AS actual_mean, CASE WHEN count(*) FILTER (a > 10) >= 4 THEN avg(abs(predicted_kwh - a) / a * 100) FILTER (a > 10) END AS mape, CASE WHEN avg(a) IS NULL THEN 'no_actuals' ELSE 'ok' END AS status FROM (
    SELECT f.meter_id, f.ts, predicted_kwh, s.demand_kwh AS a FROM strategies f LEFT JOIN (SELECT * FROM sites WHERE meter_id NOT LIKE 'error%') s ON s.meter_id = f.meter_id AND s.ts = f.ts WHERE strategy = 'A') GROUP BY 1"""


def replayed(t):
    actual = t.sites.filter("meter_id not like 'error%'").select("meter_id", "ts", F.col("demand_kwh").alias("actual_kwh"))
    return evaluation.replay(t.strategies.filter("strategy = 'A'"), actual)


@query("ev_replay", "meter_id:s n_points:i forecast_mean:4 actual_mean:4 mape:3 status:s", REPLAY_SQL)
def _(t):
    return replayed(t)


@query("ev_replay_fleet", "n_meters:i fleet_mape:3 fleet_mean:4 n_ok:i", f"SELECT count(*) AS n_meters, avg(mape) AS fleet_mape, avg(nullif(forecast_mean, 0)) AS fleet_mean, count(*) FILTER (status = 'ok') AS n_ok FROM ({REPLAY_SQL})")
def _(t):
    return evaluation.replay_fleet(replayed(t))


@query("ev_s2_leaky_clean", "meter_id:s n_slots:i n_clean_slots:i leaky_mape:3 leaky_mae:4 leaky_mbe:4 clean_mape:3 clean_mae:4 clean_mbe:4", """WITH d AS (SELECT meter_id, date_trunc('day', ts) AS day, count(*) >= 4 AS f FROM fc GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY meter_id, f ORDER BY day) - 1 AS i FROM d),
    h AS (SELECT fc.*, fc.ts > TIMESTAMP '2024-01-20 00:00:00' AS late FROM fc JOIN e ON e.meter_id = fc.meter_id AND e.day = date_trunc('day', fc.ts) WHERE f AND i >= 3 AND (i - 3) % 4 = 0)
    SELECT meter_id, count(*) AS n_slots, count(*) FILTER (late) AS n_clean_slots, avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0.5) AS leaky_mape, avg(abs(predicted_kwh - actual_kwh)) AS leaky_mae, avg(predicted_kwh - actual_kwh) AS leaky_mbe,
    avg(abs(actual_kwh - predicted_kwh) / actual_kwh * 100) FILTER (actual_kwh > 0.5 AND late) AS clean_mape, avg(abs(predicted_kwh - actual_kwh)) FILTER (late) AS clean_mae, avg(predicted_kwh - actual_kwh) FILTER (late) AS clean_mbe FROM h GROUP BY 1""")
def _(t):
    return evaluation.holdout_by_cutoff(t.fc, KEY, "2024-01-20 00:00:00", min_slots=4)
