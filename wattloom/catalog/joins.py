"""Join operators."""

from pyspark.sql import Window, functions as F

from wattloom.catalog.registry import query
from wattloom.catalog.views import located, weather_at
from wattloom.functions import calendar as cal
from wattloom.operators import grids, joins, load
from wattloom.operators.frames import MICROS
from wattloom.plans import features

KEY = ["meter_id"]
ID = "meter_id:s ts:t demand_kwh:4"
BACK = "OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def both(c):
    return f"coalesce(last_value({c} IGNORE NULLS) {BACK}, first_value({c} IGNORE NULLS) {AHEAD})"


def sparse_weather(t):
    """Weather with every seventh hour missing."""
    return t.weather.filter(F.hour("ts") != 7)


@query("join_weather_left", ID + " temperature:4 humidity:4", f"""SELECT meter_id, ts, demand_kwh, {both('temperature')} AS temperature, {both('humidity')} AS humidity
    FROM (SELECT r.*, temperature, humidity FROM readings r LEFT JOIN weather wx ON {weather_at('r')} AND hour(wx.ts) <> 7)""")
def _(t):
    return features.join_filled(located(t.readings), sparse_weather(t), KEY, ["temperature", "humidity"], place=["location_id"])


@query("join_fleet_left", ID + " fleet_mean:5 fleet_std:5", f"""WITH f AS (SELECT ts, avg(demand_kwh) AS fm, stddev_samp(demand_kwh) AS fs FROM readings GROUP BY 1 HAVING count(demand_kwh) >= 5)
    SELECT meter_id, ts, demand_kwh, coalesce({both('fm')}, 0) AS fleet_mean, coalesce({both('fs')}, 0) AS fleet_std FROM readings LEFT JOIN f USING (ts)""")
def _(t):
    return features.join_filled(t.readings, features.fleet_aggregate(t.readings), KEY, ["fleet_mean", "fleet_std"], 0.0)


@query("join_forecast_actual", "strategy:s meter_id:s ts:t predicted_kwh:4 actual_kwh:4", "SELECT strategy, meter_id, ts, predicted_kwh, demand_kwh AS actual_kwh FROM strategies JOIN sites USING (meter_id, ts)")
def _(t):
    return t.strategies.join(t.sites.select("meter_id", "ts", F.col("demand_kwh").alias("actual_kwh")), ["meter_id", "ts"])


@query("join_forecast_actual_outer", "strategy:s meter_id:s ts:t predicted_kwh:4 actual_kwh:4 status:s", """SELECT strategy, meter_id, ts, predicted_kwh, demand_kwh AS actual_kwh,
    CASE WHEN demand_kwh IS NULL THEN 'no_actuals' ELSE 'ok' END AS status FROM strategies LEFT JOIN sites USING (meter_id, ts)""")
def _(t):
    df = t.strategies.join(t.sites.select("meter_id", "ts", F.col("demand_kwh").alias("actual_kwh")), ["meter_id", "ts"], "left")
    return df.withColumn("status", F.when(F.col("actual_kwh").isNull(), "no_actuals").otherwise("ok"))


@query("join_interval_mask", ID + " in_gap:b", """WITH gaps AS (SELECT meter_id AS m, ts + INTERVAL 1 HOUR AS s, nx - INTERVAL 1 HOUR AS e FROM (
    SELECT meter_id, ts, lead(ts) OVER (PARTITION BY meter_id ORDER BY ts) AS nx FROM sites WHERE tag % 3 = 0) WHERE nx > ts + INTERVAL 1 HOUR)
    SELECT meter_id, ts, demand_kwh, EXISTS (SELECT 1 FROM gaps WHERE m = meter_id AND ts BETWEEN s AND e) AS in_gap FROM grid""")
def _(t):
    gaps = grids.detect_gaps(t.sites.filter("tag % 3 = 0"), KEY, "ts", 60)
    return joins.flag_inside(t.grid, gaps, KEY, "ts", "gap_start", "gap_end", "in_gap")


@query("join_asof_price", "meter_id:s ts:t price:2", """WITH g AS (SELECT DISTINCT ts FROM readings),
    a AS (SELECT g.ts, p.price FROM g ASOF LEFT JOIN (SELECT * FROM price_series WHERE hour(ts) % 2 = 1) p ON g.ts >= p.ts),
    b AS (SELECT ts, coalesce(price, (SELECT price FROM price_series WHERE hour(ts) % 2 = 1 ORDER BY ts LIMIT 1)) AS price FROM a)
    SELECT meter_id, ts, price FROM readings JOIN b USING (ts)""")
def _(t):
    aligned = joins.asof_last(t.readings.select("ts").distinct(), t.price_series.filter(F.hour("ts") % 2 == 1), "ts", "price")
    return t.readings.select("meter_id", "ts").join(aligned, "ts")


@query("join_calendar_holiday", ID + " is_holiday:i near_holiday:i", """WITH h AS (SELECT CAST(d AS DATE) AS d FROM (VALUES ('2024-01-14'), ('2024-01-26')) v(d))
    SELECT meter_id, ts, demand_kwh, (CAST(ts AS DATE) IN (SELECT d FROM h))::INT AS is_holiday,
    (EXISTS (SELECT 1 FROM h WHERE abs(CAST(ts AS DATE) - h.d) <= 1))::INT AS near_holiday FROM readings""")
def _(t):
    near = cal.is_recurring_holiday("ts") | cal.is_recurring_holiday(F.date_add("ts", 1)) | cal.is_recurring_holiday(F.date_sub("ts", 1))
    return t.readings.withColumns({"is_holiday": cal.is_recurring_holiday("ts").cast("int"), "near_holiday": near.cast("int")})


@query("join_price_matrix", "order_id:i fy_month:i price:2", """SELECT o_orderkey AS order_id, (month(o_orderdate) + 8) % 12 AS fy_month, price FROM orders
    JOIN prices ON (prices.month + 8) % 12 = (month(o_orderdate) + 8) % 12 AND prices.hour = o_custkey % 24""")
def _(t):
    matrix = t.prices.withColumn("fy_month", cal.fy_month(F.col("month"))).drop("month")
    o = t.read("orders").select(F.col("o_orderkey").alias("order_id"), cal.fy_month(F.month("o_orderdate")).alias("fy_month"), (F.col("o_custkey") % 24).cast("int").alias("hour"))
    return o.join(F.broadcast(matrix), ["fy_month", "hour"])  # 288 rows by construction


PROFILE_SQL = """WITH m AS (SELECT *, max(ts) OVER (PARTITION BY meter_id) AS last FROM readings),
    r AS (SELECT *, count(*) FILTER (ts >= last - INTERVAL 28 DAYS) OVER (PARTITION BY meter_id) AS nr FROM m),
    a AS (SELECT *, isodow(ts) - 1 AS dow, hour(ts) AS hour FROM r WHERE ts >= last - INTERVAL 28 DAYS OR nr < 96),
    p AS (SELECT meter_id, dow, hour, median(demand_kwh) AS med, quantile_cont(demand_kwh, 0.1) AS q10, quantile_cont(demand_kwh, 0.9) AS q90 FROM a GROUP BY 1, 2, 3),
    g AS (SELECT meter_id, median(demand_kwh) AS level FROM a GROUP BY 1),
    h AS (SELECT meter_id, unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 168 HOURS, INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY 1)
    SELECT h.meter_id, h.ts, coalesce(med, level) AS mean_kwh, coalesce(q10, level * 0.7) AS q10_kwh, coalesce(q90, level * 1.3) AS q90_kwh
    FROM h JOIN g USING (meter_id) LEFT JOIN p ON p.meter_id = h.meter_id AND p.dow = isodow(h.ts) - 1 AND p.hour = hour(h.ts)"""


def horizon_grid(df, keys, step, n_hours):
    end = df.groupBy(*keys).agg(F.max("ts").alias("_e"))
    return end.select(*keys, F.explode(F.expr(f"sequence(_e + interval {step}, _e + interval {n_hours} hours, interval {step})")).alias("ts"))


@query("join_seasonal_profile", "meter_id:s ts:t mean_kwh:5 q10_kwh:5 q90_kwh:5", PROFILE_SQL)
def _(t):
    profile, level = load.slot_profile(t.readings, KEY, "demand_kwh")
    grid = horizon_grid(t.readings, KEY, "1 hour", 168).withColumns({"dow": F.weekday("ts"), "hour": F.hour("ts"), "minute": F.minute("ts")})
    return joins.join_profile(grid, profile, level, KEY, ["dow", "hour", "minute"], {"mean_kwh": 1.0, "q10_kwh": 0.7, "q90_kwh": 1.3}, "level")


@query("join_weekly_lookback", "meter_id:s ts:t primed:4", """WITH h AS (SELECT meter_id, unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 168 HOURS, INTERVAL 1 HOUR)) AS ts FROM sites GROUP BY 1),
    l AS (SELECT meter_id, arg_max(demand_kwh, ts) AS latest FROM sites GROUP BY 1)
    SELECT h.meter_id, h.ts, coalesce(a.demand_kwh, b.demand_kwh, c.demand_kwh, d.demand_kwh, latest) AS primed FROM h JOIN l USING (meter_id)
    LEFT JOIN sites a ON a.meter_id = h.meter_id AND a.ts = h.ts - INTERVAL 7 DAYS LEFT JOIN sites b ON b.meter_id = h.meter_id AND b.ts = h.ts - INTERVAL 14 DAYS
    LEFT JOIN sites c ON c.meter_id = h.meter_id AND c.ts = h.ts - INTERVAL 21 DAYS LEFT JOIN sites d ON d.meter_id = h.meter_id AND d.ts = h.ts - INTERVAL 28 DAYS""")
def _(t):
    return joins.weekly_lookback(t.sites, horizon_grid(t.sites, KEY, "1 hour", 168), KEY, "demand_kwh")


@query("join_year_ago_extend", "location_id:s ts:t temperature:4 is_extended:b", """WITH e AS (SELECT location_id, max(ts) AS last FROM weather GROUP BY 1),
    p AS (SELECT location_id, unnest(generate_series(last + INTERVAL 1 HOUR, last + INTERVAL 10 DAYS, INTERVAL 1 HOUR)) AS ts FROM e),
    u AS (SELECT location_id, ts, temperature, false AS is_extended FROM weather UNION ALL
    SELECT p.location_id, p.ts, w.temperature, true FROM p LEFT JOIN weather w ON w.location_id = p.location_id AND w.ts = p.ts - INTERVAL 21 DAYS)
    SELECT location_id, ts, is_extended, coalesce(last_value(temperature IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(temperature IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temperature FROM u""")
def _(t):
    return joins.extend_from_past(t.weather, ["location_id"], ["temperature"], 10, "1 hour", back_days=21)


@query("join_strategy_compare", "meter_id:s total_A:3 total_B:3 total_C:3 ab_pct:3 best_agree:b", """WITH s AS (SELECT meter_id, sum(predicted_kwh) FILTER (strategy = 'A') AS a, sum(predicted_kwh) FILTER (strategy = 'B') AS b, sum(predicted_kwh) FILTER (strategy = 'C') AS c FROM strategies GROUP BY 1)
    SELECT meter_id, a AS total_A, b AS total_B, c AS total_C, abs(a - b) / greatest((a + b) / 2, 1e-9) * 100 AS ab_pct, coalesce(abs(a - b) / greatest((a + b) / 2, 1e-9) * 100 < 5, false) AS best_agree FROM s""")
def _(t):
    return load.strategy_totals(t.strategies, ["A", "B", "C"])


def registries(t):
    """Two model registries that overlap; the newer one has other errors."""
    old = t.registry.filter("k % 7 <> 0").select("msn", "tier", F.col("mape").alias("mape_old"))
    new = t.registry.filter("k % 5 <> 0").select("msn", F.col("peak_mape").alias("mape_new"))
    return old, new


@query("join_model_compare", "msn:s mape_old:2 mape_new:2 delta:2 verdict:s n_improved:i n_worsened:i", """WITH c AS (SELECT msn, mape AS mape_old, peak_mape AS mape_new, peak_mape - mape AS delta FROM registry WHERE k % 7 <> 0 AND k % 5 <> 0),
    n AS (SELECT count(*) FILTER (delta < 0) AS n_improved, count(*) FILTER (delta > 0) AS n_worsened FROM c)
    SELECT c.*, CASE WHEN delta < 0 THEN 'improved' WHEN delta > 0 THEN 'worsened' ELSE 'equal' END AS verdict, n_improved, n_worsened FROM c, n""")
def _(t):
    old, new = registries(t)
    c = old.join(new, "msn").withColumn("delta", F.col("mape_new") - F.col("mape_old"))
    total = lambda hit: c.agg(F.count_if(hit)).scalar()
    verdict = F.when(F.col("delta") < 0, "improved").when(F.col("delta") > 0, "worsened").otherwise("equal")
    return c.select("*", verdict.alias("verdict"), total(F.col("delta") < 0).alias("n_improved"), total(F.col("delta") > 0).alias("n_worsened"))


@query("join_semi_isin", ID, "SELECT meter_id, ts, demand_kwh FROM sites WHERE date_trunc('day', ts) IN (SELECT date_trunc('day', ts) FROM price_series WHERE price > 6.2) AND meter_id NOT IN (SELECT meter_id FROM sites WHERE tag % 997 = 0)")
def _(t):
    days = t.price_series.filter("price > 6.2").select(F.date_trunc("day", "ts").alias("day")).distinct()
    df = t.sites.withColumn("day", F.date_trunc("day", "ts")).join(days, "day", "left_semi")
    return df.join(t.sites.filter("tag % 997 = 0").select("meter_id").distinct(), "meter_id", "left_anti")
