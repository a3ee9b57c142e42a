"""Grid and set operators, ordering and top-k."""

from pyspark.sql import Window, functions as F

from wattloom.catalog.registry import query
from wattloom.functions import labels
from wattloom.operators import economics, grids, load, ranking

KEY = ["meter_id"]
W = "OVER (PARTITION BY meter_id ORDER BY ts)"


@query("set_gap_detect", "meter_id:s gap_start:t gap_end:t gap_intervals:i gap_duration_min:2", f"""SELECT meter_id, ts + INTERVAL 1 HOUR AS gap_start, nx - INTERVAL 1 HOUR AS gap_end, (epoch(nx) - epoch(ts)) / 3600 - 1 AS gap_intervals,
    ((epoch(nx) - epoch(ts)) / 3600 - 1) * 60.0 AS gap_duration_min FROM (SELECT meter_id, ts, lead(ts) {W} AS nx FROM readings) WHERE nx > ts + INTERVAL 1 HOUR""")
def _(t):
    return grids.detect_gaps(t.readings, KEY, "ts", 60)


@query("set_union_strategies", "meter_id:s ts:t strategy:s predicted_kwh:4", "SELECT meter_id, ts, strategy, predicted_kwh FROM strategies QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY strategy) = 1")
def _(t):
    return grids.union_by_priority([t.strategies.filter(F.col("strategy") == s) for s in "ABC"], ["meter_id", "ts"])


@query("set_reindex", "meter_id:s ts:t demand_kwh:4", """SELECT g.meter_id, g.ts, coalesce(r.demand_kwh, 0.0) AS demand_kwh FROM (SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY 1) g
    LEFT JOIN readings r ON r.meter_id = g.meter_id AND r.ts = g.ts""")
def _(t):
    return grids.reindex(t.readings.select("meter_id", "ts", "demand_kwh"), KEY, "ts", "1 hour", fill=0.0)


@query("set_upsample_15", "meter_id:s ts:t predicted_kwh:6 actual_kwh:6", "SELECT meter_id, ts + to_minutes(15 * p) AS ts, predicted_kwh / 2.0 AS predicted_kwh, actual_kwh / 2.0 AS actual_kwh FROM fc30, (VALUES (0), (1)) parts(p)")
def _(t):
    return grids.split_slots(t.fc30)


@query("set_resample_interp", "meter_id:s ts:t energy_kwh:6 confidence_low:6 block_label:s", """WITH n AS (SELECT meter_id, ts, predicted_kwh, q10_kwh, lead(q10_kwh) OVER (PARTITION BY meter_id ORDER BY ts) AS nx, CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 'peak' ELSE 'other' END AS block_label FROM fc30),
    r AS (SELECT meter_id, ts + to_minutes(15 * p) AS ts, predicted_kwh / 2.0 AS energy_kwh, CASE WHEN p = 0 THEN q10_kwh ELSE coalesce((q10_kwh + nx) / 2.0, q10_kwh) END AS confidence_low, block_label FROM n, (VALUES (0), (1)) parts(p))
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts) <= 192""")
def _(t):
    df = t.fc30.select("meter_id", "ts", F.col("predicted_kwh").alias("energy_kwh"), F.col("q10_kwh").alias("confidence_low"), F.when(F.hour("ts").between(18, 21), "peak").otherwise("other").alias("block_label"))
    return grids.interpolate_to_half(df, KEY, "ts", ["energy_kwh"], ["confidence_low"], ["block_label"], 15, cap=192)


@query("set_resample_ffill", "location_id:s ts:t temperature:4 ghi:4", """WITH g AS (SELECT location_id, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTES)) AS ts FROM weather GROUP BY 1)
    SELECT g.location_id, g.ts, last_value(temperature IGNORE NULLS) OVER w AS temperature, last_value(ghi IGNORE NULLS) OVER w AS ghi FROM g LEFT JOIN weather x ON x.location_id = g.location_id AND x.ts = g.ts
    WINDOW w AS (PARTITION BY g.location_id ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    return grids.hold_to_step(t.weather, ["location_id"], "ts", ["temperature", "ghi"], "30 minutes")


@query("set_strategy_stitch", "meter_id:s ts:t strategy:s predicted_kwh:4", """WITH c AS (SELECT * FROM strategies WHERE strategy = 'C' AND meter_id NOT LIKE 'click%')
    SELECT * FROM c WHERE ts < TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT * FROM strategies WHERE strategy = 'B' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND meter_id NOT IN (SELECT meter_id FROM c)
    UNION ALL SELECT * FROM strategies WHERE strategy = 'A' AND ts >= TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    a, b, c = (t.strategies.filter(F.col("strategy") == s) for s in "ABC")
    return grids.stitch(a, c.filter("meter_id not like 'click%'"), b, "meter_id", "ts", "2024-01-20 00:00:00")


@query("set_common_keys", "msn:s status:s", """SELECT msn, 'both' AS status FROM registry WHERE k % 7 <> 0 AND k % 5 <> 0 UNION ALL SELECT msn, 'only_old' FROM registry WHERE k % 7 <> 0 AND k % 5 = 0
    UNION ALL SELECT msn, 'only_new' FROM registry WHERE k % 7 = 0 AND k % 5 <> 0""")
def _(t):
    old, new = t.registry.filter("k % 7 <> 0").select("msn"), t.registry.filter("k % 5 <> 0").select("msn")
    tag = lambda d, s: d.withColumn("status", F.lit(s))
    return tag(old.intersect(new), "both").unionByName(tag(old.subtract(new), "only_old")).unionByName(tag(new.subtract(old), "only_new"))


@query("set_config_grid", "site_id:s size_kwh:2 duration_h:i strategy:s max_power_kw:4", """SELECT site_id, mean_kwh * s AS size_kwh, d AS duration_h, g AS strategy, mean_kwh * s / d AS max_power_kw FROM (SELECT meter_id AS site_id, avg(demand_kwh) AS mean_kwh FROM sites GROUP BY 1),
    (VALUES (1), (2), (4)) a(s), (VALUES (2), (4), (6)) b(d), (VALUES ('cheap_grid'), ('full_solar'), ('solar_surplus')) c(g)""")
def _(t):
    base = t.sites.groupBy(F.col("meter_id").alias("site_id")).agg(F.avg("demand_kwh").alias("base_kwh"))
    return economics.battery_grid(base, [1.0, 2.0, 4.0], [2, 4, 6], ["cheap_grid", "full_solar", "solar_surplus"])


@query("top_cheapest_hours", "month:i hour:i price:2 rank:i", "SELECT *, row_number() OVER (PARTITION BY month ORDER BY price, hour) AS rank FROM prices QUALIFY rank <= 4")
def _(t):
    return ranking.top_per_key(t.prices, ["month"], [F.col("price"), F.col("hour")], 4)


@query("top_expensive_hours", "month:i hour:i price:2 rank:i", "SELECT *, row_number() OVER (PARTITION BY month ORDER BY price DESC, hour DESC) AS rank FROM prices QUALIFY rank <= 4")
def _(t):
    return ranking.top_per_key(t.prices, ["month"], [F.desc("price"), F.desc("hour")], 4)


@query("top_dispatch_highlights", "site_id:s ts:t magnitude_kwh:4 rank:i", """SELECT site_id, ts, greatest(charge_kwh, discharge_kwh, curtail_kwh) AS magnitude_kwh, row_number() OVER (PARTITION BY site_id ORDER BY greatest(charge_kwh, discharge_kwh, curtail_kwh) DESC, ts) AS rank
    FROM schedule WHERE greatest(charge_kwh, discharge_kwh, curtail_kwh) > 0.001 QUALIFY rank <= 3""")
def _(t):
    return ranking.top_per_key(economics.active_rows(t.schedule), ["site_id"], [F.desc("magnitude_kwh"), F.col("ts")], 3)


@query("top_offenders", "msn:s mape:2", "SELECT msn, mape FROM registry ORDER BY mape DESC, msn LIMIT 10")
def _(t):
    return ranking.top(t.registry.select("msn", "mape"), [F.desc("mape"), F.col("msn")], 10)


@query("top_feature_select", "meter_id:s feature:s gain:4", """WITH p AS (SELECT meter_id, 'h' || hour(ts) AS feature, CASE WHEN demand_kwh IS NOT NULL THEN CAST(epoch(ts) / 3600 AS HUGEINT) END AS x,
    CASE WHEN ts IS NOT NULL THEN floor(demand_kwh * 1e4 + 0.5) END AS v FROM readings),
    w AS (SELECT *, CASE WHEN abs(v) <= 1e15 THEN CAST(v AS HUGEINT) END AS y FROM p),
    m AS (SELECT meter_id, feature, count(*) AS n, count(v) - count(y) AS far, count(x) * sum(x * y) - sum(x) * sum(y) AS c,
    sqrt(CAST(count(x) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) * CAST(count(x) * sum(y * y) - sum(y) * sum(y) AS DOUBLE)) AS s FROM w GROUP BY 1, 2),
    g AS (SELECT meter_id, feature, CASE WHEN n >= 3 THEN greatest(CASE WHEN far > 0 OR s = 0 THEN CAST('nan' AS DOUBLE) WHEN s > 0 THEN floor(CAST(c AS DOUBLE) / s * 1e12 + 0.5) / 1e12 END, 0) ELSE 0 END AS gain FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY gain DESC, feature) AS r, count(*) OVER (PARTITION BY meter_id) AS n FROM g),
    h AS (SELECT *, r <= greatest(10, floor(n * 0.55)) AND gain > 0 AS hit FROM r), k AS (SELECT *, sum(hit::INT) OVER (PARTITION BY meter_id) AS k FROM h)
    SELECT meter_id, feature, gain FROM k WHERE CASE WHEN k < 8 THEN r <= 10 ELSE hit END""")
def _(t):
    # Hours and ten-thousandths are whole numbers, so that the correlations are exact.
    gain = ranking.correlation(F.floor(F.unix_seconds("ts") / 3600), F.floor(F.col("demand_kwh") * 1e4 + 0.5))
    g = t.readings.groupBy("meter_id", F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("feature")).agg(
        F.when(F.count("*") >= 3, F.greatest(gain, F.lit(0.0))).otherwise(0.0).alias("gain"))
    return ranking.select_features(g, KEY, keep_min=10, floor=8)


@query("sort_meters", "msn:s tier:s tier_rank:i mape:2", "SELECT msn, tier, CASE tier WHEN 'HT (>5kWh)' THEN 0 WHEN 'Large (1.5-5k)' THEN 1 WHEN 'Medium (0.5-1.5k)' THEN 2 WHEN 'Small (<500)' THEN 3 ELSE 9 END AS tier_rank, mape FROM registry ORDER BY 3, 4, 1")
def _(t):
    return ranking.sort_meters(t.registry)


@query("lim_page", "meter_id:s ts:t demand_kwh:4 rank:i", f"SELECT meter_id, ts, demand_kwh, row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC) AS rank FROM readings QUALIFY rank <= 24")
def _(t):
    return ranking.top_per_key(t.readings, KEY, [F.desc("ts")], 24)


@query("top_best_config", "site_id:s best_size_kwh:4 best_irr:6 max_viable_kwh:4", """WITH c AS (SELECT meter_id AS site_id, CAST(hour(ts) + 1 AS DOUBLE) * 100 AS size_kwh, avg(demand_kwh) / 500.0 AS irr FROM sites GROUP BY 1, 2)
    SELECT site_id, arg_max(size_kwh, (irr, -size_kwh)) AS best_size_kwh, max(irr) AS best_irr, max(size_kwh) FILTER (irr >= 0.1) AS max_viable_kwh FROM c GROUP BY 1""")
def _(t):
    c = t.sites.groupBy(F.col("meter_id").alias("site_id"), ((F.hour("ts") + 1).cast("double") * 100).alias("size_kwh")).agg((F.avg("demand_kwh") / 500.0).alias("irr"))
    return economics.best_config(c, "site_id", target=0.1)
