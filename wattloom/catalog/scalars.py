"""Scalar function families."""

from pyspark.sql import functions as F

from wattloom.catalog.registry import query
from wattloom.catalog.views import located, weather_at
from wattloom.functions import calendar as cal, labels, money, text, weather as wf
from wattloom.plans import features

KEY = ["meter_id"]
HOL = "(month(ts) * 100 + day(ts) IN (114, 126, 314, 406, 414, 501, 815, 827, 905, 1002, 1012, 1020, 1101, 1225))"
TEMPORAL = f"""SELECT *, (is_weekend = 0 AND is_holiday = 0)::INT AS is_working_day, (tod_multiplier > 1)::INT AS is_peak_hour, (hour BETWEEN 9 AND 17 AND is_weekend = 0 AND is_holiday = 0)::INT AS is_business_hour FROM (
    SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, week(ts) AS week_of_year, dayofyear(ts) AS day_of_year, hour(ts) + minute(ts) / 60.0 AS hour_frac,
    (isodow(ts) >= 6)::INT AS is_weekend, {HOL}::INT AS is_holiday, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'summer' WHEN month(ts) <= 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season,
    CASE WHEN hour(ts) BETWEEN 10 AND 13 OR hour(ts) BETWEEN 18 AND 21 THEN 1.2 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 0.9 ELSE 1.0 END AS tod_multiplier FROM readings)"""


@query("fn_temporal", "meter_id:s ts:t hour:i day_of_week:i day_of_month:i month:i week_of_year:i day_of_year:i hour_frac:4 is_weekend:i is_holiday:i season:s tod_multiplier:2 is_working_day:i is_peak_hour:i is_business_hour:i", TEMPORAL)
def _(t):
    return cal.add_temporal(t.readings)


@query("fn_order_calendar", "order_id:i season:s day_of_week:i week_of_year:i is_holiday:i", f"""SELECT o_orderkey AS order_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'summer' WHEN month(ts) <= 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season,
    isodow(ts) - 1 AS day_of_week, week(ts) AS week_of_year, {HOL}::INT AS is_holiday FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders)""")
def _(t):
    return cal.add_temporal(t.read("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts")))


@query("fn_cyclical", "meter_id:s ts:t" + "".join(f" {n}_sin:6 {n}_cos:6" for n in ("hour", "dow", "month", "doy")), "SELECT meter_id, ts, " + ", ".join(
    f"{f}(2 * pi() * ({e}) / {p}) AS {n}_{f}" for n, e, p in (("hour", "hour(ts) + minute(ts) / 60.0", "24.0"), ("dow", "isodow(ts) - 1", "7.0"), ("month", "month(ts)", "12.0"), ("doy", "dayofyear(ts) + hour(ts) / 24.0", "365.25")) for f in ("sin", "cos")) + " FROM readings")
def _(t):
    return cal.add_cycles(t.readings)


@query("fn_tod_multiplier", "meter_id:s ts:t midday:2 evening:2", """SELECT meter_id, ts, CASE WHEN hour(ts) BETWEEN 10 AND 13 OR hour(ts) BETWEEN 18 AND 21 THEN 1.2 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 0.9 ELSE 1.0 END AS midday,
    CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1.2 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 0.9 ELSE 1.0 END AS evening FROM readings""")
def _(t):
    return t.readings.withColumns({"midday": cal.tod_multiplier(F.hour("ts")), "evening": cal.tod_multiplier(F.hour("ts"), midday_peak=False)})


@query("fn_block_ids", "event_id:i block_id_15min:i block_id_30min:i block_id_hour:i block_id_tod:i block:s start_15min:t start_tod:t", """SELECT event_id, hour(ts) * 4 + minute(ts) // 15 AS block_id_15min, hour(ts) * 2 + minute(ts) // 30 AS block_id_30min, hour(ts) AS block_id_hour,
    CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 1 WHEN hour(ts) < 14 THEN 2 WHEN hour(ts) < 18 THEN 3 WHEN hour(ts) < 22 THEN 4 ELSE 5 END AS block_id_tod,
    CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 18 THEN 'solar' ELSE 'peak' END AS block, time_bucket(INTERVAL 15 MINUTES, ts) AS start_15min,
    date_trunc('day', ts) + to_hours(CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 6 WHEN hour(ts) < 14 THEN 10 WHEN hour(ts) < 18 THEN 14 WHEN hour(ts) < 22 THEN 18 ELSE 22 END) AS start_tod FROM events""")
def _(t):
    return t.events.withColumns({**cal.slot_ids("ts"), "block": cal.day_block(F.hour("ts")), "start_15min": cal.block_start("ts", "dam_15min"), "start_tod": cal.block_start("ts", "tod_4h")})


@query("fn_fy_month", "order_id:i fy_month:i", "SELECT o_orderkey AS order_id, (month(o_orderdate) + 8) % 12 AS fy_month FROM orders")
def _(t):
    return t.read("orders").select(F.col("o_orderkey").alias("order_id"), cal.fy_month(F.month("o_orderdate")).alias("fy_month"))


@query("fn_landed_cost", "order_id:i landed:5 lakhs:4 crores:6 mwh:6 kwh:5", """SELECT o_orderkey AS order_id, p / (0.961 * 0.9725 * 0.9728) + 1.19 AS landed, o_totalprice / 100.0 AS lakhs, o_totalprice / 10000.0 AS crores, o_totalprice / 1000.0 AS mwh, o_totalprice / 1000.0 AS kwh
    FROM (SELECT *, o_totalprice / 60000.0 AS p FROM orders)""")
def _(t):
    v = F.col("o_totalprice")
    return t.read("orders").select(F.col("o_orderkey").alias("order_id"), money.landed_cost(v / 60000.0).alias("landed"), money.lakhs(v).alias("lakhs"), money.crores(v).alias("crores"), money.mwh(v).alias("mwh"), money.kwh_from_vah(v).alias("kwh"))


HI = "(-8.785 + 1.611 * temperature + 2.339 * humidity - 0.146 * temperature * humidity - 0.013 * temperature * temperature - 0.016 * humidity * humidity + 0.002 * temperature * temperature * humidity + 0.001 * temperature * humidity * humidity - 3.58e-6 * temperature * temperature * humidity * humidity)"
WXID = "location_id:s ts:t"


@query("fn_degree_hours", WXID + " cdh:4 cdh_squared:4 hdh:4 cooling_deg:4 heating_deg:4 cdd_21:4 hdd_21:4 is_extreme_heat:i rh_above_70:i heat_index:3 comfort_cdh:3", f"""SELECT *, greatest(temperature - 26.0, 0.0) AS cdh, greatest(temperature - 26.0, 0.0) * greatest(temperature - 26.0, 0.0) AS cdh_squared, greatest(18.0 - temperature, 0.0) AS hdh,
    greatest(temperature - 25.0, 0.0) AS cooling_deg, greatest(18.0 - temperature, 0.0) AS heating_deg, greatest(temperature - 21.0, 0.0) AS cdd_21, greatest(21.0 - temperature, 0.0) AS hdd_21, (temperature > 35)::INT AS is_extreme_heat, (humidity > 70)::INT AS rh_above_70,
    {HI} AS heat_index, greatest({HI} - 26.0, 0.0) AS comfort_cdh FROM weather""")
def _(t):
    return wf.add_degree_hours(t.weather)


@query("fn_safe_ratio", WXID + " dni_ghi_ratio:5 diffuse_fraction:5 clearsky_ratio:5 cloud_ghi_interaction:3 solar_producing:i solar_peak:i ghi_variability:4 soiling_index:5 aqi_poor:i aod_high:i dust_event:i", """SELECT *, CASE WHEN ghi > 10 THEN dni / ghi ELSE 0 END AS dni_ghi_ratio,
    least(greatest(CASE WHEN ghi > 10 THEN dhi / ghi ELSE 0 END, 0.0), 1.0) AS diffuse_fraction, least(greatest(CASE WHEN clear_sky > 10 THEN ghi / clear_sky ELSE 0 END, 0.0), 1.5) AS clearsky_ratio, cloud_cover / 100.0 * ghi AS cloud_ghi_interaction, (ghi > 10)::INT AS solar_producing, (ghi > 500)::INT AS solar_peak,
    CASE WHEN avg(ghi) OVER r > 10 THEN coalesce(stddev_samp(ghi) OVER r, 0) / avg(ghi) OVER r ELSE 0 END AS ghi_variability,
    (avg(pm2_5) OVER (PARTITION BY location_id ORDER BY ts ROWS 71 PRECEDING) / 100.0 + avg(aod) OVER (PARTITION BY location_id ORDER BY ts ROWS 23 PRECEDING) + dust / 200.0) / 3.0 AS soiling_index,
    (pm2_5 > 35)::INT AS aqi_poor, (aod > 0.4)::INT AS aod_high, (dust > 50)::INT AS dust_event FROM weather WINDOW r AS (PARTITION BY location_id ORDER BY ts ROWS 2 PRECEDING)""")
def _(t):
    return features.add_soiling(features.add_hourly_weather_windows(wf.add_radiation_ratios(t.weather), ["location_id"]))


@query("fn_interactions", "meter_id:s ts:t cdh_x_business:4 cdh_x_peak:4 cdh_x_weekend:4 ghi_x_business:4", f"""SELECT meter_id, r.ts, greatest(temperature - 26.0, 0.0) * is_business_hour AS cdh_x_business, greatest(temperature - 26.0, 0.0) * is_peak_hour AS cdh_x_peak, greatest(temperature - 26.0, 0.0) * is_weekend AS cdh_x_weekend, ghi * is_business_hour AS ghi_x_business
    FROM ({TEMPORAL}) r JOIN weather wx ON {weather_at('r')}""")
def _(t):
    return wf.add_interactions(cal.add_temporal(located(t.readings)).join(wf.add_degree_hours(t.weather), ["location_id", "ts"]))


SUN = """(SELECT *, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((hour(ts) + minute(ts) / 60.0 - (12.0 - (lon - 82.5) / 15.0)) * 15.0)) AS se FROM (
    SELECT location_id, ts, cloud_cover, CASE location_id WHEN 'L0' THEN 17.0 ELSE 18.3 END AS lat, CASE location_id WHEN 'L0' THEN 81.8 ELSE 83.9 END AS lon, CASE location_id WHEN 'L0' THEN 100.0 ELSE 250.0 END AS cap, radians(23.45 * sin(radians((dayofyear(ts) - 81) * (360.0 / 365.0)))) AS decl FROM weather))"""
SKY = f"(SELECT *, CASE WHEN se > 0 THEN greatest(1000.0 * se * exp(-0.185 / least(greatest(se, 0.01), 1.0)), 0.0) ELSE 0 END AS ghi_clear FROM {SUN})"


def sunny(t):
    first = F.col("location_id") == "L0"
    df = t.weather.select("location_id", "ts", "cloud_cover", F.when(first, 17.0).otherwise(18.3).alias("lat"), F.when(first, 81.8).otherwise(83.9).alias("lon"), F.when(first, 100.0).otherwise(250.0).alias("cap"))
    return df.withColumn("ghi_clear", wf.clear_sky_ghi("ts", F.col("lat"), F.col("lon")))


@query("fn_clear_sky", WXID + " ghi_clear:4", f"SELECT * FROM {SKY}")
def _(t):
    return sunny(t)


@query("fn_solar_generation", WXID + " clear_sky_kwh:4 cloud_factor:5 generation_kwh:4 capacity_factor:5", f"""SELECT *, clear_sky_kwh * cloud_factor AS generation_kwh, clear_sky_kwh * cloud_factor / cap AS capacity_factor FROM (SELECT *, cap * (ghi_clear / 1000.0) * 0.8 AS clear_sky_kwh,
    least(greatest(1.0 - 0.75 * pow(cloud_cover / 100.0, 1.5), 0.1), 1.0) AS cloud_factor FROM {SKY})""")
def _(t):
    return wf.add_solar_generation(sunny(t), "ghi_clear", "cap", "cloud_cover")


@query("fn_price_premium", "location_id:s ts:t price_adj:5 landed:5", """SELECT location_id, ts, p AS price_adj, p / (0.961 * 0.9725 * 0.9728) + 1.19 AS landed FROM (SELECT location_id, ts, CASE WHEN temperature * 1.3 > 35 THEN price + 0.02 * (temperature * 1.3 - 35.0) * price ELSE price END AS p FROM price_series JOIN weather USING (ts))""")
def _(t):
    df = t.price_series.join(t.weather, "ts").withColumn("price_adj", money.hot_premium(F.col("price"), F.col("temperature") * 1.3))
    return df.withColumn("landed", money.landed_cost(F.col("price_adj")))


@query("fn_confidence_weight", "msn:s weight:5 confidence:i", "SELECT msn, greatest(least(1.0 - greatest(mape - 15.0, 0.0) / 15.0, 1.0), 0.5) AS weight, least(greatest(round_even(100.0 - mape, 0), 0), 100) AS confidence FROM registry")
def _(t):
    return t.registry.withColumns({"weight": money.confidence_weight(F.col("mape")), "confidence": text.confidence(F.col("mape"))})


ACTION = "CASE WHEN curtail_kwh * 1000 > 1 THEN 'curtail_solar' WHEN charge_kwh * 1000 > 1 THEN 'charge' WHEN discharge_kwh * 1000 > 1 AND kva_shaved > 5 THEN 'peak_shave' WHEN discharge_kwh * 1000 > 1 THEN 'discharge' ELSE 'hold' END"
AUDIT_SQL = f"""SELECT *, '[' || strftime(ts, '%H:%M') || '] ' || replace(action, '_', ' ') || ' ' || CASE WHEN kwh = floor(kwh) THEN CAST(CAST(kwh AS BIGINT) AS VARCHAR) ELSE printf('%.1f', kwh) END || ' kWh because ' ||
    CASE action WHEN 'charge' THEN CASE WHEN landed_cost - iex_price > 0 THEN 'IEX price ₹' || printf('%.2f', iex_price) || '/kWh is ₹' || printf('%.2f', abs(landed_cost - iex_price)) || ' below landed grid tariff' ELSE 'pre-positioning SOC ahead of peak (IEX ₹' || printf('%.2f', iex_price) || '/kWh)' END
    WHEN 'discharge' THEN CASE WHEN landed_cost - iex_price < 0 THEN 'IEX price ₹' || printf('%.2f', iex_price) || '/kWh is ₹' || printf('%.2f', abs(landed_cost - iex_price)) || ' above landed cost — arbitrage window' ELSE 'discharging into peak demand (IEX ₹' || printf('%.2f', iex_price) || '/kWh)' END
    WHEN 'peak_shave' THEN 'shaving ' || printf('%.0f', kva_shaved) || ' kVA peak (₹' || format('{{:,}}', CAST(kva_shaved * 4800 AS BIGINT)) || '/yr at ₹400.00/kVA)' WHEN 'curtail_solar' THEN 'curtailing solar — grid import cheaper this block'
    ELSE CASE WHEN block_mape > 15 THEN 'holding SOC — block MAPE ' || printf('%.1f', block_mape) || '% above 15% aggression threshold' ELSE 'holding SOC — no commercial edge in this block' END END
    || ' (confidence ' || CAST(CAST(100 - block_mape AS INT) AS VARCHAR) || '%).' AS audit FROM (SELECT *, CASE WHEN action = 'hold' THEN 0.0 ELSE floor(greatest(charge_kwh, discharge_kwh, curtail_kwh) * 10.0) / 10.0 END AS kwh FROM (SELECT *, {ACTION} AS action FROM schedule))"""


def audited(t):
    wh = [F.col(c) * 1000 for c in ("charge_kwh", "discharge_kwh", "curtail_kwh")]
    df = t.schedule.withColumn("action", labels.dispatch_action(*wh, F.col("kva_shaved") - 5.0))
    size = F.floor(F.greatest("charge_kwh", "discharge_kwh", "curtail_kwh") * 10.0) / 10.0
    df = df.withColumn("kwh", F.when(F.col("action") == "hold", 0.0).otherwise(size))
    c = F.col
    return df.withColumn("audit", text.audit_sentence(c("ts"), c("action"), c("kwh"), c("iex_price"), c("landed_cost"), c("block_mape"), c("kva_shaved")))


@query("fn_audit_text", "site_id:s ts:t action:s audit:s", AUDIT_SQL)
def _(t):
    return audited(t)


@query("fn_audit_valid", "site_id:s ts:t is_valid:b", f"""SELECT site_id, ts, regexp_matches(CASE WHEN tag % 4 = 0 THEN replace(audit, 'because', 'as') ELSE audit END, '^\\[\\d{{2}}:\\d{{2}}\\] (charge|discharge|hold|curtail solar|peak shave) \\d+(\\.\\d+)? kWh because .+ \\(confidence \\d{{1,3}}%\\)\\.$') AS is_valid FROM ({AUDIT_SQL})""")
def _(t):
    spoiled = F.when(F.col("tag") % 4 == 0, F.replace("audit", F.lit("because"), F.lit("as"))).otherwise(F.col("audit"))
    return audited(t).withColumn("is_valid", text.is_audit_sentence(spoiled))


@query("fn_firm_quote", "msn:s firmness_pct:4 offered_price:4 rationale:s", """SELECT *, CASE WHEN firmness_pct <= 70 THEN 'A peak-block error of ' || printf('%.2f', m) || '% is too high for more than the floor of 70% firm energy; add storage or contract less power.'
    ELSE 'With a peak-block error of ' || printf('%.2f', m) || '% the supply is ' || printf('%.0f', firmness_pct) || '% firm at ₹' || printf('%.2f', offered_price) || ' per kWh, ₹' || printf('%.2f', 8.20 - offered_price) || ' under the landed price.' END AS rationale FROM (
    SELECT *, greatest(8.20 + (-1.30) + (95.0 - firmness_pct) / 5.0 * 0.40, 4.0) AS offered_price FROM (SELECT msn, peak_mape * 2.0 AS m, greatest(least(95.0, 100.0 - peak_mape * 2.0), 70.0) AS firmness_pct FROM registry))""")
def _(t):
    return money.add_firm_quote(t.registry.withColumn("m", F.col("peak_mape") * 2.0).withColumn("kw", F.lit(100.0)), "m", "kw")


@query("fn_demand_charge", "meter_id:s saving:3 carbon:3", """SELECT meter_id, greatest((p / 0.95 - p * 0.8 / 0.95) * 475.0, 0.0) AS saving, s * (0.82 - 0.05) + s * 0.3 * (0.95 - 0.05) AS carbon FROM (SELECT meter_id, max(demand_kwh) AS p, sum(demand_kwh) AS s FROM readings GROUP BY 1)""")
def _(t):
    df = t.readings.groupBy("meter_id").agg(F.max("demand_kwh").alias("p"), F.sum("demand_kwh").alias("s"))
    return df.withColumns({"saving": money.demand_charge_savings(F.col("p"), F.col("p") * 0.8), "carbon": money.carbon_savings(F.col("s"), F.col("s") * 0.3)})


@query("fn_network_value", "site_id:s demand_share_pct:4 solar_share_pct:4 net_position_kwh:3 is_prosumer:b network_value_inr:3 contribution_score:6", """WITH s AS (SELECT site_id, sum(demand_kwh) AS d, sum(solar_kwh) * CASE WHEN site_id LIKE 'click%' THEN 5.0 ELSE 1.0 END AS sol FROM schedule GROUP BY 1), c AS (SELECT sum(d) AS cd, sum(sol) AS cs FROM s)
    SELECT site_id, d / cd * 100 AS demand_share_pct, sol / cs * 100 AS solar_share_pct, sol - d AS net_position_kwh, sol > d AS is_prosumer, 1000.0 * d / cd * CASE WHEN sol > d THEN 1.5 ELSE 1.0 END AS network_value_inr, d / cd * 0.4 + sol / cs * 0.6 AS contribution_score FROM s, c""")
def _(t):
    boost = F.when(F.col("site_id").like("click%"), 5.0).otherwise(1.0)
    s = t.schedule.groupBy("site_id").agg(F.sum("demand_kwh").alias("d"), F.sum("solar_kwh").alias("raw")).withColumns({"sol": F.col("raw") * boost, "save": F.lit(1000.0)})
    s = s.select("*", s.agg(F.sum("d")).scalar().alias("cd"), s.agg(F.sum("sol")).scalar().alias("cs"))
    return money.add_network_value(s, "d", "cd", "sol", "cs", "save")


@query("fn_log1p", "meter_id:s ts:t use_log:b y:6 back:4", """SELECT meter_id, ts, z > 30 AS use_log, CASE WHEN z > 30 THEN ln(1 + demand_kwh) ELSE demand_kwh END AS y, demand_kwh AS back FROM (SELECT *, 100.0 * count(*) FILTER (demand_kwh < 20) OVER (PARTITION BY meter_id) / count(*) OVER (PARTITION BY meter_id) AS z FROM readings)""")
def _(t):
    z = t.readings.groupBy("meter_id").agg((100.0 * F.count_if(F.col("demand_kwh") < 20) / F.count("*")).alias("z"))
    df = t.readings.join(z, "meter_id").withColumn("use_log", F.col("z") > 30)
    df = df.withColumn("y", F.when(F.col("use_log"), F.log1p("demand_kwh")).otherwise(F.col("demand_kwh")))
    return df.withColumn("back", F.when(F.col("use_log"), F.expm1("y")).otherwise(F.col("y")))


@query("fn_json_records", "event_id:i k:i record:s", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS record FROM events")
def _(t):
    df = t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return df.withColumn("record", F.to_json(F.struct("event_id", "k")))
