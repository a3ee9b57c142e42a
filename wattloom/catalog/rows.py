"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from wattloom.catalog.registry import query
from wattloom.functions import labels
from wattloom.operators import ami
from wattloom.operators.grids import one_per_slot


@query("flt_time_slice", "meter_id:s ts:t demand_kwh:4",
       "SELECT meter_id, ts, demand_kwh FROM readings WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-17 00:00:00'")
def _(t):
    return t.hourly_readings(t.read("events", between=("ts", "2024-01-10 00:00:00", "2024-01-17 00:00:00")))


def eligible_meters(df, keys, ts, min_days):
    """Meters whose span in whole days reaches the minimum."""
    span = df.groupBy(*keys).agg(F.floor((F.max(F.unix_seconds(ts)) - F.min(F.unix_seconds(ts))) / F.lit(86400)).alias("days"))
    return df.join(span.filter(F.col("days") >= min_days), keys, "left_semi")


@query("flt_eligible_meters", "meter_id:s ts:t demand_kwh:4", """SELECT r.meter_id, ts, demand_kwh FROM readings r JOIN (
    SELECT meter_id FROM readings GROUP BY 1 HAVING floor((epoch(max(ts)) - epoch(min(ts))) / 86400) >= 27) k USING (meter_id)""")
def _(t):
    return eligible_meters(t.readings, ["meter_id"], "ts", 27)


@query("flt_late_packets", "meter_id:s event_id:i ts:t packet_delay_min:6 is_late:b", """SELECT meter_id, event_id, ts,
    epoch_us(arrival_ts - ts) / 60000000.0 AS packet_delay_min, epoch_us(arrival_ts - ts) / 60000000.0 > 30 AS is_late
    FROM packets WHERE epoch_us(arrival_ts - ts) / 60000000.0 <= 120""")
def _(t):
    return ami.flag_late(t.packets)


LINE_ID = "packet_id:i line:i meter_id:s kva:4"


@query("prj_channel_sync", LINE_ID + " channels_complete:b",
       "SELECT *, kw IS NOT NULL AND kvar IS NOT NULL AND kva IS NOT NULL AND voltage IS NOT NULL AND pf IS NOT NULL AS channels_complete FROM lines")
def _(t):
    return ami.sync_channels(t.lines)


@query("prj_range_validate", LINE_ID + " kw_range_valid:b voltage_range_valid:b pf_range_valid:b", """SELECT *,
    coalesce(kw BETWEEN 0 AND 50000, true) AS kw_range_valid, coalesce(voltage BETWEEN 300 AND 500, true) AS voltage_range_valid,
    coalesce(pf BETWEEN 0 AND 1, true) AS pf_range_valid FROM lines""")
def _(t):
    return ami.check_limits(t.lines)


CONSISTENT = """(CASE WHEN kva > 0 THEN coalesce(abs(sqrt(kw * kw + kvar * kvar) - kva) / kva <= 0.05, false) ELSE true END
    AND CASE WHEN kva > 0 AND pf IS NOT NULL THEN coalesce(abs(kw / kva - pf) <= 0.05, false) ELSE true END)"""


@query("prj_phys_consistency", LINE_ID + " physically_consistent:b", f"SELECT *, {CONSISTENT} AS physically_consistent FROM lines")
def _(t):
    return ami.check_consistency(t.lines)


def scored(lines):
    df = ami.sync_channels(lines.withColumn("packet_delay_min", F.col("delay_min")).withColumn("is_late", F.col("delay_min") > 30))
    return ami.interval_score(ami.check_consistency(ami.check_limits(df)))


SCORE_SQL = f"""SELECT *, 0.4 * ((kw IS NOT NULL)::INT + (kvar IS NOT NULL)::INT + (kva IS NOT NULL)::INT + (voltage IS NOT NULL)::INT + (pf IS NOT NULL)::INT) / 5.0
    + 0.3 * CASE WHEN delay_min > 30 THEN 1.0 - 0.5 * (least(greatest(delay_min, 30.0), 120.0) - 30.0) / 90.0 ELSE 1.0 END
    + 0.2 * ((coalesce(kw BETWEEN 0 AND 50000, true))::INT + (coalesce(kvar BETWEEN -20000 AND 20000, true))::INT + (coalesce(kva BETWEEN 0 AND 50000, true))::INT
        + (coalesce(voltage BETWEEN 300 AND 500, true))::INT + (coalesce(pf BETWEEN 0 AND 1, true))::INT) / 5.0
    + 0.1 * ({CONSISTENT})::INT AS quality_score FROM lines"""


@query("prj_quality_score", LINE_ID + " quality_score:6", SCORE_SQL)
def _(t):
    return scored(t.lines)


@query("prj_scenario_alias", "meter_id:s ts:t scenario:s energy_kwh:6", """SELECT meter_id, ts, 'pessimistic' AS scenario, q10_kwh AS energy_kwh FROM fc
    UNION ALL SELECT meter_id, ts, 'bau', predicted_kwh FROM fc UNION ALL SELECT meter_id, ts, 'optimistic', q90_kwh FROM fc""")
def _(t):
    return labels.scenarios(t.fc.drop("actual_kwh"), ["meter_id", "ts"])


@query("prj_scenario_select", "meter_id:s ts:t scenario:s energy_kwh:6", "SELECT meter_id, ts, 'pessimistic' AS scenario, q10_kwh AS energy_kwh FROM fc")
def _(t):
    return labels.scenarios(t.fc.drop("actual_kwh"), ["meter_id", "ts"]).filter(F.col("scenario") == labels.resolve_scenario("p10"))


@query("prj_clean_forecast", "packet_id:i line:i mid:6 lo:6 hi:6", """SELECT packet_id, line, mid, least(lo, mid) AS lo, greatest(hi, mid) AS hi FROM (
    SELECT packet_id, line, greatest(coalesce(kw - 100.0, 0.0), 0.0) AS mid, greatest(voltage - 300.0, 0.0) AS lo, greatest(kva - 200.0, 0.0) AS hi FROM lines)""")
def _(t):
    raw = t.lines.select("packet_id", "line", (F.col("kw") - 100.0).alias("mid"), (F.col("voltage") - 300.0).alias("lo"), (F.col("kva") - 200.0).alias("hi"))
    return labels.clean_forecast(raw, "mid", "lo", "hi")


@query("prj_nan_to_zero", "packet_id:i line:i kw:4 pf:6", "SELECT packet_id, line, coalesce(kw, 0.0) AS kw, coalesce(pf, 0.0) AS pf FROM lines")
def _(t):
    return t.lines.fillna(0.0, subset=["kw", "pf"])


@query("prj_tier_classify", "meter_id:s mean_wh:4 tier:s", """SELECT *, CASE WHEN mean_wh > 5000 THEN 'HT (>5kWh)' WHEN mean_wh > 1500 THEN 'Large (1.5-5k)'
    WHEN mean_wh > 500 THEN 'Medium (0.5-1.5k)' ELSE 'Small (<500)' END AS tier FROM (SELECT meter_id, avg(demand_kwh) * 20.0 AS mean_wh FROM readings GROUP BY 1)""")
def _(t):
    return t.readings.groupBy("meter_id").agg((F.avg("demand_kwh") * 20.0).alias("mean_wh")).withColumn("tier", labels.tier(F.col("mean_wh")))


@query("prj_cohort_ad", "msn:s mape:2 cohort:s", "SELECT msn, mape, CASE WHEN mape < 5 THEN 'A' WHEN mape < 15 THEN 'B' WHEN mape < 25 THEN 'C' ELSE 'D' END AS cohort FROM registry")
def _(t):
    return t.registry.withColumn("cohort", labels.cohort(F.col("mape")))


@query("prj_cohort_bands", "msn:s band:s", """SELECT msn, CASE WHEN k % 13 = 0 THEN 'X: invalid' WHEN mape < 4 THEN 'A: <4% (target)' WHEN mape < 5 THEN 'A'': 4-5%'
    WHEN mape < 10 THEN 'B: 5-10%' WHEN mape < 15 THEN 'C: 10-15%' WHEN mape < 25 THEN 'D: 15-25%' ELSE 'E: >=25%' END AS band FROM registry""")
def _(t):
    return t.registry.withColumn("m", F.when(F.col("k") % 13 != 0, F.col("mape"))).withColumn("band", labels.cohort_band(F.col("m")))


@query("prj_health", "msn:s health:s brief_health:s", """SELECT msn, CASE WHEN mape < 8 THEN 'green' WHEN mape < 12 THEN 'amber' ELSE 'red' END AS health,
    CASE WHEN peak_mape < 4 THEN 'green' WHEN peak_mape < 8 THEN 'amber' ELSE 'red' END AS brief_health FROM registry""")
def _(t):
    return t.registry.withColumns({"health": labels.health(F.col("mape")), "brief_health": labels.health(F.col("peak_mape"), 4.0, 8.0)})


@query("prj_intermittency", "meter_id:s zero_pct:2 regime:s use_two_stage:b", """SELECT *, CASE WHEN zero_pct < 5 THEN 'continuous' WHEN zero_pct < 15 THEN 'sparse' ELSE 'intermittent' END AS regime,
    zero_pct >= 15 AS use_two_stage FROM (SELECT meter_id, 100.0 * count(*) FILTER (demand_kwh < 4.0) / count(*) AS zero_pct FROM readings GROUP BY 1)""")
def _(t):
    share = 100.0 * F.count_if(F.col("demand_kwh") < 4.0) / F.count("*")
    out = t.readings.groupBy("meter_id").agg(share.alias("zero_pct"))
    return out.withColumns({"regime": labels.regime(F.col("zero_pct")), "use_two_stage": F.col("zero_pct") >= 15})


@query("prj_dispatch_action", "site_id:s ts:t action:s", """SELECT site_id, ts, CASE WHEN curtail_kwh * 1000 > 1 THEN 'curtail_solar' WHEN charge_kwh * 1000 > 1 THEN 'charge'
    WHEN discharge_kwh * 1000 > 1 AND kva_shaved > 0 THEN 'peak_shave' WHEN discharge_kwh * 1000 > 1 THEN 'discharge' ELSE 'hold' END AS action FROM schedule""")
def _(t):
    wh = {c: F.col(c) * 1000 for c in ("charge_kwh", "discharge_kwh", "curtail_kwh")}
    return t.schedule.withColumn("action", labels.dispatch_action(wh["charge_kwh"], wh["discharge_kwh"], wh["curtail_kwh"], F.col("kva_shaved")))


@query("prj_strategy_tags", "meter_id:s ts:t predicted_kwh:6 strategy:s model_version:s", """SELECT meter_id, ts, round(predicted_kwh / 1000.0, 6) AS predicted_kwh,
    'seasonal_anchor' AS strategy, 'v5' AS model_version FROM fc""")
def _(t):
    return t.fc.withColumns({"predicted_kwh": F.round(F.col("predicted_kwh") / 1000.0, 6), "strategy": F.lit("seasonal_anchor"), "model_version": F.lit("v5")})


@query("flt_point_lookup", "meter_id:s ts:t predicted_kwh:4",
       "SELECT meter_id, ts, predicted_kwh FROM fc WHERE meter_id = 'click-1' AND ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00'")
def _(t):
    return t.fc.filter((F.col("meter_id") == "click-1") & F.col("ts").between(F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-21 23:59:59").cast("timestamp")))


@query("set_dedupe_latest", "meter_id:s ts:t arrival_ts:t kw:4", """SELECT meter_id, ts, arrival_ts, kw FROM packets
    QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY arrival_ts DESC, kw DESC, event_id DESC) = 1""")
def _(t):
    return one_per_slot(t.packets.select("meter_id", "ts", "arrival_ts", "kw", "event_id"), ["meter_id", "ts"], prefer="arrival_ts")
