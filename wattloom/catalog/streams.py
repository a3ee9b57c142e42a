"""Streaming jobs drained over the event file to its end and compared with the batch answer."""

from pyspark.sql import functions as F

from wattloom.catalog.registry import query
from wattloom.catalog.rows import SCORE_SQL
from wattloom.session import scratch_path
from wattloom.streaming import jobs


def stream(t):
    return jobs.read_events(t.spark, t.folder)


def ending(t, **values):
    return jobs.EndOfInput(stream(t), **values)


def packets(t, ev=None):
    ev = stream(t) if ev is None else ev
    delay = F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 200 as int), 0)")
    return ev.select(F.col("user_id").cast("string").alias("meter_id"), F.date_trunc("hour", "ts").alias("ts"), (F.col("ts") + delay).alias("arrival_ts"), F.col("value").alias("kw"), "event_id")


PACKETS = "(SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts, ts + to_minutes(event_id % 200) AS arrival_ts, value AS kw, event_id FROM events)"


@query("st_late_filter", "meter_id:s event_id:i ts:t packet_delay_min:6 is_late:b", f"SELECT *, epoch_us(arrival_ts - ts) / 60000000.0 AS packet_delay_min, epoch_us(arrival_ts - ts) / 60000000.0 > 30 AS is_late FROM {PACKETS} WHERE epoch_us(arrival_ts - ts) / 60000000.0 <= 120")
def _(t):
    return jobs.drain(jobs.late_filter(packets(t)), "late")


@query("st_dedupe", "meter_id:s ts:t arrival_ts:t kw:4", f"SELECT meter_id, ts, arrival_ts, kw FROM {PACKETS} QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY arrival_ts DESC, kw DESC) = 1")
def _(t):
    end = ending(t)
    return jobs.drain(jobs.dedupe_latest(packets(t, end.stream), ["meter_id"], "arrival_ts", ["kw"], "2 hours"), "dedupe", end=end)


@query("st_fleet_tumbling", "window_start:t window_end:t fleet_mean:4 fleet_std:4 fleet_count:i", """SELECT * FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS window_start, time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES AS window_end, avg(value) AS fleet_mean, stddev_samp(value) AS fleet_std, count(*) AS fleet_count FROM events GROUP BY 1, 2)
    WHERE fleet_count >= 5""")
def _(t):
    end = ending(t)
    return jobs.drain(jobs.fleet_tumbling(end.stream, "value", "30 minutes", "2 hours"), "fleet", end=end)


@query("st_block_sliding", "event_type:s window_start:t window_end:t base_median:4 base_sigma:4 n_slots:i", """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT event_type, v, time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS window_start FROM h, range(8) r(k))
    SELECT event_type, window_start, window_start + INTERVAL 48 HOURS AS window_end, median(v) AS base_median, stddev_samp(v) AS base_sigma, count(*) AS n_slots FROM x GROUP BY 1, 2""")
def _(t):
    end = ending(t)
    return jobs.drain(jobs.baseline_sliding(end.stream, "event_type", "value", "1 hour", "48 hours", "6 hours", "2 hours"), "baseline", end=end)


@query("st_dg_session", "user_id:s period_start:t last_ts:t n_rows:i", """WITH f AS (SELECT user_id, ts FROM events WHERE event_id % 2 = 0), s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS st FROM f), g AS (SELECT *, sum(st::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
    SELECT user_id, min(ts) AS period_start, max(ts) AS last_ts, count(*) AS n_rows FROM g GROUP BY user_id, g""")
def _(t):
    end = ending(t, event_id=0)
    return jobs.drain(jobs.flagged_sessions(end.stream.filter("event_id % 2 = 0"), "user_id", "6 hours", "2 hours"), "sessions", end=end)


@query("st_quality_score", "packet_id:i line:i kva:4 quality_score:6", SCORE_SQL)
def _(t):
    """Packets land as files in the shared folder and are scored as they arrive."""
    path = scratch_path(t.spark, "lines")
    t.lines.write.parquet(path)
    live = t.spark.readStream.schema(t.lines.schema).parquet(path)
    live = live.withColumn("packet_delay_min", F.col("delay_min")).withColumn("is_late", F.col("delay_min") > 30)
    return jobs.drain(jobs.quality_scores(live), "scores")


@query("st_frozen_state", "user_id:i ts:t level:2 run_length:i is_frozen:b", """WITH b AS (SELECT user_id, ts, floor(value / 60) AS level FROM events), s AS (SELECT *, coalesce(level = lag(level) OVER (PARTITION BY user_id ORDER BY ts), false) AS same FROM b),
    r AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts) - 1 AS run_length FROM r) SELECT *, run_length >= 3 AS is_frozen FROM n""")
def _(t):
    end = ending(t)
    return jobs.drain(jobs.frozen_runs_any_order(end.stream.withColumn("level", F.floor(F.col("value") / 60).cast("double")), "user_id", "level", "2 hours"), "frozen", end=end)
