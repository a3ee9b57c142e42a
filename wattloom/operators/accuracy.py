"""Forecast accuracy by point, block, cohort, horizon and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom import constants as K
from wattloom.functions.calendar import block_start, day_block, slot_ids
from wattloom.operators.quantiles import attach_quantiles
from wattloom.session import cut_lineage

BLOCK_ID = {"dam_15min": "block_id_15min", "native_30min": "block_id_30min", "hourly": "block_id_hour", "tod_4h": "block_id_tod"}


def ape(y: str, p: str, floor: float) -> Column:
    """Absolute percentage error where the actual exceeds the floor."""
    return F.when(F.col(y) > floor, F.abs(F.col(y) - F.col(p)) / F.nullif(F.col(y), F.lit(0.0)) * 100.0)


def masked_mape(y: str, p: str, floor: float, min_n: int = 1, empty: float | None = None) -> Column:
    err = ape(y, p, floor)
    found = F.when(F.count(err) >= min_n, F.avg(err))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def point_metrics(df: DataFrame, keys: list[str], y: str, p: str, low: str | None = None, high: str | None = None, zero: float = 0.5) -> DataFrame:
    """Every point metric of each key from one aggregate."""
    a, b = F.col(y), F.col(p)
    err = ape(y, p, zero)
    n = F.count("*")
    res, tot = F.sum((a - b) * (a - b)), F.var_pop(y) * n
    out = {
        "mape": F.coalesce(F.avg(err), F.lit(0.0)), "mae": F.avg(F.abs(a - b)), "mbe": F.avg(b - a), "rmse": F.sqrt(F.avg((a - b) * (a - b))),
        "r2": F.when(tot > 1e-12, 1.0 - res / F.nullif(tot, F.lit(0.0))).otherwise(0.0),
        "within5": F.coalesce(100.0 * F.count_if(err <= 5) / F.nullif(F.count(err), F.lit(0)), F.lit(0.0)),
        "within10": F.coalesce(100.0 * F.count_if(err <= 10) / F.nullif(F.count(err), F.lit(0)), F.lit(0.0)),
        "smape": 100.0 * F.avg(2.0 * F.abs(a - b) / F.greatest(F.abs(a) + F.abs(b), F.lit(0.5))),
        "wape": F.coalesce(100.0 * F.sum(F.abs(a - b)) / F.nullif(F.sum(F.abs(a)), F.lit(0.0)), F.lit(0.0)),
        "n": n, "n_nonzero": F.count_if(a > zero), "zero_pct": 100.0 * (1.0 - F.count_if(a > zero) / n),
        "coverage_80": 100.0 * F.avg(a.between(F.col(low), F.col(high)).cast("double")) if low and high else F.lit(0.0),
    }
    return df.groupBy(*keys).agg(*[e.alias(name) for name, e in out.items()])


def day_block_metrics(df: DataFrame, keys: list[str], y: str, p: str, min_n: int = 5, ts: str = "ts") -> DataFrame:
    """Error per named day block, one column group per block; null below the minimum count."""
    blocks = [*K.DAY_BLOCKS, K.NIGHT_BLOCK]
    rows = F.count(F.lit(1))
    enough = rows >= min_n
    long = df.withColumn("_block", day_block(F.hour(ts))).groupBy(*keys).pivot("_block", blocks)
    return long.agg(
        F.when(enough, masked_mape(y, p, 0.5, empty=0.0)).alias("mape"), F.when(enough, F.avg(F.abs(F.col(y) - F.col(p)))).alias("mae"),
        F.when(enough, F.avg(F.col(p) - F.col(y))).alias("mbe"), rows.alias("n"), F.when(enough, F.avg(y)).alias("mean_demand"),
    )


def block_accuracy(forecast: DataFrame, actual: DataFrame, cadences: list[str], native_minutes: int = 30, key: str = "meter_id", ts: str = "ts") -> DataFrame:
    """Energy per meter and block with its errors; near-zero blocks are dropped after aggregation.

    One join and one aggregate serve all cadences: a joined row is repeated per cadence (twice, halved, where a block is
    half a slot) and combined on the map side.
    """
    both = forecast.select(key, ts, "predicted_kwh").join(actual.select(key, ts, "actual_kwh"), [key, ts])
    parts = []
    for c in cadences:
        offsets = (0, 15) if c == "dam_15min" and native_minutes == 30 else (0,)
        parts += [F.struct(F.lit(c).alias("cadence"), F.lit(m * 60_000_000).cast("bigint").alias("shift"), F.lit(1.0 / len(offsets)).alias("share")) for m in offsets]
    rows = both.withColumn("_p", F.explode(F.array(*parts))).withColumn("_ts", F.timestamp_micros(F.unix_micros(ts) + F.col("_p.shift")))
    start, ids = F.lit(None).cast("timestamp"), F.lit(None).cast("int")
    for c in cadences:
        start = F.when(F.col("_p.cadence") == c, block_start("_ts", c)).otherwise(start)
        ids = F.when(F.col("cadence") == c, slot_ids("block_start_ts")[BLOCK_ID[c]]).otherwise(ids)
    energy = {c: F.sum(F.col(c) * F.col("_p.share")).alias(c) for c in ("predicted_kwh", "actual_kwh")}
    blocks = rows.groupBy(key, F.col("_p.cadence").alias("cadence"), start.alias("block_start_ts")).agg(*energy.values())
    err = F.col("predicted_kwh") - F.col("actual_kwh")
    base = F.greatest(F.abs("actual_kwh"), F.lit(K.ZERO_LOAD_KWH))
    return blocks.filter(F.col("actual_kwh") >= K.ZERO_LOAD_KWH).select(
        key, ids.alias("block_id"), "block_start_ts", "predicted_kwh", "actual_kwh", F.abs(err).alias("abs_error_kwh"),
        (100.0 * F.abs(err) / base).alias("ape"), err.alias("mbe_kwh"), (100.0 * err / base).alias("signed_pct_error"), "cadence",
    )


def _distinct_meters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Meters and blocks per key by two hash aggregates, without a distinct set per group."""
    per_meter = df.groupBy(*keys, "meter_id").agg(F.count("*").alias("_c"), F.sum("ape").alias("_a"), F.sum("mbe_kwh").alias("_b"), F.max("ape").alias("_m"))
    return per_meter.groupBy(*keys).agg(
        (F.sum("_a") / F.sum("_c")).alias("mean_mape"), (F.sum("_b") / F.sum("_c")).alias("mbe_kwh"), F.max("_m").alias("max_mape"),
        F.sum("_c").alias("n_blocks"), F.count("*").alias("n_meters"),
    )


def cohort_rollup(blocks: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile per cohort and cadence; meters without a cohort are dropped."""
    df = blocks.join(cohorts.select("meter_id", "cohort"), "meter_id").select("cohort", "cadence", "meter_id", "ape", "mbe_kwh")
    keys = ["cohort", "cadence"]
    return attach_quantiles(df, lambda d: _distinct_meters(d, keys).drop("max_mape"), keys, "ape", {"median_mape": 0.5, "p95_mape": 0.95})


def fleet_mape(blocks: DataFrame) -> DataFrame:
    df = blocks.select("meter_id", "ape", "mbe_kwh")
    probs = {"median_mape": 0.5, "p25_mape": 0.25, "p75_mape": 0.75, "p95_mape": 0.95}
    return attach_quantiles(df, lambda d: _distinct_meters(d, []), [], "ape", probs)


def meter_cadence_summary(blocks: DataFrame) -> DataFrame:
    """Per meter and cadence; a group holds at most one row per block of the calendar."""
    q = F.percentile("ape", F.array(F.lit(0.5), F.lit(0.95)))
    return blocks.groupBy("meter_id", "cadence").agg(
        F.avg("ape").alias("mean_ape"), q[0].alias("median_ape"), q[1].alias("p95_ape"), F.sum("predicted_kwh").alias("total_predicted"),
        F.sum("actual_kwh").alias("total_actual"), F.count("*").alias("n_blocks"), (F.avg(F.when(F.col("ape") < 5, 1.0).otherwise(0.0)) * 100.0).alias("under_5pct"),
    )


def horizon_rows(df: DataFrame, origin: Column, ts: str = "ts") -> DataFrame:
    """Error, bias and in-band flag per meter and time with the lead time in hours."""
    a = F.col("actual_kwh")
    return df.withColumns({
        "lead_h": (F.unix_seconds(ts) - F.unix_seconds(origin)) / 3600.0, "mbe_kwh": F.col("predicted_kwh") - a,
        "mape": F.when(a >= K.ZERO_LOAD_KWH, 100.0 * F.abs(F.col("predicted_kwh") - a) / F.nullif(a, F.lit(0.0))),
        "in_band": a.between(F.col("q10_kwh"), F.col("q90_kwh")).cast("int"),
    })


def horizon_summary(rows: DataFrame) -> DataFrame:
    return rows.filter("mape is not null").groupBy("meter_id").agg(
        F.avg("mape").alias("mape_7d"), F.percentile("mape", F.lit(0.95)).alias("mape_p95"), F.avg("mbe_kwh").alias("mbe_kwh_mean"),
        F.avg("in_band").alias("cov_q10_q90"), F.count("*").alias("n"),
    )


def lead_bucket(lead: Column) -> Column:
    return F.when(lead.between(0, 24), "0-24h").when((lead > 24) & (lead <= 72), "24-72h").when((lead > 72) & (lead <= 168), "72h-7d")


def horizon_decay(rows: DataFrame, keys: list[str]) -> DataFrame:
    err = ape("actual_kwh", "predicted_kwh", 0.5)
    buckets = ["0-24h", "24-72h", "72h-7d"]
    out = rows.withColumn("_b", lead_bucket(F.col("lead_h"))).filter("_b is not null").groupBy(*keys).pivot("_b", buckets).agg(F.avg(err))
    return out.withColumnsRenamed({"0-24h": "mape_0_24h", "24-72h": "mape_24_72h", "72h-7d": "mape_72h_7d"})


def origin_rollups(df: DataFrame) -> DataFrame:
    """MAPE by meter across origins, by origin across meters and over the fleet."""
    stats = lambda d: d.agg(
        F.count("*").alias("n"), F.avg("mape").alias("mape_mean"), F.stddev_samp("mape").alias("mape_std"), F.min("mape").alias("mape_min"), F.max("mape").alias("mape_max"),
        F.count_if(F.col("mape") < 4).alias("under_4pct"), F.count_if(F.col("mape") < 10).alias("under_10pct"),
    )
    probs = {"mape_median": 0.5, "mape_p90": 0.9}
    df = cut_lineage(df.select("meter_id", "origin", "mape"), "origins")
    q = df.groupBy("meter_id").agg(F.percentile("mape", F.array(F.lit(0.5), F.lit(0.9))).alias("_q"))
    meter = stats(df.groupBy("meter_id")).join(q, "meter_id").withColumns({"mape_median": F.col("_q")[0], "mape_p90": F.col("_q")[1], "level": F.lit("meter")}).drop("_q").withColumnRenamed("meter_id", "item")
    origin = attach_quantiles(df, lambda d: stats(d.groupBy("origin")), ["origin"], "mape", probs, materialised=True).withColumns({"level": F.lit("origin"), "item": F.date_format("origin", "yyyy-MM-dd")}).drop("origin")
    fleet = attach_quantiles(df, lambda d: stats(d.groupBy()), [], "mape", probs, materialised=True).withColumns({"level": F.lit("fleet"), "item": F.lit("fleet")})
    return meter.unionByName(origin).unionByName(fleet)
