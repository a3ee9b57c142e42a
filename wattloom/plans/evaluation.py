"""Replay, holdout and bias evaluation of given forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattloom.operators.accuracy import ape, masked_mape
from wattloom.plans.splits import every_nth_day


def replay(forecast: DataFrame, actual: DataFrame, floor: float = 10.0, min_n: int = 4) -> DataFrame:
    """Forecast against actual per meter with a status; meters without actuals keep their forecast mean."""
    both = forecast.join(actual, ["meter_id", "ts"], "left")
    out = both.groupBy("meter_id").agg(F.count("*").alias("n_points"), F.avg("predicted_kwh").alias("forecast_mean"), F.avg("actual_kwh").alias("actual_mean"), masked_mape("actual_kwh", "predicted_kwh", floor, min_n).alias("mape"))
    return out.withColumn("status", F.when(F.col("actual_mean").isNull(), "no_actuals").otherwise("ok"))


def replay_fleet(meters: DataFrame) -> DataFrame:
    return meters.agg(F.count("*").alias("n_meters"), F.avg("mape").alias("fleet_mape"), F.avg(F.nullif(F.col("forecast_mean"), F.lit(0.0))).alias("fleet_mean"), F.count_if(F.col("status") == "ok").alias("n_ok"))


def holdout_by_cutoff(df: DataFrame, keys: list[str], cutoff: str, every: int = 4, offset: int = 3, min_slots: int = 44, ts: str = "ts") -> DataFrame:
    """Errors on every n-th complete day, over all of them and over those after the training cutoff."""
    test = every_nth_day(df, keys, every, offset, min_slots, ts=ts).filter("split = 'test'")
    late = F.col(ts) > F.lit(cutoff).cast("timestamp")
    err = ape("actual_kwh", "predicted_kwh", 0.5)
    diff = F.col("predicted_kwh") - F.col("actual_kwh")
    return test.groupBy(*keys).agg(
        F.count("*").alias("n_slots"), F.count_if(late).alias("n_clean_slots"), F.avg(err).alias("leaky_mape"), F.avg(F.abs(diff)).alias("leaky_mae"), F.avg(diff).alias("leaky_mbe"),
        F.avg(F.when(late, err)).alias("clean_mape"), F.avg(F.when(late, F.abs(diff))).alias("clean_mae"), F.avg(F.when(late, diff)).alias("clean_mbe"))


def bias_gate(df: DataFrame, keys: list[str], y: str, p: str, val_share: float = 0.15, trail_days: int = 21, damp: float = 0.5, cap: float = 0.30, min_rows: int = 48, min_scored: int = 20, ts: str = "ts") -> DataFrame:
    """Damped, capped trailing bias per key, applied only where it lowers the validation error."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(ts)), F.count("*").over(w)
    df = df.withColumns({"_val": i > F.floor(n * (1.0 - val_share)), "_trail": F.unix_micros(ts) > F.max(F.unix_micros(ts)).over(w) - trail_days * 86_400_000_000})
    a, b = F.col(y), F.greatest(F.col(p), F.lit(0.0))
    stats = df.groupBy(*keys).agg(F.avg(a).alias("_mean"), F.avg(F.when(F.col("_trail"), b - a)).alias("trail_mbe_raw"), F.count_if(F.col("_trail")).alias("_nt"), F.count_if(F.col("_val")).alias("_nv"))
    limit = F.col("_mean") * cap
    stats = stats.withColumn("_c", F.greatest(F.least(F.col("trail_mbe_raw") * damp, limit), -limit))
    val = df.filter("_val").join(stats.select(*keys, "_c"), keys)
    scored = F.col(y) > 0.5
    fixed = F.greatest(b - F.col("_c"), F.lit(0.0))
    val = val.groupBy(*keys).agg(F.count_if(scored).alias("_ns"), F.avg(F.when(scored, F.abs(a - b) / F.nullif(a, F.lit(0.0)) * 100.0)).alias("mape_raw"), F.avg(F.when(scored, F.abs(a - fixed) / F.nullif(a, F.lit(0.0)) * 100.0)).alias("mape_corrected"))
    out = stats.join(val, keys, "left")
    ready = (F.col("_nt") >= min_rows) & (F.col("_nv") >= min_rows) & (F.abs("_c") > 0.5) & (F.col("_ns") >= min_scored)
    better = F.col("mape_corrected") + 0.1 < F.col("mape_raw")
    gate = F.when(ready & better, "applied").when(ready, "gated_out").otherwise("below_threshold")
    return out.withColumn("bias_gate", gate).withColumns({
        "trail_mbe_capped": F.when(F.col("bias_gate") == "applied", F.col("_c")).otherwise(0.0),
        "trail_mbe_raw": F.when(F.col("_nt") >= min_rows, F.col("trail_mbe_raw")).otherwise(0.0)}).drop("_c", "_mean", "_nt", "_nv", "_ns")
