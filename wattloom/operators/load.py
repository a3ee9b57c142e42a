"""Load curves: peaks, diversity, resampling, pooling, profiles, fits, registry and forecast rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom import constants as K
from wattloom.functions.labels import health
from wattloom.operators.accuracy import ape, masked_mape
from wattloom.operators.frames import ordered
from wattloom.operators.quantiles import merge_single_rows


def first_peak(value: Column, ts: str = "ts") -> Column:
    """Largest value with its earliest time, as a struct ``(v, t)``."""
    best = F.max(F.struct(value.alias("v"), (-F.unix_micros(ts)).alias("t")))
    return F.struct(best["v"].alias("v"), F.timestamp_micros(-best["t"]).alias("t"))


def derived_load(df: DataFrame, keys: list[str], wh: str, slot_hours: float = 0.5, ts: str = "ts") -> DataFrame:
    kw = F.col(wh) * K.WH_PER_HALF_HOUR_TO_KW
    out = df.groupBy(*keys).agg(first_peak(kw, ts).alias("_p"), F.avg(kw).alias("average_kw"), (F.sum(wh) / 1000.0).alias("total_energy_kwh"), (F.count("*") * slot_hours).alias("horizon_hours"))
    peak = F.col("_p.v")
    return out.withColumns({
        "peak_kw": peak, "peak_ts": F.when(peak > 0, F.col("_p.t")), "load_factor": F.when(peak > 0, F.col("average_kw") / F.nullif(peak, F.lit(0.0))).otherwise(0.0),
    }).drop("_p")


def diversity(df: DataFrame, key: str, wh: str, ts: str = "ts") -> DataFrame:
    """Sum of individual peaks over the coincident peak; an absent slot counts as 0."""
    kw = F.col(wh) * K.WH_PER_HALF_HOUR_TO_KW
    single = df.groupBy(key).agg(F.max(kw).alias("p")).agg(F.sum(F.greatest("p", F.lit(0.0))).alias("sum_individual_peaks"))
    total = df.groupBy(ts).agg(F.sum(kw).alias("s")).agg(first_peak(F.col("s"), ts).alias("c"))
    total = total.select(F.col("c.v").alias("coincident_peak_kw"), F.col("c.t").alias("coincident_ts"))
    top = F.col("coincident_peak_kw")
    ratio = F.when(top > 0, F.col("sum_individual_peaks") / F.nullif(top, F.lit(0.0))).otherwise(0.0)
    return merge_single_rows(single, total).withColumn("diversity_factor", ratio)


def resample_sum(df: DataFrame, keys: list[str], value: str, minutes: int, ts: str = "ts") -> DataFrame:
    """Sum to a coarser step; a step without any value stays null."""
    step = minutes * 60_000_000
    t = F.unix_micros(ts)
    return df.groupBy(*keys, F.timestamp_micros(t - F.pmod(t, F.lit(step))).alias(ts)).agg(F.sum(value).alias(value))


def mean_pool(df: DataFrame, keys: list[str], value: str, k: int, ts: str = "ts") -> DataFrame:
    """Mean of every k rows; an incomplete last pool is dropped."""
    df = df.withColumn("pool", F.floor((F.row_number().over(ordered(keys, ts)) - 1) / F.lit(k)))
    return df.groupBy(*keys, "pool").agg(F.avg(value).alias("pooled"), F.min(ts).alias("pool_ts"), F.count("*").alias("_n")).filter(F.col("_n") == k).drop("_n")


def fleet_series(df: DataFrame, keys: list[str], value: str, smooth: int = 8, sample: int = 4, ts: str = "ts") -> DataFrame:
    """Fleet sum per time, smoothed over the last rows and sampled; one row per time enters the window."""
    total = df.groupBy(*keys, ts).agg(F.sum(value).alias("fleet_kwh"))
    w = ordered(keys, ts)
    total = total.withColumns({"smoothed": F.avg("fleet_kwh").over(w.rowsBetween(-(smooth - 1), 0)), "_i": F.row_number().over(w) - 1})
    return total.filter(F.col("_i") % sample == 0).drop("_i")


def slot_profile(df: DataFrame, keys: list[str], value: str, weeks: int = 4, min_rows: int = 96, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Median, q10 and q90 by weekday, hour and minute over the trailing weeks, and the overall level per key.

    Keys with too few rows in the trailing weeks use all of theirs.  A profile group holds one row per week.
    """
    w = Window.partitionBy(*keys)
    recent = F.unix_micros(ts) >= F.max(F.unix_micros(ts)).over(w) - weeks * 7 * 86_400_000_000
    df = df.filter(F.col(value).isNotNull()).withColumn("_recent", recent)
    df = df.withColumn("_nr", F.sum(F.col("_recent").cast("int")).over(w))
    df = df.filter(F.col("_recent") | (F.col("_nr") < min_rows)).drop("_nr", "_recent")
    slot = [F.weekday(ts).alias("dow"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute")]
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    profile = df.groupBy(*keys, *slot).agg(q.alias("_q")).select(*keys, "dow", "hour", "minute", F.col("_q")[1].alias("mean_kwh"), F.col("_q")[0].alias("q10_kwh"), F.col("_q")[2].alias("q90_kwh"))
    level = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("level"))
    return profile, level


def temperature_fit(df: DataFrame, keys: list[str], y: str = "demand_kwh", x: str = "temperature", min_n: int = 20, min_range: float = 1.0) -> DataFrame:
    """Ordinary least squares by key; too few rows or a flat regressor give slope 0 and the mean."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("_r"), F.avg(y).alias("_m"))
    ok = (F.col("n") >= min_n) & (F.col("_r") >= min_range)
    return out.select(*keys, "n", F.when(ok, F.col("_s")).otherwise(0.0).alias("slope"), F.when(ok, F.col("_i")).otherwise(F.col("_m")).alias("intercept"))


def calibrate(df: DataFrame, key: str, voltage: str, error: str, degree: int = 2, min_points: int = 100, nominal: float = K.NOMINAL_VOLTAGE) -> DataFrame:
    """Per-site polynomial of state-of-charge error on voltage deviation from power sums (Cramer's rule)."""
    x, e = F.col(voltage) - nominal, F.col(error)
    df = df.filter(F.col(voltage).isNotNull() & F.col(error).isNotNull()).withColumn("_x", x)
    x = F.col("_x")
    s = df.groupBy(key).agg(
        F.count("*").alias("n_points"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"),
        F.sum(e).alias("t0"), F.sum(e * x).alias("t1"), F.sum(e * x * x).alias("t2"), F.avg(F.abs(e)).alias("mean_error_before"), F.var_pop(e).alias("_ve"),
        F.min(voltage).alias("v_min"), F.max(voltage).alias("v_max"),
    )
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n_points", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det1 = n * s2 - s1 * s1
    lin = {"c1": (n * t1 - s1 * t0) / F.when(F.abs(det1) > 1e-9, det1)}
    det2 = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    d2 = F.when(F.abs(det2) > 1e-6, det2)
    quad = {
        "c0": (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d2,
        "c1": (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / d2,
        "c2": (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / d2,
    }
    use2 = (n >= min_points) if degree == 2 else F.lit(False)
    coef = s.withColumns({
        "c1": F.when(use2, quad["c1"]).otherwise(lin["c1"]), "c2": F.when(use2, quad["c2"]).otherwise(0.0),
        "c0": F.when(use2, quad["c0"]).otherwise((t0 - lin["c1"] * s1) / n), "degree": F.when(use2, 2).otherwise(1),
    }).select(key, "n_points", "c0", "c1", "c2", "degree", "mean_error_before", "_ve", "v_min", "v_max")
    res = F.col(error) - (F.col("c0") + F.col("c1") * F.col("_x") + F.col("c2") * F.col("_x") * F.col("_x"))
    after = df.join(coef.select(key, "c0", "c1", "c2"), key).groupBy(key).agg(
        F.avg(F.abs(res)).alias("mean_residual_after"), F.max(F.abs(res)).alias("max_residual"), F.avg(res * res).alias("_mse"))
    out = coef.join(after, key)
    return out.withColumn("r_squared", F.when(F.col("_ve") > 1e-12, 1.0 - F.col("_mse") / F.nullif(F.col("_ve"), F.lit(0.0))).otherwise(0.0)).drop("_ve", "_mse")


def correct_soc(df: DataFrame, coef: DataFrame, key: str, voltage: str, soc: str, nominal: float = K.NOMINAL_VOLTAGE) -> DataFrame:
    """Corrected state of charge in [0, 100]; sites without a calibration keep theirs."""
    x = F.col(voltage) - nominal
    err = F.coalesce(F.col("c0") + F.col("c1") * x + F.col("c2") * x * x, F.lit(0.0))
    out = df.join(coef.select(key, "c0", "c1", "c2"), key, "left")
    return out.withColumn("corrected_soc", F.least(F.greatest(F.col(soc) - err, F.lit(0.0)), F.lit(100.0))).drop("c0", "c1", "c2")


def calibration_drift(df: DataFrame, keys: list[str], residual: str, threshold: float = 2.0, days: int = 7, ts: str = "ts") -> DataFrame:
    """Whether the daily mean residual exceeds the threshold on enough days in a row."""
    daily = df.groupBy(*keys, F.date_trunc("day", F.col(ts)).alias("day")).agg((F.avg(F.abs(residual)) > threshold).alias("_x"))
    first_day, run = F.unix_date(F.to_date("day")), ordered(keys, "day")
    hit = daily.filter("_x").withColumn("_g", first_day - F.row_number().over(run))
    longest = hit.groupBy(*keys, "_g").agg(F.count("*").alias("_r")).groupBy(*keys).agg(F.max("_r").alias("longest_run"))
    span = daily.groupBy(*keys).agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("n_days"), F.count_if(F.col("_x")).alias("days_over"))
    out = span.join(longest, keys, "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
    short = F.col("n_days") < days
    return out.withColumn("has_drifted", F.when(short, F.col("days_over") == F.col("n_days")).otherwise(F.col("longest_run") >= days))


def registry_summary(reg: DataFrame) -> DataFrame:
    """Fleet statistics without quantiles; peak statistics ignore zeros."""
    peak = F.nullif(F.col("peak_mape"), F.lit(0.0))
    h = health(F.col("mape"))
    return reg.agg(
        F.count("*").alias("n_meters"), F.avg("mape").alias("mean_mape"), F.avg(peak).alias("mean_peak_mape"), F.min(peak).alias("min_peak_mape"), F.max(peak).alias("max_peak_mape"),
        *[F.count_if(h == c).alias(f"n_{c}") for c in ("green", "amber", "red")],
        *[F.count_if(F.col("tier").startswith(t)).alias(f"n_{t.lower()}") for t in ("HT", "Large", "Medium", "Small")],
    )


def strategy_totals(df: DataFrame, strategies: list[str]) -> DataFrame:
    """Totals per meter and strategy side by side with the disagreement of the first two."""
    a, b = (F.col(f"total_{s}") for s in strategies[:2])
    out = df.groupBy("meter_id").pivot("strategy", strategies).agg(F.sum("predicted_kwh")).withColumnsRenamed({s: f"total_{s}" for s in strategies})
    pct = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / F.greatest((a + b) / 2.0, F.lit(1e-9)) * 100.0)
    return out.withColumn("ab_pct", pct).withColumn("best_agree", F.coalesce(F.col("ab_pct") < 5, F.lit(False)))


def headline(df: DataFrame) -> DataFrame:
    """Per strategy: total, peak day and peak hour of day, from one reduction to (strategy, day, hour)."""
    base = df.groupBy("strategy", F.date_trunc("day", "ts").alias("day"), F.hour("ts").alias("hod")).agg(F.sum("predicted_kwh").alias("k"))
    day = base.groupBy("strategy", "day").agg(F.sum("k").alias("k"))
    hour = base.groupBy("strategy", "hod").agg(F.sum("k").alias("k"))
    best_day = day.groupBy("strategy").agg(F.sum("k").alias("total_kwh"), first_peak(F.col("k"), "day").alias("p"))
    best_hour = hour.groupBy("strategy").agg((-F.max(F.struct("k", (-F.col("hod")).alias("h")))["h"]).alias("peak_hod"))
    return best_day.join(best_hour, "strategy").select("strategy", "total_kwh", F.col("p.t").alias("peak_day"), F.col("p.v").alias("peak_day_kwh"), "peak_hod")


def strategy_rollup(df: DataFrame) -> DataFrame:
    """Totals per strategy with distinct meters and energy per slot, without distinct sets."""
    meters = df.groupBy("strategy", "meter_id").agg(F.sum("predicted_kwh").alias("k"), F.count("*").alias("c"))
    total = meters.groupBy("strategy").agg(F.sum("k").alias("total_kwh"), (F.sum("k") / F.sum("c")).alias("mean_kwh"), F.sum("c").alias("n_rows"), F.count("*").alias("n_meters"))
    slots = df.groupBy("strategy", "ts").agg(F.count("*").alias("c")).groupBy("strategy").agg(F.count("*").alias("n_slots"))
    return total.join(slots, "strategy").withColumn("kwh_per_slot", F.col("total_kwh") / F.col("n_slots"))


def daily_errors(df: DataFrame, y: str, p: str, ts: str = "ts") -> DataFrame:
    """MAPE of daily totals, of peak and off-peak hours and by hour of day, as one long table.

    All three read one reduction to (meter, day, hour), whose shuffle Spark reuses.
    """
    err = ape(y, p, 0.0)
    base = df.groupBy("meter_id", F.date_trunc("day", F.col(ts)).alias("d"), F.hour(ts).alias("h")).agg(F.sum(y).alias(y), F.sum(p).alias(p), F.sum(err).alias("e"), F.count(err).alias("n"))
    daily = base.groupBy("meter_id", "d").agg(F.sum(y).alias(y), F.sum(p).alias(p))
    mean = (F.sum("e") / F.nullif(F.sum("n"), F.lit(0))).alias("mape")
    period = F.when(F.col("h").between(9, 20), "peak").otherwise("off_peak")
    parts = [
        daily.groupBy(F.lit("daily_total").alias("kind"), F.lit("all").alias("item")).agg(masked_mape(y, p, 0.0).alias("mape")),
        base.groupBy(F.lit("period").alias("kind"), period.alias("item")).agg(mean),
        base.groupBy(F.lit("hour").alias("kind"), F.col("h").cast("string").alias("item")).agg(mean),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def spaced_days(df: DataFrame, keys: list[str], max_days: int, ts: str = "ts") -> DataFrame:
    """Rows of at most ``max_days`` days per key, evenly spaced over the days present."""
    days = df.groupBy(*keys, F.date_trunc("day", F.col(ts)).alias("_d")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.count("*").over(w) / F.lit(max_days)), F.lit(1))
    i = F.row_number().over(w.orderBy("_d")) - 1
    days = days.withColumns({"_i": i, "_step": step}).filter((F.col("_i") % F.col("_step") == 0) & (F.floor(F.col("_i") / F.col("_step")) < max_days))
    return df.withColumn("_d", F.date_trunc("day", F.col(ts))).join(days.select(*keys, "_d"), [*keys, "_d"], "left_semi").drop("_d")


def forecast_sanity(forecast: DataFrame, history: DataFrame, expected_rows: int, factor: float = 10.0) -> DataFrame:
    """Null, negative and implausibly large values per meter against the 95th percentile of history."""
    p95 = history.groupBy("meter_id").agg(F.percentile("demand_kwh", F.lit(0.95)).alias("hist_p95"))
    p = F.col("predicted_kwh")
    out = forecast.join(p95, "meter_id", "left").groupBy("meter_id").agg(
        F.count("*").alias("n_rows"), F.count_if(p.isNull()).alias("n_null"), F.count_if(p < 0).alias("n_negative"), F.count_if(p > factor * F.col("hist_p95")).alias("n_extreme"), F.sum(p).alias("total_kwh"))
    return out.withColumn("complete", F.col("n_rows") == expected_rows)
