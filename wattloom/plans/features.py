"""Feature families and feature tables for all meters in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.functions import calendar as cal, weather as wf
from wattloom.operators.history import add_history
from wattloom.operators.frames import at_least, fill_both, last_rows, ordered, previous_rows, with_rolling_moments


def add_lags(df: DataFrame, keys: list[str], value: str, names: dict[int, str], ts: str = "ts") -> DataFrame:
    w = ordered(keys, ts)
    return df.withColumns({name: F.lag(value, n).over(w) for n, name in names.items()})


def add_rolling_inclusive(df: DataFrame, keys: list[str], value: str, windows: list[int], ts: str = "ts", prefix: str = "") -> DataFrame:
    df = with_rolling_moments(df, keys, value, windows, {n: (f"{prefix}rmean_{n}", f"{prefix}rstd_{n}") for n in windows}, include_current=True, ts=ts)
    out = {}
    for n in windows:
        w = last_rows(keys, n, ts)
        out[f"{prefix}rmin_{n}"], out[f"{prefix}rmax_{n}"] = F.min(value).over(w), F.max(value).over(w)
    return df.withColumns(out)


LONG_MEANS = {672: ("rmean_14d", None), 1440: ("rmean_30d", None)}
LONG_NEED = {672: 48, 1440: 48}


def add_differences(df: DataFrame, keys: list[str], value: str, leaky: bool = False, names=("demand_diff_1", "demand_diff_4"), ts: str = "ts") -> DataFrame:
    """Differences of past values over one and four rows; of the current value with ``leaky``."""
    w = ordered(keys, ts)
    now, back = (F.col(value), 0) if leaky else (F.lag(value, 1).over(w), 1)
    return df.withColumns({names[0]: now - F.lag(value, back + 1).over(w), names[1]: now - F.lag(value, back + 4).over(w)})


def add_trend(df: DataFrame) -> DataFrame:
    ratio = F.col("rmean_14d") / F.greatest(F.col("rmean_30d"), F.lit(1.0))
    return df.withColumn("trend_ratio", F.when(F.col("rmean_30d").isNotNull(), ratio))


def add_momentum(df: DataFrame, keys: list[str], value: str, leaky: bool = False, diff_names=("demand_diff_1", "demand_diff_4"), ts: str = "ts") -> DataFrame:
    """Differences, 14 and 30 day means and their ratio."""
    df = add_differences(df, keys, value, leaky, diff_names, ts)
    return add_trend(with_rolling_moments(df, keys, value, list(LONG_MEANS), LONG_MEANS, min_periods=LONG_NEED, ts=ts))


def add_persistence(df: DataFrame, keys: list[str], value: str, day: int, week: int, ts: str = "ts") -> DataFrame:
    df = add_lags(df, keys, value, {day: "persistence_24h", week: "persistence_168h"}, ts)
    ratio = F.col("persistence_24h") / F.greatest(F.col("persistence_168h"), F.lit(1.0))
    return df.withColumn("persist_ratio_24_168", F.when(F.col("persistence_168h").isNotNull(), ratio))


def add_similar_day(df: DataFrame, keys: list[str], value: str, extended: bool = False, ts: str = "ts") -> DataFrame:
    """Statistics of earlier rows with the same hour and weekday.  Hash partitioning by key already serves these windows."""
    slot = [*keys, F.hour(ts), F.weekday(ts)]

    def back(n: int, k: int, expr: Column) -> Column:
        w = Window.partitionBy(*slot).orderBy(ts).rowsBetween(-n, -1)
        return at_least(k, value, w, expr)

    out = {"similar_day_k5": back(5, 2, F.avg(value)), "sdh_mean_60d": back(9, 2, F.avg(value)), "sdh_std_60d": back(9, 2, F.stddev_samp(value))}
    if extended:
        out |= {"similar_day_k10": back(10, 3, F.avg(value)), "sdh_mean_90d": back(13, 3, F.avg(value))}
    return df.withColumns(out).withColumn("sdh_deviation", F.lag(value).over(ordered(keys, ts)) - F.col("sdh_mean_60d"))


def add_slot_deviation(df: DataFrame, keys: list[str], value: str, min_periods: int = 48, ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(*keys, cal.hour_fraction(ts)).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("deviation_from_hourly", F.lag(value).over(ordered(keys, ts)) - at_least(min_periods, value, w, F.avg(value)))


def add_variability(df: DataFrame) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b).isNotNull(), F.col(a) / F.greatest(F.col(b), F.lit(1.0))).otherwise(F.col(a))

    return df.withColumns({
        "rstd_ratio_48_336": ratio("rstd_48", "rstd_336"), "rmean_ratio_12_336": ratio("rmean_12", "rmean_336"), "cv_48": ratio("rstd_48", "rmean_48"),
    })


def add_weather_derivatives(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    w, six = ordered(keys, ts), last_rows(keys, 12, ts)
    return df.withColumns({
        "pressure_delta_3h": F.col("pressure") - F.lag("pressure", 6).over(w),
        "temp_delta_3h": F.col("temperature") - F.lag("temperature", 6).over(w),
        "cloud_delta_3h": F.col("cloud_cover") - F.lag("cloud_cover", 6).over(w),
        "temp_rmean_6h": F.avg("temperature").over(six), "ghi_rmean_6h": F.avg("ghi").over(six),
        "is_raining": (F.col("precipitation") > 0).cast("int"),
        "diffuse_fraction": wf.clip(F.col("dhi") / F.greatest(F.col("ghi"), F.lit(1.0)), 0.0, 1.0),
        "heat_index": wf.apparent_temperature(F.col("temperature"), F.col("humidity")),
    })


def add_weather_anomalies(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    w = previous_rows(keys, 48, ts)
    names = {"temp": "temperature", "hum": "humidity", "ghi": "ghi", "cloud": "cloud_cover"}
    return df.withColumns({f"{n}_anom_24h": F.col(c) - at_least(12, c, w, F.avg(c)) for n, c in names.items()})


def add_cooling_history(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    df = df.withColumn("cdd_21", wf.above(F.col("temperature"), 21.0))
    return with_rolling_moments(df, keys, "cdd_21", [48, 336], {48: ("cdd_21_rmean_48", None), 336: ("cdd_21_rmean_336", None)}, min_periods={48: 6, 336: 48}, ts=ts)


def add_voltage_history(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return df.withColumns({
        "voltage_lag1": F.lag("voltage").over(ordered(keys, ts)), "voltage_rstd_6": F.stddev_samp("voltage").over(previous_rows(keys, 6, ts)),
        "voltage_rmean_48": F.avg("voltage").over(previous_rows(keys, 48, ts)),
    })


def add_hourly_weather_windows(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    w = ordered(keys, ts)

    def mean(c: str, n: int) -> Column:
        return F.avg(c).over(last_rows(keys, n, ts))

    return df.withColumns({
        "temp_delta_1h": F.col("temperature") - F.lag("temperature", 1).over(w), "temp_delta_3h": F.col("temperature") - F.lag("temperature", 3).over(w),
        "temp_rmean_6h": mean("temperature", 6), "temp_rmean_24h": mean("temperature", 24),
        "temp_rmax_24h": F.max("temperature").over(last_rows(keys, 24, ts)),
        "pressure_delta_3h": F.col("pressure") - F.lag("pressure", 3).over(w),
        "ghi_rmean_3h": mean("ghi", 3), "ghi_rstd_3h": F.coalesce(F.stddev_samp("ghi").over(last_rows(keys, 3, ts)), F.lit(0.0)), "ghi_rmean_6h": mean("ghi", 6),
        "ghi_lag_1h": F.lag("ghi", 1).over(w), "ghi_lag_24h": F.lag("ghi", 24).over(w),
        "pm25_rmean_24h": mean("pm2_5", 24), "pm25_rmean_72h": mean("pm2_5", 72), "aod_rmean_24h": mean("aod", 24),
    })


def add_soiling(df: DataFrame) -> DataFrame:
    """Radiation variability, air-quality flags and the combined soiling index."""
    return df.withColumns({
        "ghi_variability": wf.safe_ratio(F.col("ghi_rstd_3h"), F.col("ghi_rmean_3h")),
        "aqi_poor": (F.col("pm2_5") > 35).cast("int"), "aqi_very_poor": (F.col("pm2_5") > 75).cast("int"),
        "aod_high": (F.col("aod") > 0.4).cast("int"), "dust_event": (F.col("dust") > 50).cast("int"),
        "soiling_index": (F.col("pm25_rmean_72h") / 100.0 + F.col("aod_rmean_24h") + F.col("dust") / 200.0) / 3.0,
    })


def add_consumption_shape(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    day = Window.partitionBy(*keys, F.date_trunc("day", F.col(ts)))
    hour = Window.partitionBy(*keys, F.hour(ts))
    hi, lo, total = F.max(value).over(day), F.min(value).over(day), F.sum(value).over(day)
    sd = F.stddev_samp(value).over(hour)
    return df.withColumns({
        "daily_range_ratio": F.when(hi > 0, (hi - lo) / F.nullif(hi, F.lit(0.0))).otherwise(0.0),
        "hourly_share": F.when(total > 0, F.col(value) / F.nullif(total, F.lit(0.0))).otherwise(0.0),
        "deviation_from_typical": F.when(sd > 0, (F.col(value) - F.avg(value).over(hour)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0),
    })


def detect_cadence(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    step = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(ordered(keys, ts)))) / 60_000_000.0
    out = df.select(*keys, step.alias("_d")).filter("_d is not null").groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("median_min"))
    near = {m: F.abs(F.col("median_min") - m) < 1 for m in (30, 15)}
    return out.withColumn("cadence_min", F.when(near[30], 30).when(near[15], 15))


def fleet_aggregate(df: DataFrame, value: str = "demand_kwh", ts: str = "ts", min_meters: int = 5) -> DataFrame:
    return (
        df.groupBy(ts).agg(F.avg(value).alias("fleet_mean"), F.stddev_samp(value).alias("fleet_std"), F.count(value).alias("fleet_count"))
        .filter(F.col("fleet_count") >= min_meters)
    )


def join_filled(df: DataFrame, dim: DataFrame, keys: list[str], columns: list[str], default: float | None = None, ts: str = "ts", place: list[str] = []) -> DataFrame:  # noqa: B006
    """Left join by time, and by place where both sides have one, then fill forward and backward per key."""
    out = df.join(dim.select(*place, ts, *columns), [*place, ts], "left")
    filled = {c: fill_both(c, keys, ts) for c in columns}
    if default is not None:
        filled = {c: F.coalesce(e, F.lit(default)) for c, e in filled.items()}
    return out.withColumns(filled)


def drop_warmup(df: DataFrame, keys: list[str], rows: int, third: bool = False, ts: str = "ts") -> DataFrame:
    """Drop the first rows of each key; with ``third`` at most a third of them."""
    df = df.withColumns({"_rn": F.row_number().over(ordered(keys, ts)), "_len": F.count("*").over(Window.partitionBy(*keys))})
    limit = F.least(F.lit(rows), F.floor(F.col("_len") / F.lit(3))) if third else F.lit(rows)
    return df.filter(F.col("_rn") > limit).drop("_rn", "_len")


WEATHER_COLUMNS = [
    "temperature", "humidity", "pressure", "cloud_cover", "precipitation", "wind_speed", "ghi", "dni", "dhi",
    "pressure_delta_3h", "temp_delta_3h", "ghi_rmean_6h", "cloud_delta_3h", "is_raining", "diffuse_fraction", "heat_index", "temp_rmean_6h",
]


def slot_features(df: DataFrame, weather: DataFrame, fleet: DataFrame, keys: list[str], value: str = "demand_kwh", warmup: int = 336, min_hourly: int = 48, leaky: bool = False, ts: str = "ts", place: list[str] = []) -> DataFrame:  # noqa: B006
    """Slot feature table: calendar, lags, rolling, momentum, weather, holidays, tariff, voltage, fleet, similar days.

    ``weather`` holds one row per time and place, ``fleet`` one per time; Spark broadcasts them only below its size threshold.
    """
    w = ordered(keys, ts)
    names = {n: (f"rmean_{n}", f"rstd_{n}") for n in (6, 12, 48, 336)} | LONG_MEANS
    df = with_rolling_moments(df, keys, value, list(names), names, min_periods=LONG_NEED, ts=ts)  # first, while rows are narrow
    df = cal.add_cycles(df, ts).withColumns({
        "hour": cal.hour_fraction(ts), "dow": F.weekday(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_holiday": cal.is_recurring_holiday(ts).cast("int"),
        "tod_multiplier": cal.tod_multiplier(F.hour(ts), midday_peak=False), "is_peak": F.hour(ts).between(18, 21).cast("int"),
    })
    near = cal.is_recurring_holiday(F.date_add(ts, 1)) | cal.is_recurring_holiday(F.date_sub(ts, 1)) | (F.col("is_holiday") == 1)
    df = df.withColumn("near_holiday", near.cast("int"))
    df = add_lags(df, keys, value, {n: f"lag_{n}" for n in (1, 2, 4, 6, 12, 24, 48, 96, 336)}, ts)
    df = add_trend(add_differences(df, keys, value, leaky, ts=ts))
    df = join_filled(df, weather, keys, WEATHER_COLUMNS, ts=ts, place=place)
    t = F.col("temperature")
    df = df.withColumns({
        "cooling_deg": wf.above(t, 25.0), "heating_deg": wf.below(t, 18.0), "hdd_21": wf.below(t, 21.0),
        "hour_x_temp": F.col("hour") * t / 100.0, "peak_x_temp": F.hour(ts).between(12, 17).cast("int") * t,
    })
    df = add_cooling_history(df, keys, ts).withColumns({"cdd_21_x_hour": F.col("cdd_21") * F.col("hour") / 24.0, "cdd_21_x_peak": F.col("is_peak") * F.col("cdd_21")})
    df = add_weather_anomalies(df, keys, ts)
    if "voltage" in df.columns:
        df = add_voltage_history(df, keys, ts)
    df = add_slot_deviation(df, keys, value, min_hourly, ts)
    df = join_filled(df, fleet, keys, ["fleet_mean", "fleet_std"], 0.0, ts)
    df = df.withColumns({"fleet_mean_lag1": F.lag("fleet_mean").over(w), "fleet_std_lag1": F.lag("fleet_std").over(w)})
    df = df.withColumn("vs_fleet_ratio", F.when(F.col("fleet_mean_lag1").isNotNull(), F.col("lag_1") / F.greatest(F.col("fleet_mean_lag1"), F.lit(1.0))))
    df = add_similar_day(df, keys, value, ts=ts).drop("sdh_mean_60d", "sdh_std_60d", "sdh_deviation")
    df = df.withColumn("target", F.col(value))
    return drop_warmup(df, keys, warmup, ts=ts) if warmup else df


def extended_features(df: DataFrame, weather: DataFrame, fleet: DataFrame, keys: list[str], value: str = "demand_kwh", warmup: int = 672, min_hourly: int = 48, ts: str = "ts", place: list[str] = []) -> DataFrame:  # noqa: B006
    """Slot features plus robust history, persistence, longer similar-day windows, weather lags and variability."""
    df = add_history(df, keys, value, [6, 12, 48, 336], [6, 24, 48], ts)  # first, while rows are narrow
    df = slot_features(df, weather, fleet, keys, value, warmup=0, min_hourly=min_hourly, ts=ts, place=place)
    df = add_persistence(df, keys, value, 48, 336, ts)
    df = add_similar_day(df.drop("similar_day_k5"), keys, value, extended=True, ts=ts)
    w = ordered(keys, ts)
    df = df.withColumns({f"{c}_lag24": F.lag(c, 48).over(w) for c in ("temperature", "humidity", "cloud_cover")})
    return drop_warmup(add_variability(df), keys, warmup, third=True, ts=ts)


def above_mean(value: str, keys: list[str], digits: int = 6) -> Column:
    """1 where a value of so many decimals is above the mean of its keys, in decimals: one that equals the mean is not."""
    w, exact = Window.partitionBy(*keys), F.col(value).cast(f"decimal(18,{digits})")
    return (exact * F.count(value).over(w) > F.sum(exact).over(w)).cast("int")


def hourly_features(df: DataFrame, weather: DataFrame, prices: DataFrame, keys: list[str], value: str = "demand_kwh", ts: str = "ts", longest_lag: int = 168, solar: bool = True, air_quality: bool = True, place: list[str] = []) -> DataFrame:  # noqa: B006
    """Eight hourly families in order; rows without the longest lag are dropped.  Weather is windowed and joined by place."""
    df = cal.add_cycles(cal.add_temporal(df, ts), ts)
    df = add_lags(df, keys, value, {n: f"{value}_lag_{n}h" for n in (1, 2, 3, 6, 12, 24, 48, 168)}, ts)
    df = add_rolling_inclusive(df, keys, value, [3, 6, 12, 24, 48, 168], ts, prefix=f"{value}_")
    p = prices.withColumn("price_above_mean", above_mean("price", ["month"]))
    df = df.join(p, ["month", "hour"], "left")
    df = add_consumption_shape(df, keys, value, ts)
    wx = add_hourly_weather_windows(wf.add_degree_hours(wf.add_conditions(weather)), place or [F.lit(0)], ts)
    if solar:
        wx = wf.add_radiation_ratios(wx)
    if air_quality:
        wx = add_soiling(wx)
    df = wf.add_interactions(df.join(wx, [*place, ts], "left"))
    return df.filter(F.col(f"{value}_lag_{longest_lag}h").isNotNull())


def load_features(df: DataFrame, keys: list[str], value: str = "demand_kw", slots_per_hour: int = 2, lags: bool = True, ts: str = "ts") -> DataFrame:
    """Load feature table: calendar flags, lags and inclusive windows by hours, consumption ratio."""
    h = F.hour(ts)
    df = cal.add_cycles(df, ts).withColumns({
        "hour": h, "minute": F.minute(ts), "dow": F.weekday(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_business_hour": (h.between(9, 17) & (F.weekday(ts) < 5)).cast("int"), "is_peak": h.between(18, 21).cast("int"),
        "tod": F.when(h.between(6, 8), 1).when(h.between(9, 17), 2).when(h.between(18, 21), 3).otherwise(0),
    })
    if not lags:
        return df
    k = slots_per_hour
    df = add_lags(df, keys, value, {n * k: f"lag_{n}h" for n in (1, 2, 3, 6, 12, 24, 48, 168)}, ts)
    windows = [n * k for n in (3, 6, 12, 24, 48, 168)]
    df = add_rolling_inclusive(df, keys, value, windows, ts)
    day = F.col(f"rmean_{24 * k}")
    return df.withColumns({"daily_mean": day, "demand_ratio": F.col(value) / F.greatest(day, F.lit(0.001)), "demand_same_time_yesterday": F.col("lag_24h"), "demand_same_time_lastweek": F.col("lag_168h")})
