"""Calendar, tariff and block columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattloom import constants as K

TWO_PI = 2.0 * math.pi


def hour_fraction(ts: str | Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * TWO_PI / period
    return F.sin(angle), F.cos(angle)


def is_recurring_holiday(ts: str | Column) -> Column:
    keys = [m * 100 + d for m, d in K.HOLIDAYS_MONTH_DAY]
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(keys)


def season(ts: str | Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "summer").when(m <= 9, "monsoon").otherwise("post_monsoon")


def tod_multiplier(hour: Column, midday_peak: bool = True) -> Column:
    """Tariff multiplier by hour; the second definition has an evening peak only."""
    evening = hour.between(18, 21)
    peak = (hour.between(10, 13) | evening) if midday_peak else evening
    return F.when(peak, 1.2).when((hour < 6) | (hour >= 22), 0.9).otherwise(1.0)


def day_block(hour: Column) -> Column:
    out = None
    for name, (lo, hi) in K.DAY_BLOCKS.items():
        hit = (hour >= lo) & (hour < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(K.NIGHT_BLOCK)


def tariff_band(hour: Column) -> Column:
    """0 late night, 1 morning, 2 forenoon, 3 afternoon, 4 evening, 5 after 22 h."""
    return F.when(hour < 6, 0).when(hour >= 22, 5).otherwise(F.floor((hour - 6) / F.lit(4)) + 1).cast("int")


def slot_ids(ts: str | Column) -> dict[str, Column]:
    h, m = F.hour(ts), F.minute(ts)
    return {
        "block_id_15min": (h * 4 + F.floor(m / F.lit(15))).cast("int"),
        "block_id_30min": (h * 2 + F.floor(m / F.lit(30))).cast("int"),
        "block_id_hour": h,
        "block_id_tod": tariff_band(h),
    }


def block_start(ts: str, cadence: str) -> Column:
    if cadence == "tod_4h":
        band = tariff_band(F.hour(ts))
        hours = F.when(band == 0, 0).otherwise(band * 4 + 2)
        return F.timestamp_micros(F.unix_micros(F.date_trunc("day", F.col(ts))) + hours.cast("bigint") * K.MICROS_PER_HOUR)
    minutes = {"dam_15min": 15, "native_30min": 30, "hourly": 60}[cadence]
    step = minutes * 60_000_000
    t = F.unix_micros(ts)
    return F.timestamp_micros(t - F.pmod(t, F.lit(step)))


def fy_month(month: Column) -> Column:
    """April is 0 and March is 11."""
    return F.pmod(month - 4, F.lit(12))


def add_temporal(df: DataFrame, ts: str = "ts") -> DataFrame:
    h, dow = F.hour(ts), F.weekday(ts)
    df = df.withColumns({
        "hour": h, "day_of_week": dow, "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "week_of_year": F.weekofyear(ts),
        "day_of_year": F.dayofyear(ts), "hour_frac": hour_fraction(ts),
        "is_weekend": (dow >= 5).cast("int"), "is_holiday": is_recurring_holiday(ts).cast("int"), "season": season(ts),
        "tod_multiplier": tod_multiplier(h),
    })
    df = df.withColumns({
        "is_working_day": ((F.col("is_weekend") == 0) & (F.col("is_holiday") == 0)).cast("int"),
        "is_peak_hour": (F.col("tod_multiplier") > 1).cast("int"),
    })
    return df.withColumn("is_business_hour", (h.between(9, 17) & (F.col("is_working_day") == 1)).cast("int"))


def add_cycles(df: DataFrame, ts: str = "ts") -> DataFrame:
    out = {}
    for name, value, period in (
        ("hour", hour_fraction(ts), 24.0), ("dow", F.weekday(ts), 7.0), ("month", F.month(ts), 12.0),
        ("doy", F.dayofyear(ts) + F.hour(ts) / 24.0, 365.25),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, period)
    return df.withColumns(out)
