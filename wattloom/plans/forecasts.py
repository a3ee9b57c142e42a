"""Forecasts of all meters: seasonal, weather-adjusted, primed, blended, banded, priced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.functions import money
from wattloom.functions.labels import clean_forecast
from wattloom.operators import grids, joins, load
from wattloom.session import cut_lineage

BANDS = {"mean_kwh": 1.0, "q10_kwh": 0.7, "q90_kwh": 1.3}
SLOT = ["dow", "hour", "minute"]


def horizon_after(df: DataFrame, keys: list[str], step: str, length: str, ts: str = "ts") -> DataFrame:
    """The slots that follow the last row of each key."""
    end = df.groupBy(*keys).agg(F.max(ts).alias("_e"))
    return end.select(*keys, F.explode(F.expr(f"sequence(_e + interval {step}, _e + interval {length}, interval {step})")).alias(ts))


def with_slot(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({"dow": F.weekday(ts), "hour": F.hour(ts), "minute": F.minute(ts)})


def seasonal_anchor(df: DataFrame, horizon: DataFrame, keys: list[str], value: str = "demand_kwh", weeks: int = 4, ts: str = "ts") -> DataFrame:
    """Median and band of the same weekday slot over the trailing weeks; unseen slots take the overall level."""
    profile, level = load.slot_profile(df, keys, value, weeks, ts=ts)
    out = joins.join_profile(with_slot(horizon, ts), profile, level, keys, SLOT, BANDS, "level")
    return clean_forecast(out, "mean_kwh", "q10_kwh", "q90_kwh")


def weather_adjusted(df: DataFrame, weather: DataFrame, horizon: DataFrame, keys: list[str], value: str = "demand_kwh", weeks: int = 4, fit_days: int = 84, damp: float = 0.6, min_n: int = 20, min_rows: int = 96, ts: str = "ts", place: list[str] = []) -> DataFrame:  # noqa: B006
    """Seasonal anchor plus a damped response to the temperature difference between horizon and anchor weeks."""
    w = Window.partitionBy(*keys)
    us = F.unix_micros(ts)
    temp = weather.select(*place, ts, "temperature")
    seen = df.select(*keys, *place, ts, value).withColumns({"_end": F.max(us).over(w)}).join(temp, [*place, ts], "left").withColumn("hour", F.hour(ts))
    recent = seen.filter(us >= F.col("_end") - fit_days * 86_400_000_000).filter(F.col("temperature").isNotNull() & F.col(value).isNotNull())
    enough = recent.groupBy(*keys).agg(F.count("*").alias("_rows"))
    fit = load.temperature_fit(recent, [*keys, "hour"], value, "temperature", min_n)
    inside = us >= F.col("_end") - weeks * 7 * 86_400_000_000
    anchor = seen.withColumn("_in", inside).withColumn("_k", F.sum(F.col("_in").cast("int")).over(w)).filter(F.col("_in") | (F.col("_k") < min_rows))
    anchor = anchor.groupBy(*keys, "hour").agg(F.percentile("temperature", F.lit(0.5)).alias("_at"))
    if place:
        horizon = horizon.join(df.select(*keys, *place).distinct(), keys)
    base = seasonal_anchor(df, horizon, keys, value, weeks, ts).join(temp, [*place, ts], "left")
    base = base.join(fit.select(*keys, "hour", "slope"), [*keys, "hour"], "left").join(anchor, [*keys, "hour"], "left").join(enough, keys, "left")
    shift = F.coalesce("slope", F.lit(0.0)) * (F.coalesce("temperature", "_at") - F.col("_at")) * damp
    shift = F.when(F.coalesce("_rows", F.lit(0)) >= min_rows, F.coalesce(shift, F.lit(0.0))).otherwise(0.0)
    base = base.withColumn("adjustment", shift)
    out = {c: F.greatest(F.col(c) + F.col("adjustment"), F.lit(0.0)) for c in BANDS}
    return base.withColumns(out).drop("slope", "_at", "_rows", "temperature")


def priming_context(df: DataFrame, keys: list[str], step: str, horizon_days: int, pseudo_days: int, value: str = "demand_kwh", tail_days: int = 60, ts: str = "ts") -> DataFrame:
    """Real tail, seasonal pseudo history and horizon placeholders of each key; the earliest source wins a slot.

    The forecast starts one step after the last row plus the pseudo history.
    """
    w = Window.partitionBy(*keys)
    profile, level = load.slot_profile(df, keys, value, ts=ts)
    end = F.max(F.unix_micros(ts)).over(w)
    real = df.select(*keys, ts, value).filter(F.col(value).isNotNull()).withColumn("_end", end)
    real = real.filter(F.unix_micros(ts) >= F.col("_end") - tail_days * 86_400_000_000).drop("_end")
    total = pseudo_days + horizon_days
    later = horizon_after(df, keys, step, f"{total} days", ts)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    filled = joins.join_profile(with_slot(later, ts), profile.withColumnRenamed("mean_kwh", value), level, keys, SLOT, {value: 1.0}, "level").join(last, keys)
    is_pseudo = F.unix_micros(ts) <= F.unix_micros("_last") + pseudo_days * 86_400_000_000
    filled = filled.withColumn("source", F.when(is_pseudo, "pseudo").otherwise("horizon")).select(*keys, ts, value, "source")
    return grids.union_by_priority([real.withColumn("source", F.lit("real")), filled], [*keys, ts])


def row_median(columns: list[Column]) -> Column:
    """Median of the present values of a row."""
    present = F.array_sort(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    n = F.size(present)
    low, high = F.get(present, F.floor((n - 1) / F.lit(2)).cast("int")), F.get(present, F.floor(n / F.lit(2)).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def blend_median(df: DataFrame, strategies: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """One row per meter and slot with the median over strategies."""
    wide = df.groupBy("meter_id", ts).pivot("strategy", strategies).agg(*[F.max(v).alias(v) for v in values])
    name = (lambda s, v: s) if len(values) == 1 else (lambda s, v: f"{s}_{v}")
    return wide.select("meter_id", ts, *[row_median([F.col(name(s, v)) for s in strategies]).alias(v) for v in values])


def with_fallback(model: DataFrame, anchor: DataFrame, keys: list[str], value: str, labels: tuple[str, str] = ("model", "seasonal_anchor")) -> DataFrame:
    """Model forecast where present, the anchor elsewhere, with the method used."""
    out = anchor.withColumnRenamed(value, "_anchor").join(model.select(*keys, F.col(value).alias("_model")), keys, "left")
    return out.withColumns({value: F.coalesce("_model", "_anchor"), "method": F.when(F.col("_model").isNotNull(), labels[0]).otherwise(labels[1])}).drop("_model", "_anchor")


def deviation_band(df: DataFrame, keys: list[str], point: str, share: float = 0.15, z: float = 1.645) -> DataFrame:
    width = F.stddev_pop(point).over(Window.partitionBy(*keys)) * share * z
    return df.withColumns({"lower": F.greatest(F.col(point) - width, F.lit(0.0)), "upper": F.col(point) + width})


def search_weight(df: DataFrame, keys: list[str], y: str, a: str, b: str, steps: int = 20) -> DataFrame:
    """Weight of ``a`` against ``b`` with the least mean absolute error, from one aggregate over all weights."""
    grid = [i / steps for i in range(steps + 1)]
    errors = F.array(*[F.struct(F.avg(F.abs(F.col(y) - (F.col(a) * w + F.col(b) * (1.0 - w)))).alias("mae"), F.lit(w).alias("weight")) for w in grid])
    return df.groupBy(*keys).agg(F.array_min(errors).alias("_b")).select(*keys, F.col("_b.weight").alias("weight"), F.col("_b.mae").alias("mae"))


def inverse_error_weights(df: DataFrame, key: str, item: str, error: str) -> DataFrame:
    inv = 1.0 / F.nullif(F.col(error), F.lit(0.0))
    return df.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy(key)))


def price_forecast(df: DataFrame, matrix: DataFrame, ts: str = "ts", temperature: str | None = None) -> DataFrame:
    """Price, landed cost and within-month percentile of each time; the matrix is reduced to one row per month and hour."""
    matrix = matrix.groupBy("month", "hour").agg(F.first("price", ignorenulls=True).alias("price"))  # at most 288 rows
    out = df.withColumns({"month": F.month(ts), "hour": F.hour(ts)}).join(F.broadcast(matrix), ["month", "hour"], "left")
    if temperature:
        out = out.withColumn("price", money.hot_premium(F.col("price"), F.col(temperature)))
    return price_percentile(out.withColumn("landed_cost", money.landed_cost(F.col("price"))))


def price_percentile(df: DataFrame, month: str = "month", price: str = "price") -> DataFrame:
    """Share of the rows of a month with a strictly lower price.

    A row without a price keeps its place, has no share and counts for no other.  Rows are counted per distinct price on the map side first; prices depend on the time only, so the ordered window
    holds at most one row per slot of the month, whatever the number of meters.  Rows and counts meet on the exact price,
    so both read one written table.
    """
    df = cut_lineage(df, "priced")
    counts = df.filter(F.col(price).isNotNull()).groupBy(month, price).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(month)
    below = F.coalesce(F.sum("_c").over(w.orderBy(price).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("price_percentile", below / F.sum("_c").over(w)).drop("_c")
    return df.join(counts, [month, price], "left")


def naive_week(df: DataFrame, keys: list[str], value: str, rows: int = 168, ts: str = "ts") -> DataFrame:
    """The last ``rows`` rows of each key with the value of the same place one week of rows before."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"naive": F.lag(value, rows).over(w.orderBy(ts)), "_r": F.row_number().over(w.orderBy(F.desc(ts)))})
    return df.filter(F.col("_r") <= rows).drop("_r")
