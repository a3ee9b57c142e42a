"""Time joins: interval masks, as-of lookup, fixed offsets, profiles, year-ago extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.operators.frames import MICROS, fill_both


def flag_inside(df: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str, out: str = "in_interval") -> DataFrame:
    """Flag rows whose time lies in any closed interval of their key.

    A sweep over interval bounds replaces the range join: bounds are summed per key and time, so repeated or long
    intervals cost one row per distinct bound and no pair of row and interval is built.
    """
    def bounds(c: str, step: int, order: int) -> DataFrame:
        return intervals.groupBy(*keys, F.col(c).alias("_t")).agg((F.count("*") * step).alias("_d")).withColumn("_o", F.lit(order))

    rows = df.withColumns({"_t": F.col(ts), "_d": F.lit(0).cast("bigint"), "_o": F.lit(1), "_row": F.struct(*[c for c in df.columns if c not in keys])})
    rows = rows.select(*keys, "_t", "_d", "_o", "_row")
    swept = rows.unionByName(bounds(start, 1, 0), allowMissingColumns=True).unionByName(bounds(end, -1, 2), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn(out, F.sum("_d").over(w) > 0).filter("_o = 1")
    return swept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys], out)


def asof_last(grid: DataFrame, series: DataFrame, ts: str, value: str, keys: list[str] | None = None, head: bool = True) -> DataFrame:
    """Last known value at every grid time; before the first value the first one is used when ``head``.

    The ordered window holds one day of a key.  What earlier days leave behind comes from a window over one row per day.
    """
    keys = keys or []
    day = F.to_date(ts)
    both = grid.select(*keys, ts).withColumn("_g", F.lit(1)).unionByName(series.select(*keys, ts, value).withColumn("_g", F.lit(0)), allowMissingColumns=True).withColumn("_day", day)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    days = both.groupBy(*keys, "_day").agg(F.max(at).alias("_late"), F.min(at).alias("_early"))
    w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy("_day")
    days = days.select(
        *[F.col(k).alias(f"_i{k}") for k in keys],
        F.col("_day").alias("_iday"),
        F.last("_late.v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
        F.min("_early").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["v"].alias("_first"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_i{k}")) for k in keys] + [F.col("_day").eqNullSafe(F.col("_iday"))]
    back = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_day").orderBy(ts, "_g").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_back", back).filter("_g = 1").join(days, on, "left")
    known = F.coalesce("_back", "_carried", "_first") if head else F.coalesce("_back", "_carried")
    return out.select(*keys, ts, known.alias(value))


def at_offset(value: str | Column, keys: list[str], offset_us: int, ts: str = "ts") -> Column:
    """Value of the row exactly ``offset_us`` earlier; several offsets share one shuffle and one sort."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-offset_us, -offset_us)
    return F.max(value).over(w)


def weekly_lookback(history: DataFrame, horizon: DataFrame, keys: list[str], value: str, weeks: int = 4, ts: str = "ts", out: str = "primed") -> DataFrame:
    """Value of the same slot one to four weeks before, the latest known value otherwise."""
    both = history.select(*keys, ts, value).withColumn("_h", F.lit(0)).unionByName(horizon.select(*keys, ts).withColumn("_h", F.lit(1)), allowMissingColumns=True)
    steps = [at_offset(F.when(F.col("_h") == 0, F.col(value)), keys, 7 * k * MICROS["day"], ts) for k in range(1, weeks + 1)]
    w = Window.partitionBy(*keys).orderBy(ts, "_h").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(value, ignorenulls=True).over(w)
    return both.withColumn(out, F.coalesce(*steps, latest)).filter("_h = 1").drop("_h", value)


def extend_from_past(df: DataFrame, keys: list[str], values: list[str], days_ahead: int, step: str, back_days: int = 365, ts: str = "ts") -> DataFrame:
    """Continue a series beyond its end with values ``back_days`` earlier, then fill gaps."""
    end = df.groupBy(*keys).agg(F.max(ts).alias("_end"))
    pad = end.select(*keys, F.explode(F.expr(f"sequence(_end + interval {step}, _end + interval {days_ahead} days, interval {step})")).alias(ts))
    both = df.select(*keys, ts, *values).withColumn("_p", F.lit(0)).unionByName(pad.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    past = {v: F.when(F.col("_p") == 1, at_offset(v, keys, back_days * MICROS["day"], ts)).otherwise(F.col(v)) for v in values}
    out = both.withColumns(past)
    return out.withColumns({v: fill_both(v, keys, ts) for v in values}).withColumn("is_extended", F.col("_p") == 1).drop("_p")


def join_profile(horizon: DataFrame, profile: DataFrame, fallback: DataFrame, keys: list[str], on: list[str], values: dict[str, float], level: str) -> DataFrame:
    """Join a per-slot profile; absent slots take ``level`` of the key times a factor."""
    out = horizon.join(profile, [*keys, *on], "left").join(fallback.select(*keys, level), keys, "left")
    return out.withColumns({v: F.coalesce(v, F.col(level) * factor) for v, factor in values.items()}).drop(level)
