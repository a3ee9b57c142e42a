"""Window frames, fills and rolling moments keyed by meter.

Inputs hold one row per key and slot (see ``grids.one_per_slot``), so a window partition is bounded by the number of
slots on the calendar, whatever the volume of raw packets behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def ordered(keys: list[str], ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def previous_rows(keys: list[str], n: int, ts: str = "ts") -> WindowSpec:
    """The n rows before the current one."""
    return ordered(keys, ts).rowsBetween(-n, -1)


def last_rows(keys: list[str], n: int, ts: str = "ts") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return ordered(keys, ts).rowsBetween(-(n - 1), 0)


def trailing_time(keys: list[str], width_us: int, ts: str = "ts") -> WindowSpec:
    """Rows in (t - width, t]."""
    return Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-width_us + 1, 0)


def centred_time(keys: list[str], width_us: int, ts: str = "ts") -> WindowSpec:
    """Rows in (t - width/2, t + width/2]."""
    half = width_us // 2
    return Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-half + 1, half)


def at_least(k: int, value: str | Column, window: WindowSpec, expr: Column) -> Column:
    """``expr`` over the window where it holds at least k values."""
    return F.when(F.count(value).over(window) >= k, expr.over(window))


def median(value: str | Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def ffill(value: str | Column, keys: list[str], ts: str = "ts") -> Column:
    w = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def newest_first(keys: list[str], ts: str = "ts") -> WindowSpec:
    """From the last row of a key back to the current one.

    Frames that end at the last row of a key are recomputed for every row; the same rows in descending order are a
    running frame, at the price of one more sort.
    """
    return Window.partitionBy(*keys).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)


def bfill(value: str | Column, keys: list[str], ts: str = "ts") -> Column:
    return F.last(value, ignorenulls=True).over(newest_first(keys, ts))


def fill_both(value: str | Column, keys: list[str], ts: str = "ts") -> Column:
    """Forward fill, then the first present value of the key for the rows before it."""
    whole = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(ffill(value, keys, ts), F.first(value, ignorenulls=True).over(whole))


def in_chunks(df: DataFrame, keys: list[str], chunk_us: int, before_us: int, after_us: int, apply, ts: str = "ts") -> DataFrame:
    """Run ``apply(df, keys)`` on time chunks of each key with the neighbouring rows its frames reach.

    Exact for frames that reach at most ``before_us`` back and ``after_us`` ahead.  A hot or very long key becomes many
    tasks; only the rows near chunk borders are repeated.
    """
    if max(before_us, after_us) > chunk_us:
        raise ValueError("frames must not reach beyond the neighbouring chunk")
    t = F.unix_micros(ts)
    own = F.floor(t / F.lit(chunk_us))
    into = t - own * chunk_us
    homes = F.array(own, F.when(into >= chunk_us - before_us, own + 1), F.when(into < after_us, own - 1))
    rows = df.withColumn("_chunk", F.explode(F.array_compact(homes)))
    return apply(rows, [*keys, "_chunk"]).filter(F.col("_chunk") == own).drop("_chunk")


def with_rolling_moments(
    df: DataFrame,
    keys: list[str],
    value: str,
    windows: list[int],
    names: dict[int, tuple[str | None, str | None]],
    include_current: bool = False,
    min_periods: dict[int, int] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Rolling mean and sample deviation, each from the rows of its own window.

    Nothing is carried from window to window, so a level shift elsewhere leaves no trace.  All windows share one sort and one
    pass; a row costs as many updates as its windows hold rows, which is less than one more window operator on wide rows.
    """
    out, number = {}, F.col(value).cast("double")
    for n in windows:
        mean_name, std_name = names[n]
        need = (min_periods or {}).get(n, 1)
        w = last_rows(keys, n, ts) if include_current else previous_rows(keys, n, ts)
        if mean_name:
            out[mean_name] = at_least(max(need, 1), value, w, F.avg(number))
        if std_name:
            out[std_name] = at_least(max(need, 2), value, w, F.stddev_samp(number))
    return df.withColumns(out)
