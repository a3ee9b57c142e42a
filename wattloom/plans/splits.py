"""Train and test labels per meter as columns or folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattloom.operators.frames import ordered


def by_span(df: DataFrame, keys: list[str], share: float = 0.75, ts: str = "ts") -> DataFrame:
    """Train is the first share of the time span."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(F.unix_micros(ts)).over(w), F.max(F.unix_micros(ts)).over(w)
    return df.withColumn("split", F.when(F.unix_micros(ts) < lo + (hi - lo) * share, "train").otherwise("test"))


def by_rows(df: DataFrame, keys: list[str], share: float = 0.75, ts: str = "ts") -> DataFrame:
    """Train is the first share of the rows."""
    cut = F.floor(F.count("*").over(Window.partitionBy(*keys)) * share)
    return df.withColumn("split", F.when(F.row_number().over(ordered(keys, ts)) <= cut, "train").otherwise("test"))


def _day_index(df: DataFrame, keys: list[str], ts: str, min_slots: int = 0) -> DataFrame:
    """Whether the day of a row is complete, its index among complete days and their number; one shuffle by key."""
    day = F.date_trunc("day", F.col(ts))
    in_day, w = Window.partitionBy(*keys, day), Window.partitionBy(*keys)
    df = df.withColumns({"_full": F.count("*").over(in_day) >= min_slots, "_new": F.row_number().over(in_day.orderBy(ts)) == 1})
    step = (F.col("_full") & F.col("_new")).cast("int")
    return df.withColumns({"_i": F.sum(step).over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)) - 1, "_of": F.sum(step).over(w)})


def every_nth_day(df: DataFrame, keys: list[str], every: int = 4, offset: int = 0, min_slots: int = 44, cap_share: float | None = None, keep_incomplete: bool = True, ts: str = "ts") -> DataFrame:
    """Every n-th complete day is held out; incomplete days train or, without ``keep_incomplete``, are dropped."""
    out = _day_index(df, keys, ts, min_slots)
    place = F.col("_i") - offset
    hold = F.col("_full") & (place >= 0) & (place % every == 0)
    if cap_share is not None:
        hold = hold & (F.floor(place / F.lit(every)) < F.greatest(F.lit(1), F.floor(F.col("_of") * cap_share)))
    if not keep_incomplete:
        out = out.filter("_full")
    return out.withColumn("split", F.when(hold, "test").otherwise("train")).select(*df.columns, "split")


def rolling_origin(df: DataFrame, keys: list[str], initial: int = 90, step: int = 30, horizon: int = 14, ts: str = "ts") -> DataFrame:
    """Expanding train days and the following test days; a row appears once per fold that uses it."""
    out = _day_index(df, keys, ts)
    last = F.floor((F.col("_of") - horizon - initial) / F.lit(step))
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - horizon - initial + 1) / F.lit(step))).cast("int")
    out = out.filter(last >= 0).withColumns({"_last": last.cast("int"), "_first": first}).filter("_first <= _last")
    out = out.withColumn("fold", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("split", F.when(F.col("_i") < initial + F.col("fold") * step, "train").otherwise("test")).select(*df.columns, "fold", "split")


def last_days(df: DataFrame, keys: list[str], days: int, ts: str = "ts") -> DataFrame:
    end = F.max(F.unix_micros(ts)).over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(F.unix_micros(ts) > end - days * 86_400_000_000, "test").otherwise("train"))


def expanding_folds(df: DataFrame, keys: list[str], folds: int = 5, min_train: int = 4000, ts: str = "ts") -> DataFrame:
    """Folds over row ranks: each validates the next block of rows after everything before it."""
    df = df.withColumns({"_i": F.row_number().over(ordered(keys, ts)) - 1, "_of": F.count("*").over(Window.partitionBy(*keys))})
    size = F.floor((F.col("_of") - min_train) / F.lit(folds))
    df = df.withColumn("_size", size).filter("_size > 0")
    first = F.greatest(F.lit(0), F.floor((F.col("_i") - min_train) / F.col("_size"))).cast("int")
    df = df.withColumn("_first", first).filter(F.col("_first") < folds).withColumn("fold", F.explode(F.sequence("_first", F.lit(folds - 1))))
    return df.withColumn("split", F.when(F.col("_i") < min_train + F.col("fold") * F.col("_size"), "train").otherwise("test")).drop("_i", "_of", "_size", "_first")
