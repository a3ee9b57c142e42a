"""Anomaly masks per meter.  A missing value is never anomalous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.operators.frames import MICROS, at_least, centred_time, median, ordered

STD_FLOOR = 1e-9


def _mask(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _positive(threshold: float) -> None:
    if threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold}")


def frozen(df: DataFrame, keys: list[str], value: str, min_run: int = 3, ts: str = "ts", out: str = "is_frozen") -> DataFrame:
    """Runs of unchanged values; the length counts repeats, so ``min_run`` repeats need one more equal value."""
    w = ordered(keys, ts)
    same = _mask(F.col(value) == F.lag(value).over(w))
    df = df.withColumn("_same", same)
    df = df.withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.col("_same").cast("int")).over(Window.partitionBy(*keys, "_run"))
    return df.withColumn(out, F.col("_same") & (length >= min_run)).drop("_same", "_run")


def global_z(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0, out: str = "is_zscore_outlier") -> DataFrame:
    _positive(threshold)
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    z = F.abs(F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))
    return df.withColumn(out, _mask((F.count(value).over(w) >= 3) & (z > threshold)))


def iqr(df: DataFrame, keys: list[str], value: str, factor: float = 1.5, out: str = "is_iqr_outlier") -> DataFrame:
    if factor <= 0:
        raise ValueError(f"factor must be positive, got {factor}")
    w = Window.partitionBy(*keys)
    df = df.withColumn("_q", F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(w))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    outside = (F.col(value) < q1 - factor * (q3 - q1)) | (F.col(value) > q3 + factor * (q3 - q1))
    return df.withColumn(out, _mask((F.count(value).over(w) >= 4) & outside)).drop("_q")


def contextual(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0, by_weekday: bool = False, min_group: int = 5, ts: str = "ts", out: str = "is_contextual_outlier") -> DataFrame:
    """Deviation within the hour of day, or hour and weekday."""
    _positive(threshold)
    parts = [F.hour(ts)] + ([F.weekday(ts)] if by_weekday else [])
    w = Window.partitionBy(*keys, *parts)
    sd = F.stddev_samp(value).over(w)
    z = F.abs(F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))
    return df.withColumn(out, _mask((F.count(value).over(w) >= min_group) & (sd > 0) & (z > threshold)))


def rolling(df: DataFrame, keys: list[str], value: str, hours: int = 48, threshold: float = 3.0, min_periods: int = 10, ts: str = "ts", out: str = "is_rolling_outlier") -> DataFrame:
    """Deviation from the centred local median in units of the local deviation."""
    _positive(threshold)
    w = centred_time(keys, hours * MICROS["hour"], ts)
    sd = at_least(min_periods, value, w, F.stddev_samp(value))
    df = df.withColumns({"_sd": sd, "_med": at_least(min_periods, value, w, median(value))})
    z = F.abs(F.col(value) - F.col("_med")) / F.when(F.col("_sd") > STD_FLOOR, F.col("_sd"))
    return df.withColumn(out, _mask(z > threshold)).drop("_sd", "_med")


def joint_distance(df: DataFrame, keys: list[str], a: str, b: str, contamination: float = 0.05, out: str = "is_multivariate_outlier") -> DataFrame:
    """Flag the share of rows with the largest Mahalanobis distance of two columns.

    Means and covariances come from one map-side-combined aggregate per key.
    """
    if not 0.0 < contamination < 0.5:
        raise ValueError(f"the outlier share must lie between 0 and 0.5, not {contamination}")
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    stats = df.filter(both).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
        F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"), F.covar_samp(a, b).alias("_c"),
    )
    da, db = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    det = F.col("_va") * F.col("_vb") - F.col("_c") * F.col("_c")
    d2 = (F.col("_vb") * da * da - 2.0 * F.col("_c") * da * db + F.col("_va") * db * db) / F.when(det > STD_FLOOR, det)
    df = df.join(stats, keys, "left").withColumn("_d2", F.when(both & (F.col("_n") >= 10), d2))
    cut = F.percentile("_d2", F.lit(1.0 - contamination)).over(Window.partitionBy(*keys))
    return df.withColumn(out, _mask(F.col("_d2") > cut)).drop("_n", "_ma", "_mb", "_va", "_vb", "_c", "_d2")
