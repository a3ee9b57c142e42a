"""Repair of missing and anomalous slots on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.operators.frames import newest_first, ordered


def _neighbours(df: DataFrame, keys: list[str], value: str, ts: str, tag: str) -> DataFrame:
    """Previous and next present value with their time and row number."""
    back = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.unix_micros(ts).alias("t"), F.col("_rn").alias("r")))
    return df.withColumns({f"_p{tag}": F.last(here, ignorenulls=True).over(back), f"_n{tag}": F.last(here, ignorenulls=True).over(newest_first(keys, ts))})


def _linear(value: str, ts: str, tag: str) -> Column:
    """Linear in time between neighbours; after the last value it is held; before the first it stays missing."""
    p, n, t = F.col(f"_p{tag}"), F.col(f"_n{tag}"), F.unix_micros(ts)
    line = p["v"] + (n["v"] - p["v"]) * ((t - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0)))
    return F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNull(), p["v"]).when(p.isNotNull(), line)


def _position(tag: str) -> Column:
    return F.col("_rn") - F.coalesce(F.col(f"_p{tag}")["r"], F.lit(0))


def impute(df: DataFrame, keys: list[str], value: str, mask: str | None = None, method: str = "hybrid", rows_per_week: int = 672, short_gap: int = 4, ts: str = "ts", out: str = "imputed") -> DataFrame:
    """``interpolate``, ``seasonal`` or ``hybrid`` repair; what cannot be repaired stays null."""
    if method not in ("interpolate", "seasonal", "hybrid"):
        raise ValueError(f"unknown method: {method}")
    w = ordered(keys, ts)
    start = F.when(~F.coalesce(F.col(mask), F.lit(False)), F.col(value)) if mask else F.col(value)
    df = df.withColumns({"_v0": start, "_rn": F.row_number().over(w)})
    if method == "interpolate":
        df = _neighbours(df, keys, "_v0", ts, "a")
        df = df.withColumn("_v1", F.when(F.col("_v0").isNotNull() | (_position("a") <= 6), _linear("_v0", ts, "a")))
        df = _neighbours(df, keys, "_v1", ts, "b")
        df = df.withColumn("_v2", F.when(F.col("_v1").isNotNull() | (_position("b") <= 3), F.coalesce("_v1", F.col("_pb")["v"])))
        df = _neighbours(df, keys, "_v2", ts, "c")
        ahead = F.col("_nc")["r"] - F.col("_rn")
        res = F.coalesce("_v2", F.when(ahead <= 3, F.col("_nc")["v"]))
    else:
        if method == "hybrid":
            df = df.withColumn("_len", F.count("*").over(Window.partitionBy(*keys)))
            df = _neighbours(df, keys, "_v0", ts, "a")
            length = F.coalesce(F.col("_na")["r"], F.col("_len") + 1) - F.coalesce(F.col("_pa")["r"], F.lit(0)) - 1
            df = df.withColumn("_v1", F.when(F.col("_v0").isNotNull() | (length < short_gap), _linear("_v0", ts, "a")))
        else:
            df = df.withColumn("_v1", F.col("_v0"))
        df = df.withColumn("_v2", F.coalesce("_v1", F.lag("_v1", rows_per_week).over(w)))
        df = _neighbours(df, keys, "_v2", ts, "b")
        res = F.when(F.col("_v2").isNotNull() | (_position("b") <= 6), _linear("_v2", ts, "b"))
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.withColumn(out, res).select(*keep, out)
