"""Meter packet rules: lateness, channel completeness, physical limits, consistency, interval score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom import constants as K


def flag_late(df: DataFrame, ts: str = "ts", arrival: str = "arrival_ts", max_intervals: int = 8, minutes: int = 15) -> DataFrame:
    """Delay and late flag per packet; packets beyond the limit are dropped.  Works on batch and on streams."""
    if arrival not in df.columns:
        return df.withColumn("is_late", F.lit(False))
    delay = (F.unix_micros(arrival) - F.unix_micros(ts)) / 60_000_000.0
    kept = F.coalesce(F.col("packet_delay_min") <= float(max_intervals * minutes), F.lit(True))
    return (
        df.withColumn("packet_delay_min", delay)
        .withColumn("is_late", F.coalesce(F.col("packet_delay_min") > 2.0 * minutes, F.lit(False)))
        .filter(kept)
    )


def sync_channels(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    required = [c for c in K.CHANNELS if c in df.columns] if required is None else required
    for c in required:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return df.withColumn("channels_complete", complete)


def check_limits(df: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``<channel>_range_valid`` per present channel; a missing value is valid."""
    for c, (lo, hi) in (limits or K.CHANNEL_LIMITS).items():
        if c in df.columns:
            df = df.withColumn(f"{c}_range_valid", F.coalesce(F.col(c).between(lo, hi), F.lit(True)))
    return df


def check_consistency(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    have, ok = set(df.columns), F.lit(True)
    kva = F.col("kva") if "kva" in have else None
    if {"kw", "kvar", "kva"} <= have:
        dev = F.abs(F.sqrt(F.col("kw") * F.col("kw") + F.col("kvar") * F.col("kvar")) - kva) / F.nullif(kva, F.lit(0.0))
        ok = ok & F.when(kva > 0, F.coalesce(dev <= tolerance, F.lit(False))).otherwise(True)
    if {"kw", "kva", "pf"} <= have:
        dev = F.abs(F.col("kw") / F.nullif(kva, F.lit(0.0)) - F.col("pf"))
        ok = ok & F.when((kva > 0) & F.col("pf").isNotNull(), F.coalesce(dev <= tolerance, F.lit(False))).otherwise(True)
    return df.withColumn("physically_consistent", ok)


def interval_score(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """0 to 1 score from completeness, timeliness, validity and consistency, whichever inputs are present."""
    required = [c for c in K.CHANNELS if c in df.columns] if required is None else required

    def share(flags: list[Column]) -> Column:
        return sum((f.cast("double") for f in flags), F.lit(0.0)) / float(len(flags)) if flags else F.lit(1.0)

    completeness = (
        sum((F.col(c).isNotNull().cast("double") for c in required if c in df.columns), F.lit(0.0)) / float(len(required))
        if required else F.lit(1.0)
    )
    timeliness = F.lit(1.0)
    if "is_late" in df.columns:
        late_value = F.lit(0.0)
        if "packet_delay_min" in df.columns:
            d = F.least(F.greatest(F.col("packet_delay_min"), F.lit(K.LATE_RAMP_START_MIN)), F.lit(K.LATE_RAMP_END_MIN))
            late_value = 1.0 - (1.0 - K.LATE_RAMP_FLOOR) * (d - K.LATE_RAMP_START_MIN) / (K.LATE_RAMP_END_MIN - K.LATE_RAMP_START_MIN)
        timeliness = F.when(F.col("is_late"), late_value).otherwise(1.0)
    validity = share([F.col(c) for c in df.columns if c.endswith("_range_valid")])
    consistency = F.col("physically_consistent").cast("double") if "physically_consistent" in df.columns else F.lit(1.0)
    w = K.SCORE_WEIGHTS
    return df.withColumn(
        "quality_score",
        w["completeness"] * completeness + w["timeliness"] * timeliness + w["validity"] * validity + w["consistency"] * consistency,
    )
