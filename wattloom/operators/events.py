"""Signal artefacts, generator periods, capacitor switching and battery rest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom import constants as K
from wattloom.operators.frames import MICROS, at_least, centred_time, fill_both, median, ordered, trailing_time

STD_FLOOR = 1e-9
BASELINE_US = 48 * MICROS["hour"]
SHORT_US = 75 * MICROS["minute"]


def _mask(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _safe(c: Column) -> Column:
    return F.when(c > STD_FLOOR, c)


def with_baseline(df: DataFrame, keys: list[str], value: str, width_us: int = BASELINE_US, ts: str = "ts") -> DataFrame:
    """Trailing median and deviation of a channel as ``<value>_base`` and ``<value>_sigma``."""
    w = trailing_time(keys, width_us, ts)
    return df.withColumns({
        f"{value}_base": at_least(10, value, w, median(value)),
        f"{value}_sigma": at_least(10, value, w, F.stddev_samp(value)),
    })


def ct_artefacts(df: DataFrame, keys: list[str], sigma: float = 3.0, frequency: str | None = "frequency", ts: str = "ts") -> DataFrame:
    """Apparent-power spikes against the trailing baseline while grid frequency leaves its band."""
    if sigma <= 0:
        raise ValueError(f"sigma must be positive, got {sigma}")
    if "kva_base" not in df.columns:
        df = with_baseline(df, keys, "kva", ts=ts)
    dev = F.abs(F.col("kva") - F.col("kva_base")) / _safe(F.col("kva_sigma"))
    if frequency and frequency in df.columns:
        lo, hi = K.FREQUENCY_BAND
        hit = (dev > sigma) & ((F.col(frequency) < lo) | (F.col(frequency) > hi))
    else:
        hit = dev > sigma + 1.0
    return df.withColumn("is_ct_artefact", _mask(hit))


def pf_artefacts(df: DataFrame, keys: list[str], sigma: float = 3.0, short_us: int = SHORT_US, ts: str = "ts") -> DataFrame:
    """Apparent-power spikes against the local median while real power stays within one deviation."""
    for c in ("kva", "kw"):
        if f"{c}_sigma" not in df.columns:
            df = with_baseline(df, keys, c, ts=ts)
    w = centred_time(keys, short_us, ts)
    df = df.withColumns({f"{c}_local": at_least(3, c, w, median(c)) for c in ("kva", "kw")})
    spike = F.abs(F.col("kva") - F.col("kva_local")) / _safe(F.col("kva_sigma")) > sigma
    stable = F.abs(F.col("kw") - F.col("kw_local")) / _safe(F.col("kw_sigma")) < 1.0
    return df.withColumn("is_pf_artefact", _mask(spike & stable))


def clean_signal(df: DataFrame, keys: list[str], sigma: float = 3.0, short_us: int = SHORT_US, ts: str = "ts") -> DataFrame:
    """Replace artefacts by the local median, then fill forward and backward."""
    df = pf_artefacts(ct_artefacts(df, keys, sigma, ts=ts), keys, sigma, short_us, ts)
    df = df.withColumn("is_artefact", F.col("is_ct_artefact") | F.col("is_pf_artefact"))
    df = df.withColumn("kva_clean", F.when(F.col("is_artefact"), F.col("kva_local")).otherwise(F.col("kva")))
    return df.withColumn("kva_clean", fill_both("kva_clean", keys, ts))


def _above_floor(df: DataFrame, keys: list[str], value: str, out: str, ts: str) -> DataFrame:
    base = at_least(10, value, trailing_time(keys, BASELINE_US, ts), median(value))
    floor = F.percentile(value, F.lit(0.1)).over(Window.partitionBy(*keys))
    df = df.withColumns({"_b": base, "_f": floor})
    return df.withColumn(out, F.when(F.col("_b").isNotNull(), F.greatest("_b", "_f"))).drop("_b", "_f")


def generator_on(df: DataFrame, keys: list[str], grid_import: str = "grid_import", site_load: str | None = None, drop_pct: float = 5.0, load_pct: float = 50.0, ts: str = "ts") -> DataFrame:
    """Grid import collapses below a share of its baseline; optionally the site load goes on."""
    if not 0 < drop_pct < 100:
        raise ValueError(f"drop_pct must be in (0, 100), got {drop_pct}")
    df = _above_floor(df, keys, grid_import, "_ib", ts)
    on = F.col(grid_import) / F.nullif(F.col("_ib"), F.lit(0.0)) < drop_pct / 100.0
    drop = ["_ib"]
    if site_load:
        df = _above_floor(df, keys, site_load, "_lb", ts)
        on = on & (F.col(site_load) / F.nullif(F.col("_lb"), F.lit(0.0)) > load_pct / 100.0)
        drop.append("_lb")
    return df.withColumn("is_dg", _mask(on)).drop(*drop)


def voltage_signature(df: DataFrame, keys: list[str], voltage: str = "voltage", width_us: int = 30 * MICROS["minute"], cv: float = 0.05, ts: str = "ts") -> DataFrame:
    w = centred_time(keys, width_us, ts)
    mean = at_least(3, voltage, w, F.avg(voltage))
    ratio = at_least(3, voltage, w, F.stddev_samp(voltage)) / F.when(mean > 0, mean)
    return df.withColumn("is_dg_voltage", _mask(ratio > cv))


def generator_periods(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Confidence, transition label and period number from ``is_dg`` (and ``is_dg_voltage`` where present)."""
    w = ordered(keys, ts)
    df = df.withColumn("_was", F.lag("is_dg").over(w))
    up, down = _mask(F.col("is_dg") & ~F.col("_was")), _mask(~F.col("is_dg") & F.col("_was"))
    sure = F.col("is_dg_voltage") if "is_dg_voltage" in df.columns else F.lit(False)
    period = F.sum(up.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({
        "dg_confidence": F.when(~F.col("is_dg"), "none").when(sure, "high").otherwise("medium"),
        "dg_event_type": F.when(up, "grid_to_dg").when(down, "dg_to_grid").when(F.col("is_dg"), "dg_running"),
        "dg_period_id": F.when(F.col("is_dg"), period).otherwise(-1),
    }).drop("_was")


def capacitor_events(df: DataFrame, keys: list[str], kva_step: float = 50.0, kw_sigma: float = 1.0, target: tuple[float, float] = (0.95, 1.0), ts: str = "ts") -> DataFrame:
    """Apparent-power steps with stable real power and a power-factor jump."""
    if kva_step <= 0 or kw_sigma <= 0 or not 0 <= target[0] < target[1] <= 1:
        raise ValueError("invalid capacitor thresholds")
    w = ordered(keys, ts)
    df = df.withColumns({
        "_dkva": F.abs(F.col("kva") - F.lag("kva").over(w)),
        "_dkw": F.abs(F.col("kw") - F.lag("kw").over(w)),
        "_sd": at_least(10, "kw", trailing_time(keys, BASELINE_US, ts), F.stddev_samp("kw")),
        "_pf": F.lag("pf").over(w),
    })
    step = (F.col("_dkva") > kva_step) & (F.col("_dkw") / _safe(F.col("_sd")) < kw_sigma)
    jump = F.col("pf") - F.col("_pf")
    into = _mask(step & (F.col("_pf") < target[0]) & (jump > 0.02))
    away = _mask(step & F.col("_pf").between(*target) & (jump < -0.02))
    return df.withColumns({
        "is_apfc_event": into | away,
        "apfc_event_type": F.when(into, "cap_switch_in").when(away, "cap_switch_out"),
        "kva_step_magnitude": F.when(into | away, F.col("_dkva")).otherwise(0.0),
    }).drop("_dkva", "_dkw", "_sd", "_pf")


def normalise_capacitor(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """At switching events apparent power is real power over the power factor before the event."""
    w = ordered(keys, ts)
    df = df.withColumns({"_kva": F.lag("kva").over(w), "_kw": F.lag("kw").over(w)})
    pf = F.when(F.col("_kva") > 0, F.col("_kw") / F.nullif(F.col("_kva"), F.lit(0.0)))
    fixed = F.when(F.col("is_apfc_event") & (pf > 0), F.col("kw") / F.nullif(pf, F.lit(0.0)))
    return df.withColumn("kva_normalised", F.coalesce(fixed, F.col("kva"))).drop("_kva", "_kw")


def rest_states(df: DataFrame, keys: list[str], minutes_per_row: float = 15.0, rest_minutes: float = 30.0, ts: str = "ts") -> DataFrame:
    """Periods with negligible current: start, end, duration, mean state of charge and a label."""
    w = ordered(keys, ts)
    limit = F.percentile(F.abs("current"), F.lit(0.95)).over(Window.partitionBy(*keys)) * 0.02
    df = df.withColumn("_rest", _mask(F.abs("current") < limit))
    first = F.col("_rest") & ~F.coalesce(F.lag("_rest").over(w), F.lit(False))
    df = df.withColumn("_id", F.sum(first.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.filter("_rest").groupBy(*keys, "_id").agg(
        F.min(ts).alias("state_start"), F.max(ts).alias("state_end"), (F.count("soc") * minutes_per_row).alias("duration_min"), F.avg("soc").alias("mean_soc")
    )
    label = F.when(F.col("mean_soc") < 5, "full_discharge").when(F.col("mean_soc") > 98, "full_charge").otherwise("rest")
    return out.filter(F.col("duration_min") >= rest_minutes).withColumn("state_type", label).drop("_id")
