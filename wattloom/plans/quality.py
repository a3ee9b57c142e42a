"""Detection, repair, scoring and report of all meters in one lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.operators import ami, detectors, events
from wattloom.operators.impute import impute


def clean_meters(df: DataFrame, keys: list[str], value: str = "demand_kwh", rows_per_week: int = 672, ts: str = "ts") -> DataFrame:
    """Flags, repaired value and score per slot; optional channels switch on their detectors.

    Every window partitions by the key, so the rows are shuffled once.
    """
    have = set(df.columns)
    df = detectors.frozen(df, keys, value, ts=ts)
    df = detectors.global_z(df, keys, value)
    df = detectors.iqr(df, keys, value)
    df = detectors.contextual(df, keys, value, ts=ts)
    df = detectors.rolling(df, keys, value, ts=ts)
    flags = ["is_frozen", "is_zscore_outlier", "is_iqr_outlier", "is_contextual_outlier", "is_rolling_outlier"]
    if {"kva", "kw"} <= have:
        df = events.pf_artefacts(events.ct_artefacts(df, keys, ts=ts), keys, ts=ts)
        df = df.drop("kva_base", "kva_sigma", "kw_base", "kw_sigma", "kva_local", "kw_local")
        flags += ["is_ct_artefact", "is_pf_artefact"]
    else:
        df = df.withColumns({"is_ct_artefact": F.lit(False), "is_pf_artefact": F.lit(False)})
    if "grid_import" in have:
        df = events.generator_on(df, keys, site_load="site_load" if "site_load" in have else None, ts=ts)
        if "voltage" in have:
            df = events.voltage_signature(df, keys, ts=ts)
        df = events.generator_periods(df, keys, ts=ts).drop("is_dg_voltage")
    if {"kva", "kw", "pf"} <= have:
        df = events.capacitor_events(df, keys, ts=ts)
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.col(f)
    df = df.withColumn("is_anomaly", bad).withColumn("is_imputed", F.col("is_anomaly") | F.col(value).isNull())
    df = impute(df, keys, value, "is_anomaly", "hybrid", rows_per_week, ts=ts, out=f"{value}_clean")
    return ami.interval_score(df)


def quality_report(df: DataFrame, keys: list[str], value: str = "demand_kwh") -> DataFrame:
    """One row per key: share of slots per flag in percent, event count and mean score."""
    def pct(c: Column) -> Column:
        return F.avg(c.cast("double")) * 100.0

    names = {
        "frozen_pct": "is_frozen", "zscore_outlier_pct": "is_zscore_outlier", "iqr_outlier_pct": "is_iqr_outlier", "contextual_outlier_pct": "is_contextual_outlier",
        "rolling_outlier_pct": "is_rolling_outlier", "ct_artefact_pct": "is_ct_artefact", "pf_artefact_pct": "is_pf_artefact", "total_anomaly_pct": "is_anomaly", "imputed_pct": "is_imputed",
    }
    dg = pct(F.col("is_dg")) if "is_dg" in df.columns else F.lit(0.0)
    apfc = F.count_if(F.col("is_apfc_event")) if "is_apfc_event" in df.columns else F.lit(0)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_intervals"), pct(F.col(value).isNull()).alias("missing_pct"), *[pct(F.col(c)).alias(n) for n, c in names.items()],
        dg.alias("dg_period_pct"), apfc.alias("apfc_event_count"), F.avg("quality_score").alias("mean_quality_score"))
