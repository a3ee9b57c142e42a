"""Thermal, radiation, air-quality and solar-geometry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def above(value: Column, base: float) -> Column:
    return F.greatest(value - base, F.lit(0.0))


def below(value: Column, base: float) -> Column:
    return F.greatest(F.lit(base) - value, F.lit(0.0))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def safe_ratio(num: Column, den: Column, floor: float = 10.0) -> Column:
    return F.when(den > floor, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def apparent_temperature(t: Column, rh: Column) -> Column:
    """Temperature plus the effect of vapour pressure."""
    vapour = rh / 100.0 * 6.105 * F.exp(17.27 * t / (237.7 + t))
    return t + 0.33 * vapour - 4.0


def heat_index(t: Column, rh: Column) -> Column:
    """Polynomial of temperature and humidity."""
    t2, rh2 = t * t, rh * rh
    return (
        -8.785 + 1.611 * t + 2.339 * rh - 0.146 * t * rh - 0.013 * t2 - 0.016 * rh2
        + 0.002 * t2 * rh + 0.001 * t * rh2 - 3.58e-6 * t2 * rh2
    )


def add_degree_hours(df: DataFrame, t: str = "temperature", rh: str = "humidity") -> DataFrame:
    temp = F.col(t)
    return df.withColumns({
        "cdh": above(temp, 26.0), "cdh_squared": above(temp, 26.0) * above(temp, 26.0), "hdh": below(temp, 18.0),
        "cooling_deg": above(temp, 25.0), "heating_deg": below(temp, 18.0), "cdd_21": above(temp, 21.0), "hdd_21": below(temp, 21.0),
        "is_extreme_heat": (temp > 35).cast("int"), "rh_above_70": (F.col(rh) > 70).cast("int"),
        "heat_index": heat_index(temp, F.col(rh)), "comfort_cdh": above(heat_index(temp, F.col(rh)), 26.0),
    })


def add_conditions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "wind_above_5ms": (F.col("wind_speed") > 5).cast("int"), "cloud_fraction": F.col("cloud_cover") / 100.0,
        "is_overcast": (F.col("cloud_cover") > 80).cast("int"), "is_raining": (F.col("precipitation") > 0.1).cast("int"),
        "is_heavy_rain": (F.col("precipitation") > 5.0).cast("int"),
    })


def add_radiation_ratios(df: DataFrame) -> DataFrame:
    ghi = F.col("ghi")
    return df.withColumns({
        "solar_producing": (ghi > 10).cast("int"), "solar_peak": (ghi > 500).cast("int"),
        "dni_ghi_ratio": safe_ratio(F.col("dni"), ghi), "diffuse_fraction": clip(safe_ratio(F.col("dhi"), ghi), 0.0, 1.0),
        "clearsky_ratio": clip(safe_ratio(ghi, F.col("clear_sky")), 0.0, 1.5),
        "cloud_ghi_interaction": F.col("cloud_cover") / 100.0 * ghi,
    })


def add_interactions(df: DataFrame) -> DataFrame:
    cdh = F.col("cdh")
    return df.withColumns({
        "cdh_x_business": cdh * F.col("is_business_hour"), "cdh_x_peak": cdh * F.col("is_peak_hour"),
        "cdh_x_weekend": cdh * F.col("is_weekend"), "ghi_x_business": F.col("ghi") * F.col("is_business_hour"),
    })


def clear_sky_ghi(ts: str | Column, latitude: Column, longitude: Column) -> Column:
    """Clear-sky irradiance in W/m2 from sun position and air mass; wall clock of the 82.5 degree meridian."""
    hours = F.hour(ts) + F.minute(ts) / 60.0
    declination = F.radians(23.45 * F.sin(F.radians((F.dayofyear(ts) - 81) * (360.0 / 365.0))))
    noon = 12.0 - (longitude - 82.5) / 15.0
    angle = F.radians((hours - noon) * 15.0)
    lat = F.radians(latitude)
    sin_el = clip(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(angle), -1.0, 1.0)
    mass = 1.0 / clip(sin_el, 0.01, 1.0)
    return F.when(sin_el > 0, F.greatest(1000.0 * sin_el * F.exp(-0.185 * mass), F.lit(0.0))).otherwise(0.0)


def cloud_factor(cloud_pct: Column) -> Column:
    return clip(1.0 - 0.75 * F.pow(cloud_pct / 100.0, F.lit(1.5)), 0.1, 1.0)


def add_solar_generation(df: DataFrame, ghi: str, capacity_kw: str, cloud_pct: str | None = None, performance: float = 0.80) -> DataFrame:
    clear = F.col(capacity_kw) * (F.col(ghi) / 1000.0) * performance
    factor = cloud_factor(F.col(cloud_pct)) if cloud_pct else F.lit(1.0)
    df = df.withColumns({"clear_sky_kwh": clear, "cloud_factor": factor, "generation_kwh": clear * factor})
    return df.withColumn("capacity_factor", F.when(F.col(capacity_kw) > 0, F.col("generation_kwh") / F.nullif(F.col(capacity_kw), F.lit(0.0))).otherwise(0.0))
