"""Greedy battery schedules per site and day, sizing sweeps and schedule figures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wattloom.functions.money import confidence_weight, landed_cost
from wattloom.operators.frames import ffill
from wattloom.operators.joins import asof_last

HOUR_FIELDS = ["solar_direct", "charge", "discharge", "soc", "grid", "iex", "landed"]
COST_FIELDS = ["total_cost_inr", "solar_savings_inr", "bess_savings_inr", "baseline_cost_inr", "reliability"]
EFFICIENCY = 0.88
SOC_MIN, SOC_MAX, SOC_START = 0.10, 0.90, 0.50


def day_vectors(df: DataFrame, keys: list[str], hour: str, columns: list[str], default: float = 0.0, means: tuple[str, ...] = ("price",)) -> DataFrame:
    """Twenty-four values per key and column, in hour order, from conditional aggregates combined on the map side.

    Energy of the rows of an hour adds up; the columns in ``means`` are averaged.
    """
    def vector(c: str) -> Column:
        whole = F.avg if c in means else F.sum
        return F.array(*[F.coalesce(whole(F.when(F.col(hour) == h, F.col(c))), F.lit(default)) for h in range(24)])

    return df.groupBy(*keys).agg(*[vector(c).alias(c) for c in columns])


def run_days(demand: np.ndarray, solar: np.ndarray, landed: np.ndarray, cap: np.ndarray, kw: np.ndarray, strategy: np.ndarray, tariff: float) -> dict[str, np.ndarray]:
    """Hour by hour over many days at once; arrays are days x 24.

    Solar serves demand first; the battery charges by strategy, discharges in the dearest hours of the day, and the rest
    is bought from the cheaper source.  Among equally dear hours the later one counts first.  A day without capacity has
    no battery.
    """
    days, hours = demand.shape
    root = math.sqrt(EFFICIENCY)
    lo, hi, soc = cap * SOC_MIN, cap * SOC_MAX, cap * SOC_START
    dearest = np.argsort(landed, axis=1, kind="stable")[:, ::-1]
    peak = np.zeros((days, hours), dtype=bool)
    n_peak = np.floor(cap / np.maximum(kw, 1.0))
    np.put_along_axis(peak, dearest, np.arange(hours)[None, :] < n_peak[:, None], axis=1)
    full, cheap_grid, known = strategy == "full_solar", strategy == "cheap_grid", np.isin(strategy, ["full_solar", "cheap_grid", "solar_surplus"])
    out = {f: np.zeros((days, hours)) for f in HOUR_FIELDS}
    for h in range(hours):
        d, s, low = demand[:, h], solar[:, h], landed[:, h] < tariff
        direct = np.minimum(s, d)
        rest = d - direct
        room = np.where(soc < hi, np.minimum(hi - soc, kw), 0.0)
        sun = np.where(known, np.minimum(np.where(full, s, s - direct), room), 0.0)
        bought = np.where(cheap_grid & low & (sun < room), np.minimum(room - sun, kw - sun), 0.0)
        soc = soc + (sun + bought) * root
        drawn = np.where((rest > 0) & peak[:, h] & (soc > lo), np.minimum(np.minimum(soc - lo, kw), rest), 0.0)
        soc = soc - drawn
        left = np.maximum(rest - drawn * root, 0.0)
        row = {"solar_direct": direct, "charge": sun + bought, "discharge": drawn * root, "soc": soc, "grid": np.where(low, 0.0, left), "iex": bought + np.where(low, left, 0.0), "landed": landed[:, h]}
        for f, v in row.items():
            out[f][:, h] = v
    return out


def _arrays(*columns: pd.Series) -> list[np.ndarray]:
    return [np.stack(c.to_list()).astype(float) for c in columns]


def _inputs(demand: str, solar: str, price: str, capacity: str, power: str, strategy: str) -> list[Column]:
    return [F.col(demand), F.col(solar), F.transform(price, landed_cost), F.col(capacity).cast("double"), F.col(power).cast("double"), F.col(strategy)]


def greedy_day(df: DataFrame, demand: str = "demand", solar: str = "solar", price: str = "price", capacity: str = "capacity_kwh", power: str = "power_kw", strategy: str = "strategy", tariff: float = 6.5) -> DataFrame:
    """Hourly schedule of each row's day as a struct of arrays; see ``run_days``.

    The charge level depends on the hour before, which no column expression carries cheaply: a fold over arrays costs
    about 0.4 ms per day in the JVM, an Arrow batch of days a few microseconds.
    """
    kind = "struct<" + ",".join(f"{f}:array<double>" for f in HOUR_FIELDS) + ">"

    @F.pandas_udf(kind)
    def schedule(d: pd.Series, s: pd.Series, x: pd.Series, cap: pd.Series, kw: pd.Series, plan: pd.Series) -> pd.DataFrame:
        if len(d) == 0:
            return pd.DataFrame({f: pd.Series([], dtype=object) for f in HOUR_FIELDS})
        out = run_days(*_arrays(d, s, x), cap.to_numpy(), kw.to_numpy(), plan.to_numpy(), tariff)
        return pd.DataFrame({f: list(v) for f, v in out.items()})

    return df.withColumn("schedule", schedule(*_inputs(demand, solar, price, capacity, power, strategy)))


def hourly_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(f"schedule.{f}") for f in HOUR_FIELDS])
    return df.select(*keys, F.posexplode(zipped).alias("hour", "r")).select(*keys, "hour", *[F.col(f"r.{f}").alias(f) for f in HOUR_FIELDS])


def day_costs(df: DataFrame, demand: str = "demand", solar: str = "solar", price: str = "price", capacity: str = "capacity_kwh", power: str = "power_kw", strategy: str = "strategy", tariff: float = 6.5) -> DataFrame:
    """Cost, savings and reliability of each row's day; only the totals leave the Python batch."""
    kind = "struct<" + ",".join(f"{f}:double" for f in COST_FIELDS) + ">"

    @F.pandas_udf(kind)
    def costs(d: pd.Series, s: pd.Series, x: pd.Series, cap: pd.Series, kw: pd.Series, plan: pd.Series) -> pd.DataFrame:
        if len(d) == 0:
            return pd.DataFrame({f: pd.Series([], dtype=float) for f in COST_FIELDS})
        load, sun, landed = _arrays(d, s, x)
        r = run_days(load, sun, landed, cap.to_numpy(), kw.to_numpy(), plan.to_numpy(), tariff)
        total = r["grid"].sum(axis=1) * tariff + (r["iex"] * landed).sum(axis=1)
        saved, base = r["solar_direct"].sum(axis=1) * tariff, load.sum(axis=1) * tariff
        served = (r["solar_direct"] + r["discharge"] + r["grid"] + r["iex"]) / np.maximum(load, 0.001)
        return pd.DataFrame({"total_cost_inr": total, "solar_savings_inr": saved, "bess_savings_inr": base - total - saved, "baseline_cost_inr": base, "reliability": np.minimum(served, 1.0).mean(axis=1)})

    out = df.withColumn("_c", costs(*_inputs(demand, solar, price, capacity, power, strategy)))
    return out.select(*df.columns, "_c.*")


def size_sweep(days: DataFrame, grid: DataFrame, site: str, capex_per_kwh: float = 15000.0, tariff: float = 6.5) -> DataFrame:
    """Annual savings, payback and simple return of every configuration of a site."""
    runs = days.join(grid.withColumnsRenamed({"size_kwh": "capacity_kwh", "max_power_kw": "power_kw"}), site)
    runs = day_costs(runs, tariff=tariff)
    keys = [site, "capacity_kwh", "duration_h", "strategy", "power_kw"]
    out = runs.groupBy(*keys).agg(F.sum(F.col("bess_savings_inr") + F.col("solar_savings_inr")).alias("_s"), F.count("*").alias("n_days"))
    annual = F.when(F.col("n_days") < 365, F.col("_s") * 365.0 / F.col("n_days")).otherwise(F.col("_s"))
    out = out.withColumns({"annual_savings_inr": annual, "capex_inr": F.col("capacity_kwh") * capex_per_kwh})
    ok = (F.col("annual_savings_inr") > 0) & (F.col("capex_inr") > 0)
    return out.withColumns({
        "payback_years": F.col("capex_inr") / F.greatest("annual_savings_inr", F.lit(1.0)),
        "irr": F.when(ok, F.col("annual_savings_inr") / F.nullif(F.col("capex_inr"), F.lit(0.0))).otherwise(-1.0),
    }).drop("_s")


def compare_batteries(days: DataFrame, keys: list[str], batteries: list[tuple[str, float, float]], site: str, capex_per_kwh: float = 15000.0) -> DataFrame:
    """No battery against several sizes: annual savings, capex and payback per site and size."""
    options = F.array(*[F.struct(F.lit(n).alias("battery"), F.lit(c).alias("capacity_kwh"), F.lit(p).alias("power_kw")) for n, c, p in [("none", 0.0, 0.0), *batteries]])
    runs = days.withColumn("_o", F.explode(options)).select(*days.columns, "_o.*").withColumn("strategy", F.lit("cheap_grid"))
    cost = day_costs(runs).select(*keys, "battery", "capacity_kwh", "total_cost_inr")
    per_day = cost.groupBy(*keys).agg(F.max(F.when(F.col("battery") == "none", F.col("total_cost_inr"))).alias("_base"), F.collect_list(F.struct("battery", "capacity_kwh", "total_cost_inr")).alias("_l"))
    rows = per_day.select(*keys, "_base", F.explode("_l").alias("o")).select(*keys, "_base", "o.*").filter("battery <> 'none'")
    out = rows.groupBy(site, "battery", "capacity_kwh").agg((F.sum(F.col("_base") - F.col("total_cost_inr")) * 365.0 / F.count("*")).alias("annual_savings_inr"), F.count("*").alias("n_days"))
    capex = F.col("capacity_kwh") * capex_per_kwh
    return out.withColumns({"capex_inr": capex, "payback_years": F.when(F.col("annual_savings_inr") > 0, capex / F.nullif(F.col("annual_savings_inr"), F.lit(0.0)))})


def schedule_kpis(df: DataFrame, key: str, capacity_kwh: float) -> DataFrame:
    c, d, g = F.col("charge_kwh"), F.col("discharge_kwh"), F.col("grid_kwh")
    out = df.groupBy(key).agg(
        F.sum(F.col("iex_price") * d).alias("revenue_inr"), (F.sum(F.col("landed_cost") * g) + F.sum(F.col("iex_price") * c)).alias("cost_inr"),
        ((F.sum(c) + F.sum(d)) / max(2.0 * capacity_kwh, 1e-6)).alias("cycles"), F.max(g).alias("peak_grid_kwh"))
    return out.withColumn("net_benefit_inr", F.col("revenue_inr") - F.col("cost_inr"))


def align_inputs(forecast: DataFrame, prices: DataFrame, key: str, energy: str, label: str, mape: str, landed: float = 8.2, slots: int = 192, ts: str = "ts") -> DataFrame:
    """Energy, price, label and confidence weight on one quarter-hour grid of fixed length per site."""
    first = forecast.groupBy(key).agg(F.min(ts).alias("_s"))
    grid = first.select(key, F.explode(F.expr(f"sequence(_s, _s + interval {15 * (slots - 1)} minutes, interval 15 minutes)")).alias(ts))
    cols = [energy, label, mape]
    held = grid.join(forecast.select(key, ts, *cols), [key, ts], "left")
    held = held.withColumns({c: ffill(c, [key], ts) for c in cols})
    price = asof_last(grid.select(ts).distinct(), prices, ts, "price")
    return held.join(price, ts, "left").withColumns({
        "demand_kwh": F.col(energy) / 2.0, "landed_cost": F.lit(landed), "confidence_weight": confidence_weight(F.coalesce(F.col(mape), F.lit(8.0))),
        label: F.coalesce(F.col(label), F.lit("peak")),
    })
