"""Project economics: monthly bill, spreads, internal rate of return, sensitivity, brief."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wattloom import constants as K
from wattloom.functions.labels import health
from wattloom.functions.money import carbon_savings, demand_charge_savings, landed_cost
from wattloom.operators.ranking import top_per_key


def explode_values(df: DataFrame, **values: list) -> DataFrame:
    """Repeat rows for each combination of a few literal values."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df


def battery_grid(base: DataFrame, multiples: list[float], durations: list[int], strategies: list[str], size: str = "base_kwh") -> DataFrame:
    df = explode_values(base, _m=multiples, duration_h=durations, strategy=strategies)
    return df.withColumn("size_kwh", F.col(size) * F.col("_m")).withColumn("max_power_kw", F.col("size_kwh") / F.col("duration_h")).drop("_m", size)


def active_rows(df: DataFrame, tolerance_kwh: float = 0.001) -> DataFrame:
    df = df.withColumn("magnitude_kwh", F.greatest("charge_kwh", "discharge_kwh", "curtail_kwh"))
    return df.filter(F.col("magnitude_kwh") > tolerance_kwh)


def best_config(df: DataFrame, key: str, size: str = "size_kwh", target: float = 0.10) -> DataFrame:
    """Size with the best return (the smaller on ties) and the largest size that meets the target."""
    best = F.max(F.struct("irr", (-F.col(size)).alias("s")))
    return df.groupBy(key).agg(best.alias("_b"), F.max(F.when(F.col("irr") >= target, F.col(size))).alias("max_viable_kwh")).select(key, (-F.col("_b.s")).alias("best_size_kwh"), F.col("_b.irr").alias("best_irr"), "max_viable_kwh")


def monthly_economics(df: DataFrame, key: str, tariff: float = 6.5, contracted_kva: float = 100.0, ts: str = "ts") -> DataFrame:
    d, s, x = F.col("demand_kwh"), F.col("solar_kwh"), F.col("discharge_kwh")
    m = df.groupBy(key, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.sum(d).alias("total_consumption_kwh"), F.max(d).alias("peak_demand_kw"), (F.sum("grid_kwh") * tariff).alias("energy_charge_inr"),
        F.sum(F.col("iex_kwh") * landed_cost(F.col("iex_price"))).alias("market_cost_inr"), F.max(F.greatest(d - x, F.lit(0.0))).alias("reduced_peak_kw"),
        F.sum(F.least(s, d)).alias("_direct"), F.sum(x).alias("_x"), F.avg("iex_price").alias("_p"))
    m = m.withColumns({
        "demand_charge_inr": F.greatest(F.col("peak_demand_kw") / 0.95, F.lit(contracted_kva)) * K.DEMAND_CHARGE,
        "demand_charge_savings_inr": demand_charge_savings(F.col("peak_demand_kw"), F.col("reduced_peak_kw")),
        "solar_savings_inr": F.col("_direct") * tariff, "bess_savings_inr": F.col("_x") * tariff - F.col("_x") * F.col("_p") * 0.5,
        "co2_avoided_kg": carbon_savings(F.col("_direct"), F.col("_x")),
    })
    return m.withColumns({
        "total_bill_inr": F.col("energy_charge_inr") + F.col("market_cost_inr") + F.col("demand_charge_inr"),
        "total_savings_inr": F.col("solar_savings_inr") + F.col("bess_savings_inr") + F.col("demand_charge_savings_inr"),
    }).drop("_direct", "_x", "_p")


def month_spread(prices: DataFrame, n: int = 4) -> DataFrame:
    """Mean of the n cheapest and n dearest hours of a month (24 rows each), raw and landed, with the hours."""
    w = Window.partitionBy("month")
    df = prices.withColumns({"_a": F.row_number().over(w.orderBy("price", "hour")), "_d": F.row_number().over(w.orderBy(F.desc("price"), F.desc("hour"))), "_l": landed_cost(F.col("price"))})

    def mean(c: str, r: str) -> Column:
        return F.avg(F.when(F.col(r) <= n, F.col(c)))

    def hours(r: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col(r) <= n, F.struct(F.col(r).alias("r"), F.col("hour").alias("h")))))
        return F.array_join(F.transform(picked, lambda x: x["h"].cast("string")), ",")

    out = df.groupBy("month").agg(mean("price", "_a").alias("avg_charge"), mean("price", "_d").alias("avg_discharge"), mean("_l", "_a").alias("avg_charge_landed"), mean("_l", "_d").alias("avg_discharge_landed"), hours("_a").alias("cheapest_hours"), hours("_d").alias("expensive_hours"))
    return out.withColumns({"spread": F.col("avg_discharge") - F.col("avg_charge"), "landed_spread": F.col("avg_discharge_landed") - F.col("avg_charge_landed")})


def present_values(flows: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Value of each column of flows (one row a year) at the rate of that column."""
    growth, factor, total = 1.0 + rate, np.ones_like(rate), np.zeros_like(rate)
    for flow in flows:
        total += flow / factor
        factor *= growth
    return total


def bisect_rates(flows: np.ndarray, steps: int) -> np.ndarray:
    """Rate in [-0.99, 1] at which each column of flows is worth nothing, to a hundredth; the last midpoint where none is met."""
    out, at = np.zeros(flows.shape[1]), np.arange(flows.shape[1])
    lo, hi = np.full(len(at), -0.99), np.full(len(at), 1.0)
    at_lo = present_values(flows, lo)
    for _ in range(steps):
        mid = (lo + hi) / 2.0
        value = present_values(flows, mid)
        out[at] = mid
        left = at_lo * value < 0
        stuck = (mid == lo) | (mid == hi)  # no number lies between: the midpoint is either end from here on
        lo, hi, at_lo = np.where(left, lo, mid), np.where(left, mid, hi), np.where(left, at_lo, value)
        go = ~((np.abs(value) < 1e-2) | stuck)
        if not go.all():
            at, lo, hi, at_lo, flows = at[go], lo[go], hi[go], at_lo[go], flows[:, go]
        if not len(at):
            break
    return out


def irr(flows: Column, steps: int = 100) -> Column:
    """Internal rate of return by bisection in [-0.99, 1]; null without an initial outlay."""

    @F.arrow_udf(T.DoubleType())
    def rates(paths: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False)
        years = np.arange(sizes.max(initial=0))[:, None] < sizes  # shorter paths end in years without a flow
        table = np.zeros(years.shape)
        table.T[years.T] = pc.fill_null(pc.list_flatten(paths), 0.0).to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            return pa.array(bisect_rates(table, steps))

    return F.when(F.get(flows, F.lit(0)) < 0, rates(flows))


def project_irr(df: DataFrame, capex: str, annual: str, years: int = 10, discount: float = 0.10, escalation_pct: float = 2.0, degradation_pct: float = 2.5) -> DataFrame:
    """Rate of return in percent, present value and simple payback of every project row."""
    ratio = (1.0 - degradation_pct / 100.0, 1.0 + escalation_pct / 100.0)
    flows = [-F.col(capex), *[F.col(annual) * ratio[0] ** y / ratio[1] ** y for y in range(1, years + 1)]]
    df = df.withColumn("_f", F.array(*flows))
    value, cum, hits = F.lit(0.0), F.lit(0.0), []
    for y in range(years + 1):
        value, cum = value + F.col("_f")[y] / (1.0 + discount) ** y, cum + F.col("_f")[y]
        hits += [F.when(cum >= 0, F.lit(float(y)))] if y else []
    return df.withColumns({"irr_pct": irr(F.col("_f")) * 100.0, "npv_inr": value, "payback_years": F.coalesce(*hits)}).drop("_f")


def irr_heatmap(sites: DataFrame, daily_net: str, capacities: list[float], durations: list[int], reference_mwh: float = 1.0, capex_per_kwh: float = 25000.0, years: int = 10) -> DataFrame:
    df = explode_values(sites, capacity_mwh=capacities, duration_h=durations)
    df = df.withColumns({
        "capex_inr": F.col("capacity_mwh") * 1000.0 * capex_per_kwh,
        "annual_net_inr": F.col(daily_net) * 365.0 * (F.col("capacity_mwh") / max(reference_mwh, 1e-6)) * (1.0 + 0.05 * (F.col("duration_h") - 4)),
    })
    return project_irr(df, "capex_inr", "annual_net_inr", years)


# Relative changes of price, demand and capital cost.
SENSITIVITY = {"iex": [-0.20, -0.10, 0.0, 0.10, 0.20], "demand": [-0.10, -0.05, 0.0, 0.05, 0.10], "capex": [-0.15, -0.075, 0.0, 0.075, 0.15]}


def sensitivity(df: DataFrame, capex: str, annual: str, years: int = 10) -> DataFrame:
    cases = [F.struct(F.lit(k).alias("factor"), F.lit(v).alias("delta")) for k, vs in SENSITIVITY.items() for v in vs]
    df = df.withColumn("_c", F.explode(F.array(*cases)))
    df = df.withColumns({"factor": F.col("_c.factor"), "delta_pct": F.col("_c.delta") * 100.0})
    on_capex = F.col("factor") == "capex"
    df = df.withColumns({
        "case_capex": F.col(capex) * F.when(on_capex, 1.0 + F.col("_c.delta")).otherwise(1.0),
        "case_annual": F.col(annual) * F.when(on_capex, 1.0).otherwise(1.0 + F.col("_c.delta")),
    }).drop("_c")
    return project_irr(df, "case_capex", "case_annual", years)


def site_brief(schedule: DataFrame, key: str, hours: int = 24, ts: str = "ts", sentence: str = "audit") -> DataFrame:
    """Net benefit of the first day by time, its annual value, the audit sentences of the largest actions, and health."""
    c = F.col
    today = schedule.withColumn("_t0", F.min(ts).over(Window.partitionBy(key))).filter(c(ts) < c("_t0") + F.expr(f"interval {hours} hours"))
    net = F.sum(c("discharge_kwh") * c("iex_price") - c("grid_kwh") * c("landed_cost") - c("charge_kwh") * c("iex_price"))
    base = today.groupBy(key).agg(F.greatest(net, F.lit(0.0)).alias("saved_today_inr"))
    peak = schedule.filter(F.hour(ts).between(18, 21)).groupBy(key).agg(F.avg("block_mape").alias("peak_block_mape"))
    best = top_per_key(active_rows(schedule), [key], [F.desc("magnitude_kwh"), c(ts)], 3)
    lines = best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(sentence).alias("t")))), lambda x: x["t"]), " ").alias("highlights"))
    out = base.join(peak, key, "left").join(lines, key, "left")
    return out.withColumns({"projected_annual_inr": c("saved_today_inr") * 365.0, "mape_health": health(c("peak_block_mape"), 4.0, 8.0)})
