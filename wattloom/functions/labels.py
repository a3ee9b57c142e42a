"""Classification columns: tiers, cohorts, health, intermittency, battery actions, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def banded(value: Column, bands: list[tuple[float, str]], above: str) -> Column:
    """Label of the first band whose upper bound lies above the value."""
    out = None
    for upper, label in bands:
        out = F.when(value < upper, label) if out is None else out.when(value < upper, label)
    return out.otherwise(above)


def tier(mean_wh: Column) -> Column:
    return (
        F.when(mean_wh > 5000, "HT (>5kWh)").when(mean_wh > 1500, "Large (1.5-5k)")
        .when(mean_wh > 500, "Medium (0.5-1.5k)").otherwise("Small (<500)")
    )


def cohort(mape: Column) -> Column:
    return banded(mape, [(5.0, "A"), (15.0, "B"), (25.0, "C")], "D")


def cohort_band(mape: Column) -> Column:
    bands = banded(
        mape, [(4.0, "A: <4% (target)"), (5.0, "A': 4-5%"), (10.0, "B: 5-10%"), (15.0, "C: 10-15%"), (25.0, "D: 15-25%")], "E: >=25%"
    )
    bad = mape.isNull() | F.isnan(mape) | (F.abs(mape) == float("inf"))
    return F.when(bad, "X: invalid").otherwise(bands)


def health(mape: Column, green: float = 8.0, amber: float = 12.0) -> Column:
    return banded(mape, [(green, "green"), (amber, "amber")], "red")


def regime(zero_pct: Column) -> Column:
    return banded(zero_pct, [(5.0, "continuous"), (15.0, "sparse")], "intermittent")


def dispatch_action(charge_wh: Column, discharge_wh: Column, curtail_wh: Column, kva_shaved: Column, tolerance_wh: float = 1.0) -> Column:
    return (
        F.when(curtail_wh > tolerance_wh, "curtail_solar").when(charge_wh > tolerance_wh, "charge")
        .when((discharge_wh > tolerance_wh) & (kva_shaved > 0), "peak_shave").when(discharge_wh > tolerance_wh, "discharge")
        .otherwise("hold")
    )


# Names accepted for each forecast scenario.
SCENARIO_NAMES = {
    "pessimistic": ["pessimistic", "q10", "p10", "low"],
    "bau": ["bau", "mean", "p50", "median"],
    "optimistic": ["optimistic", "q90", "p90", "high"],
}


def resolve_scenario(name: str) -> str:
    for scenario, names in SCENARIO_NAMES.items():
        if name.strip().lower() in names:
            return scenario
    raise ValueError(f"unknown scenario: {name}")


def scenarios(df: DataFrame, ids: list[str], low: str = "q10_kwh", mid: str = "predicted_kwh", high: str = "q90_kwh") -> DataFrame:
    """One row per scenario and slot."""
    return (
        df.withColumnsRenamed({low: "pessimistic", mid: "bau", high: "optimistic"})
        .unpivot(ids, ["pessimistic", "bau", "optimistic"], "scenario", "energy_kwh")
    )


def clean_forecast(df: DataFrame, mid: str, low: str, high: str) -> DataFrame:
    """Non-finite values become 0, negatives are clipped and the band encloses the point forecast."""
    def positive(c: str) -> Column:
        v = F.col(c)
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return F.when(finite, F.greatest(v, F.lit(0.0))).otherwise(0.0)

    df = df.withColumns({c: positive(c) for c in (mid, low, high)})
    return df.withColumns({low: F.least(low, mid), high: F.greatest(high, mid)})
