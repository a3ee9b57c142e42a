"""Audit sentences and their check."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The sentence format and the words used in it.
AUDIT_PATTERN = r"^\[\d{2}:\d{2}\] (charge|discharge|hold|curtail solar|peak shave) \d+(\.\d+)? kWh because .+ \(confidence \d{1,3}%\)\.$"
RUPEE = "₹"
REASONS = {
    "cheap": "IEX price {price}/kWh is {gap} below landed grid tariff",
    "position": "pre-positioning SOC ahead of peak (IEX {price}/kWh)",
    "dear": "IEX price {price}/kWh is {gap} above landed cost — arbitrage window",
    "peak": "discharging into peak demand (IEX {price}/kWh)",
    "shave": "shaving {kva} kVA peak ({saving}/yr at {rate}/kVA)",
    "curtail": "curtailing solar — grid import cheaper this block",
    "unsure": "holding SOC — block MAPE {mape}% above {limit}% aggression threshold",
    "idle": "holding SOC — no commercial edge in this block",
}


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template with columns in place of its ``{names}``."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def money(value: Column, decimals: int = 2) -> Column:
    return F.concat(F.lit(RUPEE), F.format_number(value, decimals))


def price(value: Column) -> Column:
    return F.concat(F.lit(RUPEE), F.format_string("%.2f", value))


def confidence(mape: Column) -> Column:
    """Integer confidence from an error in percent, half-even rounding."""
    return F.least(F.greatest(F.bround(100.0 - mape, 0), F.lit(0.0)), F.lit(100.0)).cast("int")


def audit_sentence(ts: Column, action: Column, kwh: Column, iex: Column, landed: Column, mape: Column, kva: Column, rate: float = 400.0, limit: float = 15.0) -> Column:
    gap = landed - iex
    values = {
        "price": price(iex), "gap": price(F.abs(gap)), "kva": F.format_string("%.0f", kva), "saving": money(kva * rate * 12.0, 0),
        "rate": price(F.lit(rate)), "mape": F.format_string("%.1f", mape), "limit": F.lit(f"{limit:.0f}"),
    }
    say = {k: fill(v, **values) for k, v in REASONS.items()}
    reason = (
        F.when(action == "charge", F.when(gap > 0, say["cheap"]).otherwise(say["position"]))
        .when(action == "discharge", F.when(gap < 0, say["dear"]).otherwise(say["peak"]))
        .when(action == "peak_shave", say["shave"]).when(action == "curtail_solar", say["curtail"])
        .otherwise(F.when(mape > limit, say["unsure"]).otherwise(say["idle"]))
    )
    kwh = F.when(kwh.isNull() | (kwh < 0), F.raise_error(F.lit("kWh must be given and not negative")).cast("double")).otherwise(kwh)
    amount = F.when(kwh == F.floor(kwh), F.floor(kwh).cast("string")).otherwise(F.format_string("%.1f", kwh))
    return F.concat(
        F.lit("["), F.date_format(ts, "HH:mm"), F.lit("] "), F.replace(action, F.lit("_"), F.lit(" ")), F.lit(" "), amount,
        F.lit(" kWh because "), reason, F.lit(" (confidence "), confidence(mape).cast("string"), F.lit("%)."),
    )


def is_audit_sentence(text: Column) -> Column:
    return text.rlike(AUDIT_PATTERN)
