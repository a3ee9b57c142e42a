"""Quantile heads: linear quantile regressions of all meters at once.

The pinball loss is lowered by rounds of weighted least squares: with weights 1 / (distance + eps) a quadratic touches the
loss from above, and its minimum solves X'WX b = X'Wy + (2q - 1) X'1 (Hunter and Lange's majorisation).  A round is one
map-combined aggregate of Gram sums over the rows and one small solve per meter and quantile; rows never move to a model.
Rounds start from a line through the middle and one through the size of the errors.
For given slopes the best intercept is the exact quantile of what they leave, which ends the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wattloom.operators.quantiles import exact_quantiles
from wattloom.plans import models
from wattloom.session import cut_lineage

#: Distance, as a share of the mean error, under which a row weighs no more than one at it.
EPS = 1e-3


def name(q: float) -> str:
    return f"q{round(q * 100)}"


def _line(coef: str, features: list[str]) -> Column:
    out = F.get(coef, F.lit(0))
    for i, f in enumerate(features, 1):
        out = out + F.get(coef, F.lit(i)) * F.col(f)
    return out


def fit_heads(df: DataFrame, keys: list[str], features: list[str], y: str, quantiles: tuple[float, ...] = (0.1, 0.9), rounds: int = 6, ridge: float = 1e-6) -> DataFrame:
    """(keys, q10, q90, ...): coefficients, intercept first, of each quantile; keys whose sums cannot be solved have none.

    Features are scaled by their deviation in the key before they are summed, so the ridge means the same for all.
    """
    k = len(features)
    rows = models.with_missing(df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))), features)
    scales = rows.groupBy(*keys).agg(F.array(*[F.avg(f) for f in features]).alias("_m"), F.array(*[F.greatest(F.stddev_pop(f), F.lit(1e-9)) for f in features]).alias("_s"))
    scaled = rows.join(scales, keys).select(*keys, F.col(y).cast("double").alias("_y"), *[((F.col(f) - F.col("_m")[i]) / F.col("_s")[i]).alias(f"_x{i}") for i, f in enumerate(features)])
    scaled, scales = cut_lineage(scaled, "head-rows"), cut_lineage(scales, "head-scales")
    x = [f"_x{i}" for i in range(k)]

    def solved(now: DataFrame, what: dict[str, tuple[Column, Column, float]]) -> DataFrame:
        """Weighted least squares of each name's (weight, target, quantile), by key."""
        sums = []
        for n, (weight, target, _) in what.items():
            cols = [F.lit(1.0), *[F.col(c) for c in x], target]
            sums.append(F.array(*[F.sum(weight * cols[i] * cols[j]) for i in range(k + 2) for j in range(i, k + 2)]).alias(n))
        ones = F.array(F.sum(F.lit(1.0)), *[F.sum(c) for c in x]).alias("_ones")
        return cut_lineage(_solve(now.groupBy(*keys).agg(*sums, ones), keys, {n: q for n, (_, _, q) in what.items()}, k, ridge), "heads")

    one, y_ = F.lit(1.0), F.col("_y")
    middle = solved(scaled, {"_mid": (one, y_, 0.5)})
    spread = solved(scaled.join(middle, keys), {"_far": (one, F.abs(y_ - _line("_mid", x)), 0.5)})
    # where errors are normal and their size is linear, this start is the answer
    start = middle.join(spread, keys)
    fitted = cut_lineage(start.select(*keys, F.get("_far", F.lit(0)).alias("_w"), *[_beside(q).alias(name(q)) for q in quantiles]), "heads")
    sizes = fitted.select(*keys, F.greatest("_w", F.lit(1e-9)).alias("_w"))
    fitted, scaled = fitted.drop("_w"), cut_lineage(scaled.join(sizes, keys), "head-rows")
    for _ in range(rounds):
        fitted = solved(scaled.join(fitted, keys), {name(q): (1.0 / (F.abs(y_ - _line(name(q), x)) + F.col("_w") * EPS), y_, q) for q in quantiles})
    left = scaled.join(fitted, keys)
    for q in quantiles:  # the best intercept for these slopes
        shift = exact_quantiles(left.withColumn("_r", F.col("_y") - _line(name(q), x)), keys, "_r", {"_d": q})
        fitted = fitted.join(shift, keys).withColumn(name(q), F.concat(F.array(F.get(name(q), F.lit(0)) + F.col("_d")), F.slice(name(q), 2, k))).drop("_d")
    out = fitted.join(scales, keys)
    for q in quantiles:
        slopes = F.zip_with(F.slice(name(q), 2, k), F.col("_s"), lambda b, s: b / s)
        base = F.get(name(q), F.lit(0)) - F.aggregate(F.zip_with(slopes, F.col("_m"), lambda b, m: b * m), F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn(name(q), F.concat(F.array(base), slopes))
    return out.select(*keys, *[name(q) for q in quantiles])


def _beside(q: float) -> Column:
    """The middle line moved by the quantile of a normal error whose mean size is the other line."""
    z = NormalDist().inv_cdf(q) * (np.pi / 2) ** 0.5
    return F.zip_with("_mid", "_far", lambda m, f: m + z * f)


def _solve(sums: DataFrame, keys: list[str], what: dict[str, float], k: int, ridge: float) -> DataFrame:
    schema = T.StructType([sums.schema[c] for c in keys] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in what])
    upper = np.triu_indices(k + 2)

    def one(gram, ones, q: float) -> list[float]:
        full = np.zeros((k + 2, k + 2))
        full[upper] = gram
        full = full + np.triu(full, 1).T
        a = full[:-1, :-1] + ridge * full[0, 0] * np.diag([0.0] + [1.0] * k)
        return np.linalg.solve(a, full[:-1, -1] + (2.0 * q - 1.0) * np.asarray(ones, dtype=float)).tolist()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            for n, q in what.items():
                out[n] = [one(g, o, q) for g, o in zip(pdf[n], pdf["_ones"])]
            yield out

    return sums.mapInPandas(solve, schema)


def add_heads(df: DataFrame, heads: DataFrame, keys: list[str], features: list[str], quantiles: tuple[float, ...] = (0.1, 0.9)) -> DataFrame:
    """Quantile forecasts ``q10_kwh``, ...; not below 0 and in order."""
    x = models.with_missing(df, features).join(heads, keys, "left")
    values = [F.greatest(_line(name(q), features), F.lit(0.0)) for q in sorted(quantiles)]
    ordered = F.array_sort(F.array(*values))
    known = F.col(name(quantiles[0])).isNotNull()
    return x.withColumns({f"{name(q)}_kwh": F.when(known, ordered[i]) for i, q in enumerate(sorted(quantiles))}).drop(*[name(q) for q in quantiles])


def group_bands(df: DataFrame, groups: list[str], y: str, p: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Residual band of each group, such as tier and block of the day; groups may hold any share of the rows."""
    return exact_quantiles(df.withColumn("_r", F.col(y) - F.col(p)), groups, "_r", {"low_kwh": low, "high_kwh": high})
