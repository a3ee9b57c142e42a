"""Per-meter ridge models from distributed Gram sums, pooled trees, bands, recursive forecasts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wattloom.functions import calendar as cal
from wattloom.functions.labels import clean_forecast
from wattloom.operators.accuracy import point_metrics

ID_COLUMNS = {"ts", "demand_kwh", "demand_wh", "target", "meter_id", "msn", "phase", "voltage", "tier", "date", "fleet_mean", "fleet_std", "split", "fold", "origin", "tag", "n_events"}


def numeric_features(df: DataFrame, exclude: set[str] = ID_COLUMNS) -> list[str]:
    """Numeric columns that are no id, target or audit column, from the schema alone."""
    kinds = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def with_missing(df: DataFrame, features: list[str], value: float | None = 0.0) -> DataFrame:
    """Add absent features and zero nulls, so that scoring sees the trained columns in order."""
    def one(f: str) -> Column:
        return F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(value)) if f in df.columns else F.lit(value).cast("double")

    return df.withColumns({f: one(f) for f in features})


def place(i: int, j: int, size: int) -> int:
    """Place of the product of columns i <= j in a flat Gram array of ``size`` columns, row by row."""
    return i * size - i * (i - 1) // 2 + j - i


def target_places(k: int, targets: int, which: int) -> list[int]:
    """Places of the Gram array of one target in that of several, all behind the same k features."""
    size, used = k + 1 + targets, [*range(k + 1), k + 1 + which]
    return [place(used[i], used[j], size) for i in range(k + 2) for j in range(i, k + 2)]


def gram_sums(df: DataFrame, keys: list[str], features: list[str], *targets: str) -> DataFrame:
    """Row count, sums and cross products per key as one flat array; combined on the map side, safe for hot keys."""
    cols = [F.lit(1.0)] + [F.col(f).cast("double") for f in (*features, *targets)]
    pairs = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*keys).agg(*[p.alias(f"_g{i}") for i, p in enumerate(pairs)]).select(*keys, F.array(*[f"_g{i}" for i in range(len(pairs))]).alias("gram"))


def moments(df: DataFrame, keys: list[str], features: list[str], *targets: str) -> DataFrame:
    """Row count, means and covariances per key in the places of ``gram_sums``; sums around running means, so that no digits are lost where values vary little."""
    cols = [F.col(f).cast("double") for f in (*features, *targets)]
    parts = [F.count("*").cast("double"), *[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]]
    return df.groupBy(*keys).agg(*[p.alias(f"_g{i}") for i, p in enumerate(parts)]).select(*keys, F.array(*[f"_g{i}" for i in range(len(parts))]).alias("gram"))


LEVEL = 1e-6  # gains that differ by less are told apart by rounding only


def select_and_solve(a: np.ndarray, r: np.ndarray, usable: np.ndarray, keep: int, floor: float) -> tuple[list[int], np.ndarray]:
    """Forward selection and its solution in one elimination.

    ``a`` and ``r`` are the (ridged) correlations of the features and those with the target.  Eliminating a feature leaves the
    partial covariances of the others, so the next one is that which takes most from the residual, and the column of the
    target holds the coefficients of all chosen ones.  Ends after ``keep`` features or when the best takes no more than ``floor``.
    Features within a millionth of the best are level (as multiples of one another are), and the first of them is taken.
    """
    m, chosen, free, at = np.column_stack([a, r]), [], usable.copy(), np.arange(len(r))
    while len(chosen) < keep and free.any():
        left = m[at, at]
        fresh = free & (left > 1e-10)  # what the chosen ones already explain in full adds nothing
        gain = np.where(fresh, m[:, -1] ** 2 / np.where(fresh, left, 1.0), -1.0)
        if gain.max() <= floor:
            break
        j = int(np.argmax(gain >= gain.max() * (1.0 - LEVEL)))
        row = m[j] / m[j, j]
        m = m - np.outer(m[:, j], row)
        m[j] = row
        chosen.append(j)
        free[j] = False
    beta = np.zeros(len(r))
    beta[chosen] = m[chosen, -1]
    return chosen, beta


def solve_ridge(gram: np.ndarray, k: int, ridge: float, keep: int, min_rows: int, centred: bool = False) -> tuple[list | None, list | None, int, str | None]:
    """Standardised ridge from a flat Gram array (of ``moments`` if centred): screen the features by forward selection, then refit the kept ones."""
    full = np.zeros((k + 2, k + 2))
    full[np.triu_indices(k + 2)] = gram
    full = full + np.triu(full, 1).T
    n = int(full[0, 0])
    if n < min_rows:
        return None, None, n, f"train too short ({n})"
    mean = full[0, 1:] if centred else full[0, 1:] / n
    cov = full[1:, 1:] if centred else full[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    usable = sd[:k] > 1e-9
    if sd[k] <= 1e-9 or not usable.any():
        return [float(mean[k])] + [0.0] * k, [], n, None
    scale = np.where(usable, sd[:k], 1.0)
    a = np.where(np.outer(usable, usable), cov[:k, :k], 0.0) / np.outer(scale, scale)
    a[np.diag_indices(k)] = np.where(usable, a[np.diag_indices(k)] + ridge, 1.0)
    kept, beta = select_and_solve(a, np.where(usable, cov[:k, k], 0.0) / scale, usable, keep, 1e-12 * cov[k, k])
    coef = np.concatenate([[0.0], beta / scale])
    coef[0] = mean[k] - coef[1:] @ mean[:k]
    return coef.tolist(), kept, n, None


def solve_sums(sums: DataFrame, keys: list[str], features: list[str], ridge: float = 0.01, keep_share: float = 0.55, keep_min: int = 6, min_rows: int = 30, keep_columns: list[str] = [], centred: bool = False) -> DataFrame:  # noqa: B006
    """One model row per row of Gram arrays: coefficients (intercept first), kept features in the order chosen, rows and error.

    Python sees one small array per key, many keys per batch.  A key that cannot be fitted carries its error and does not
    stop the others.
    """
    k = len(features)
    keep = max(keep_min, int(k * keep_share))
    kept = [*keys, *keep_columns]
    schema = T.StructType([sums.schema[c] for c in kept] + [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("n_train", T.LongType()), T.StructField("error", T.StringType())])

    def one(g) -> tuple[list | None, list | None, int, str | None]:
        try:
            return solve_ridge(np.asarray(g, dtype=float), k, ridge, keep, min_rows, centred)
        except (np.linalg.LinAlgError, ValueError) as failed:
            return None, None, int(g[0]), str(failed)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(g) for g in pdf["gram"]]
            out = pdf[kept].copy()
            out["coef"] = [r[0] for r in rows]
            out["features"] = [None if r[1] is None else [features[i] for i in r[1]] for r in rows]
            out["n_train"] = [r[2] for r in rows]
            out["error"] = [r[3] for r in rows]
            yield out

    return sums.select(*kept, "gram").mapInPandas(solve, schema)


def fit_ridge(df: DataFrame, keys: list[str], features: list[str], target: str, **limits) -> DataFrame:
    """One model row per key; rows never leave the aggregate.  See ``solve_sums`` for the limits."""
    df = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    return solve_sums(moments(with_missing(df, features), keys, features, target), keys, features, centred=True, **limits)


def linear_terms(features: list[str]) -> Column:
    terms = F.get("coef", F.lit(0))
    for i, f in enumerate(features, 1):
        terms = terms + F.get("coef", F.lit(i)) * F.col(f)
    return terms


def score(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], out: str = "predicted_kwh") -> DataFrame:
    """Linear score in the JVM, clipped at 0; keys without a model get null."""
    x = with_missing(df, features)
    terms = linear_terms(features)
    scored = x.join(models.select(*keys, "coef"), keys, "left").withColumn(out, F.when(F.col("coef").isNotNull(), F.greatest(terms, F.lit(0.0))))
    return scored.drop("coef")


def residual_band(df: DataFrame, train: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Band from the 10 and 90 percent quantiles of training residuals per key; a key holds one row per slot."""
    q = F.percentile(F.col(y) - F.col(p), F.array(F.lit(0.1), F.lit(0.9)))
    bands = train.groupBy(*keys).agg(q.alias("_q"))
    out = df.join(bands, keys, "left").withColumns({"q10_kwh": F.col(p) + F.coalesce(F.col("_q")[0], F.lit(0.0)), "q90_kwh": F.col(p) + F.coalesce(F.col("_q")[1], F.lit(0.0))}).drop("_q")
    return clean_forecast(out, p, "q10_kwh", "q90_kwh")


def train_and_score(df: DataFrame, keys: list[str], features: list[str], target: str, split: str = "split", **fit) -> tuple[DataFrame, DataFrame]:
    """Fit on the train rows of each key and score all rows."""
    models = fit_ridge(df.filter(F.col(split) == "train"), keys, features, target, **fit)
    return models, score(df, models, keys, features)


def fit_trees(df: DataFrame, features: list[str], target: str, rounds: int = 5, depth: int = 4, seed: int = 42):
    """One gradient-boosted model over all meters; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=features, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="tree_kwh", maxIter=rounds, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(with_missing(df, features).filter(F.col(target).isNotNull()).select(*features, target))


def tree_gains(model, features: list[str], spark) -> DataFrame:
    """Gain per feature of a fitted tree pipeline."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, gains)), "feature string, gain double")


# Tree parameters before any rule, and what tiers, few samples and variants change, in this order.
PARAMS = {"num_leaves": 31, "min_rows": 50, "feature_share": 0.7, "row_share": 0.8, "learning_rate": 0.03, "max_depth": 8, "l1": 0.1, "l2": 1.0}
PARAM_RULES = [
    ("tier", "HT", {"num_leaves": ("set", 63), "min_rows": ("set", 20), "feature_share": ("set", 0.8), "learning_rate": ("set", 0.035)}),
    ("tier", "Small", {"num_leaves": ("set", 15), "min_rows": ("set", 80), "feature_share": ("set", 0.5), "max_depth": ("set", 6), "l1": ("set", 0.5), "l2": ("set", 5.0)}),
    ("samples_below", 3000, {"num_leaves": ("at_most", 15), "min_rows": ("at_least", 100)}),
    ("variant", "conservative", {"learning_rate": ("set", 0.02), "num_leaves": ("times", 0.5, "at_least", 15), "min_rows": ("times", 2), "l2": ("times", 3.0)}),
    ("variant", "aggressive", {"learning_rate": ("set", 0.05), "num_leaves": ("times", 2, "at_most", 127), "min_rows": ("times", 0.5, "at_least", 10), "feature_share": ("plus", 0.1, "at_most", 0.9)}),
    ("variant", "deep", {"max_depth": ("set", 12), "num_leaves": ("plus", 32, "at_most", 127), "min_rows": ("plus", -10, "at_least", 20)}),
    ("variant", "wide", {"feature_share": ("plus", 0.2, "at_most", 0.95), "row_share": ("plus", 0.1, "at_most", 0.95)}),
    ("variant", "regularized", {"l1": ("times", 5.0), "l2": ("times", 3.0), "feature_share": ("plus", -0.15, "at_least", 0.4)}),
]
VARIANTS = ["base", *(value for kind, value, _ in PARAM_RULES if kind == "variant")]


def tier_params(df: DataFrame, tier: str = "tier", n: str = "n_samples", variant: str = "variant") -> DataFrame:
    """Training parameters of each row: the rules that its tier, sample count and variant meet, folded over the defaults."""
    applies = {"tier": lambda v: F.col(tier).startswith(v), "samples_below": lambda v: F.col(n) < v, "variant": lambda v: F.col(variant) == v}
    change = {"set": lambda x, v: F.lit(v), "times": lambda x, v: x * v, "plus": lambda x, v: x + v, "at_least": lambda x, v: F.greatest(x, F.lit(v)), "at_most": lambda x, v: F.least(x, F.lit(v))}
    out = {}
    for name, default in PARAMS.items():
        value = F.lit(default)
        for kind, match, changes in PARAM_RULES:
            steps, new = changes.get(name, ()), value
            for op, by in zip(steps[::2], steps[1::2], strict=True):
                new = change[op](new, by)
                new = F.floor(new) if isinstance(default, int) else new
            value = F.when(applies[kind](match), new).otherwise(value) if steps else value
        out[name] = value
    return df.withColumns(out)


STEP_LAGS = (1, 24, 168)
STEP_FEATURES = [f"lag_{n}" for n in STEP_LAGS] + ["rmean_24", "hour_sin", "hour_cos", "is_weekend"]


def step_features(df: DataFrame, keys: list[str], value: str = "demand_kwh", ts: str = "ts") -> DataFrame:
    """Features that a step-by-step forecast can rebuild from its own past."""
    w = Window.partitionBy(*keys).orderBy(ts)
    sin, cos = cal.cycle(F.hour(ts), 24.0)
    return df.withColumns({**{f"lag_{n}": F.lag(value, n).over(w) for n in STEP_LAGS}, "rmean_24": F.avg(value).over(w.rowsBetween(-24, -1)), "hour_sin": sin, "hour_cos": cos, "is_weekend": (F.weekday(ts) >= 5).cast("int")})


def roll_forward(tail: np.ndarray, coef: np.ndarray, start_hour: np.ndarray, start_dow: np.ndarray, steps: int) -> np.ndarray:
    """Predict step by step for many meters at once, feeding predictions back."""
    n, width = tail.shape
    path = np.concatenate([tail, np.zeros((n, steps))], axis=1)
    for s in range(steps):
        at = width + s
        hour = (start_hour + s) % 24
        weekend = ((start_dow + (start_hour + s) // 24) % 7 >= 5).astype(float)
        angle = hour * 2.0 * math.pi / 24.0
        x = np.stack([np.ones(n), *[path[:, at - lag] for lag in STEP_LAGS], path[:, at - 24:at].mean(axis=1), np.sin(angle), np.cos(angle), weekend], axis=1)
        path[:, at] = np.maximum((x * coef).sum(axis=1), 0.0)
    return path[:, width:]


def recursive_forecast(df: DataFrame, models: DataFrame, keys: list[str], steps: int = 168, value: str = "demand_kwh", ts: str = "ts") -> DataFrame:
    """Hourly recursive forecast after the last row of each key.

    Each key ships its last 168 values as one array; a Python batch rolls all of its meters forward together.
    """
    need = max(STEP_LAGS)
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    tail = df.select(*keys, ts, value).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need)
    tail = tail.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))), lambda s: s["v"]).alias("tail"), F.max(ts).alias("_end"))
    ready = tail.filter(F.size("tail") == need).join(models.filter("coef is not null").select(*keys, "coef"), keys)
    first = F.timestamp_micros(F.unix_micros("_end") + 3_600_000_000)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(values: pd.Series, coef: pd.Series, hour: pd.Series, dow: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(roll_forward(np.stack(values.to_list()), np.stack(coef.to_list()), hour.to_numpy(), dow.to_numpy(), steps)))

    out = ready.select(*keys, "_end", roll("tail", "coef", F.hour(first), F.weekday(first)).alias("_p"))
    out = out.select(*keys, "_end", F.posexplode("_p").alias("step", "predicted_kwh"))
    return out.select(*keys, F.timestamp_micros(F.unix_micros("_end") + (F.col("step") + 1) * 3_600_000_000).alias(ts), (F.col("step") + 1).alias("step"), "predicted_kwh")
