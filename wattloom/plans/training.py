"""Training, model store, scoring from the store, manifest.

A store is a folder of immutable versions.  A version is a table with one row per meter: coefficients, kept features, target
scale, bias gate, holdout errors, block errors and residual band, and what failed where nothing could be fitted.  Scoring
reads that table; it never fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wattloom.functions import calendar as cal
from wattloom.functions.labels import clean_forecast
from wattloom.operators.accuracy import masked_mape, point_metrics
from wattloom.operators.frames import ordered
from wattloom.plans import models
from wattloom.plans.evaluation import bias_gate
from wattloom.session import cut_lineage

#: Share of readings under half a unit above which a meter is fitted on log(1 + y), in percent.
LOG_FROM_ZERO_PCT = 30.0
METRICS = ("mape", "mae", "mbe", "rmse", "r2", "within5", "within10", "coverage_80")


def fit(df: DataFrame, keys: list[str], features: list[str], y: str, **limits) -> DataFrame:
    """Coefficients of each key on its own scale of the target: log(1 + y) for meters that mostly stand still.

    Moments for both scales come from one aggregate, so the choice costs no second pass over the rows.
    """
    log_y, zeros = "_log_y", "_zeros"
    rows = df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).withColumns({log_y: F.log1p(F.greatest(F.col(y), F.lit(0.0))), zeros: (F.col(y) < 0.5).cast("double")})
    sums = models.moments(models.with_missing(rows, features), keys, features, y, log_y, zeros)
    k = len(features)
    at = lambda i, j: F.col("gram")[models.place(i, j, k + 4)]
    sums = sums.withColumns({"zero_pct": 100.0 * at(0, k + 3), "mean_demand": at(0, k + 1)})
    sums = sums.withColumn("use_log", F.col("zero_pct") > LOG_FROM_ZERO_PCT)
    chosen = F.transform(F.array(*[F.lit(i) for i in models.target_places(k, 3, 0)]), lambda i: F.col("gram")[i])
    logs = F.transform(F.array(*[F.lit(i) for i in models.target_places(k, 3, 1)]), lambda i: F.col("gram")[i])
    return models.solve_sums(sums.withColumn("gram", F.when(F.col("use_log"), logs).otherwise(chosen)), keys, features, keep_columns=["zero_pct", "mean_demand", "use_log"], centred=True, **limits)


def raw_score(df: DataFrame, fitted: DataFrame, keys: list[str], features: list[str], out: str = "predicted_kwh") -> DataFrame:
    """Prediction on the scale of the target, not below 0; the columns of ``fitted`` stay for later steps."""
    x = models.with_missing(df, features).join(fitted, keys, "left")
    terms = models.linear_terms(features)
    value = F.when(F.col("use_log"), F.expm1(terms)).otherwise(terms)
    return x.withColumn(out, F.when(F.col("coef").isNotNull(), F.greatest(value, F.lit(0.0)))).drop("coef")


def train(df: DataFrame, keys: list[str], features: list[str], y: str, cutoff: str, val_share: float = 0.15, gate: dict | None = None, ts: str = "ts", **limits) -> DataFrame:
    """One row per key for the store: fitted on the first part of the rows up to the cutoff, judged on the rest.

    Order of steps: screen and refit on one Gram matrix, bias gate on the held-out rows, residual band of the training rows,
    errors of the shifted forecast on the held-out rows, in all and by block of the day.
    """
    past = df.filter(F.col(ts) <= F.lit(cutoff).cast("timestamp"))
    n = F.count("*").over(Window.partitionBy(*keys))
    past = cut_lineage(past.withColumn("split", F.when(F.row_number().over(ordered(keys, ts)) > F.floor(n * (1.0 - val_share)), "test").otherwise("train")), "training")
    fitted = cut_lineage(fit(past.filter("split = 'train'"), keys, features, y, **limits), "coefficients")
    scored = cut_lineage(raw_score(past, fitted.select(*keys, "coef", "use_log"), keys, features).filter("predicted_kwh is not null"), "training-scored")
    gates = bias_gate(scored, keys, y, "predicted_kwh", val_share=val_share, ts=ts, **(gate or {})).select(*keys, "bias_gate", "trail_mbe_raw", "trail_mbe_capped")
    shifted = cut_lineage(scored.join(gates, keys).withColumn("predicted_kwh", F.greatest(F.col("predicted_kwh") - F.col("trail_mbe_capped"), F.lit(0.0))), "training-shifted")
    spread = F.percentile(F.col(y) - F.col("predicted_kwh"), F.array(F.lit(0.1), F.lit(0.9)))
    bands = shifted.filter("split = 'train'").groupBy(*keys).agg(spread.alias("residuals"))
    held = shifted.filter("split = 'test'").join(bands, keys)
    held = clean_forecast(held.withColumns({"q10_kwh": F.col("predicted_kwh") + F.col("residuals")[0], "q90_kwh": F.col("predicted_kwh") + F.col("residuals")[1]}), "predicted_kwh", "q10_kwh", "q90_kwh")
    errors = point_metrics(held, keys, y, "predicted_kwh", "q10_kwh", "q90_kwh").select(*keys, F.struct(*METRICS).alias("holdout"))
    block = held.groupBy(*keys, cal.day_block(F.hour(ts)).alias("_b")).agg(masked_mape(y, "predicted_kwh", 0.5).alias("_m"))
    blocks = block.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_m"))).alias("historical_block_mape"))
    span = past.groupBy(*keys).agg(F.min(ts).alias("train_start"), F.max(ts).alias("train_end"))
    out = fitted.join(gates, keys, "left").join(bands, keys, "left").join(errors, keys, "left").join(blocks, keys, "left").join(span, keys, "left")
    return out.withColumns({"train_cutoff": F.lit(cutoff).cast("timestamp"), "n_features_initial": F.lit(len(features)), "n_features_selected": F.size("features")})


def save(trained: DataFrame, folder: str, version: int) -> None:
    """Write one version; versions are not changed afterwards.  Files of a failed attempt are replaced."""
    spark, path = trained.sparkSession, f"{folder}/version={int(version)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise ValueError(f"version {version} is already in the store")
    trained.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, folder: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The models to score with: of each key the newest version, up to ``version`` if given, in which it could be fitted."""
    stored = spark.read.parquet(folder).filter("coef is not null")
    if version is not None:
        stored = stored.filter(F.col("version") <= version)
    rest = [c for c in stored.columns if c not in keys]
    newest = stored.groupBy(*keys).agg(F.max("version").alias("version"))
    return stored.join(newest, [*keys, "version"], "left_semi").select(*keys, *rest)


def predict(df: DataFrame, stored: DataFrame, keys: list[str], features: list[str], ts: str = "ts") -> DataFrame:
    """Forecast, band, block label and the block's holdout error from stored models; keys without a model get nulls."""
    kept = stored.select(*keys, "version", "coef", "use_log", "trail_mbe_capped", "residuals", "historical_block_mape")
    out = raw_score(df, kept, keys, features)
    out = out.withColumn("predicted_kwh", F.greatest(F.col("predicted_kwh") - F.col("trail_mbe_capped"), F.lit(0.0)))
    out = out.withColumn("predicted_kwh", F.when(F.col("version").isNotNull(), F.col("predicted_kwh")))
    low, high = (F.greatest(F.col("predicted_kwh") + F.col("residuals")[i], F.lit(0.0)) for i in (0, 1))
    out = out.withColumns({
        "q10_kwh": F.when(F.col("version").isNotNull(), F.least(low, F.col("predicted_kwh"))),
        "q90_kwh": F.when(F.col("version").isNotNull(), F.greatest(high, F.col("predicted_kwh"))),
        "block_label": cal.day_block(F.hour(ts)),
    })
    return out.withColumn("historical_block_mape", F.col("historical_block_mape")[F.col("block_label")]).drop("residuals", "use_log", "trail_mbe_capped")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored model and version, without its coefficients; models that failed keep their error."""
    holdout = [F.col(f"holdout.{m}").alias(m if m.startswith("coverage") else f"holdout_{m}") for m in METRICS]
    df = spark.read.parquet(folder)
    return df.select("*", *holdout).drop("holdout", "coef", "residuals", "mean_demand", "use_log", "n_train").withColumn("path", F.concat(F.lit(f"{folder}/version="), F.col("version").cast("string")))


def save_pipeline(pipeline, folder: str, name: str, version: int) -> str:
    """Store a fitted pipeline beside the tables; returns its path."""
    path = f"{folder}-pipelines/{name}/version={int(version)}"
    pipeline.write().overwrite().save(path)
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
