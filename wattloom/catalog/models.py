"""Fits, model forecasts and backtests."""

from pyspark.sql import Window, functions as F

from wattloom.catalog import model_sql as ms
from wattloom.catalog.aggregates import IDS, STARTS
from wattloom.catalog.joins import PROFILE_SQL
from wattloom.catalog.registry import query
from wattloom.catalog.views import located, weather_at
from wattloom.functions import calendar as cal, weather as wf
from wattloom.operators import accuracy, ranking
from wattloom.operators.frames import fill_both
from wattloom.operators.joins import weekly_lookback
from wattloom.plans import backtests, features as feat, forecasts, heads, models, splits, training
from wattloom.session import cut_lineage, scratch_path
from wattloom.sources import writers

KEY = ["meter_id"]
Y = "demand_kwh"
FEATURES = [*models.STEP_FEATURES, "lag_2", "lag_48", "temperature", "cooling_deg"]


def filled(t):
    """Hourly sites with gaps filled, one row per meter and hour."""
    return t.grid.withColumn(Y, fill_both(Y, KEY))


CUTOFF = "2024-01-24 00:00:00"
GATE = {"min_rows": 12, "min_scored": 10}
KEEP = 6
FIT = ms.training_ctes(FEATURES, KEEP, CUTOFF, 12, 10)
FIT_LEVEL = ms.training_ctes(FEATURES, KEEP, CUTOFF, 12, 10, level=True)
NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
BLOCK_SQL = "CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'night' WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 18 THEN 'solar' ELSE 'peak' END"


def table(t):
    """Training table of all meters, each with the weather of its own location; the longest lag must exist."""
    df = models.step_features(filled(t), KEY)
    df = located(feat.add_lags(df, KEY, Y, {2: "lag_2", 48: "lag_48"})).join(t.weather.select("location_id", "ts", "temperature"), ["location_id", "ts"], "left")
    return df.withColumn("cooling_deg", wf.above(F.col("temperature"), 25.0)).filter("lag_168 is not null")


def store(t):
    """Train all meters up to the cutoff and store the models; returns the store and the table."""
    df, folder = cut_lineage(table(t), "train-table"), scratch_path(t.spark, "model-store")
    training.save(training.train(df, KEY, FEATURES, Y, CUTOFF, gate=GATE, keep_share=0.55, keep_min=KEEP), folder, 1)
    return folder, df


@query("prj_numeric_features", "position:i feature:s", "SELECT unnest(range(1, 12)) AS position, unnest(['lag_1', 'lag_24', 'lag_168', 'rmean_24', 'hour_sin', 'hour_cos', 'is_weekend', 'lag_2', 'lag_48', 'temperature', 'cooling_deg']) AS feature FROM (SELECT count(*) AS n FROM sites) WHERE n > 0")
def _(t):
    df = table(t)
    names = models.numeric_features(df)
    seen = df.agg(*[F.count(n).alias(n) for n in names])
    return seen.unpivot([], names, "feature", "n").withColumn("position", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")))


@query("fit_meter_model", "meter_id:s n_train:i n_features:i features:s intercept:4 zero_pct:4 bias_gate:s trail_mbe_raw:3 trail_mbe_capped:3 mape:2 mae:3 mbe:3 rmse:3 r2:4 within5:2 within10:2 coverage_80:2", f"""WITH RECURSIVE {FIT_LEVEL}
    SELECT meter_id, n_train, len(kept) AS n_features, array_to_string(list_transform(kept, lambda i: {NAMES}[i]), ',') AS features, coef[1] AS intercept, zero_pct, bias_gate, trail_mbe_raw, trail_mbe_capped, e.* EXCLUDE (meter_id)
    FROM fit JOIN gate USING (meter_id) JOIN errors e USING (meter_id) JOIN zeros USING (meter_id)""")
def _(t):
    folder, _ = store(t)
    stored = training.load(t.spark, folder, KEY)
    return stored.select("*", F.col("n_features_selected").alias("n_features"), F.array_join("features", ",").alias("kept"), F.col("coef")[0].alias("intercept"), "holdout.*").drop("features").withColumnRenamed("kept", "features")


@query("fit_fleet", "status:s n_meters:i mean_rows:2 mean_mape:2", f"""WITH RECURSIVE {FIT}
    SELECT CASE WHEN coef IS NULL THEN 'failed' ELSE 'fitted' END AS status, count(*) AS n_meters, avg(n_train) AS mean_rows, avg(mape) AS mean_mape FROM zeros LEFT JOIN fit USING (meter_id) LEFT JOIN errors USING (meter_id) GROUP BY 1""")
def _(t):
    """All meters; one with too short a history fails by its own data, and the summary keeps both outcomes."""
    folder, _ = store(t)
    m = t.spark.read.parquet(folder)
    return m.groupBy(F.when(F.col("error").isNull(), "fitted").otherwise("failed").alias("status")).agg(F.count("*").alias("n_meters"), F.avg("n_train").alias("mean_rows"), F.avg("holdout.mape").alias("mean_mape"))


MANIFEST = "meter_id string, version int, train_cutoff timestamp, train_start timestamp, train_end timestamp, zero_pct double, " + ", ".join(f"holdout_{m} double" for m in training.METRICS[:-1]) + ", coverage_80 double, bias_gate string, trail_mbe_raw double, trail_mbe_capped double, n_features_initial int, n_features_selected int, historical_block_mape map<string, double>, error string"


@query("snk_manifest", "meter_id:s version:i train_cutoff:t train_start:t train_end:t zero_pct:4 holdout_mape:2 holdout_mae:3 holdout_mbe:3 holdout_rmse:3 holdout_r2:4 holdout_within5:2 holdout_within10:2 coverage_80:2 bias_gate:s trail_mbe_raw:3 trail_mbe_capped:3 n_features_initial:i n_features_selected:i night_mape:2 peak_mape:2 error:s", f"""WITH RECURSIVE {FIT},
    blocks AS (SELECT meter_id, avg(abs(demand_kwh - predicted_kwh) / demand_kwh * 100.0) FILTER ({BLOCK_SQL} = 'night') AS night_mape, avg(abs(demand_kwh - predicted_kwh) / demand_kwh * 100.0) FILTER ({BLOCK_SQL} = 'peak') AS peak_mape FROM held WHERE demand_kwh > 0.5 GROUP BY 1)
    SELECT z.meter_id, 1 AS version, TIMESTAMP '{CUTOFF}' AS train_cutoff, train_start, train_end, zero_pct, mape AS holdout_mape, mae AS holdout_mae, mbe AS holdout_mbe, rmse AS holdout_rmse, r2 AS holdout_r2, within5 AS holdout_within5, within10 AS holdout_within10, coverage_80,
    bias_gate, trail_mbe_raw, trail_mbe_capped, {len(FEATURES)} AS n_features_initial, len(kept) AS n_features_selected, night_mape, peak_mape, CASE WHEN n_train < 30 THEN 'train too short (' || n_train || ')' END AS error
    FROM zeros z JOIN span USING (meter_id) LEFT JOIN fit USING (meter_id) LEFT JOIN gate USING (meter_id) LEFT JOIN errors USING (meter_id) LEFT JOIN blocks USING (meter_id)""")
def _(t):
    """Manifest of the stored models, written as JSON rows and read back."""
    folder, _ = store(t)
    path = scratch_path(t.spark, "manifest")
    writers.write_manifest(training.manifest(t.spark, folder), path, [c.split()[0] for c in MANIFEST.replace("map<string, double>", "map").split(", ")])
    back = t.spark.read.schema(MANIFEST).json(path)
    return back.withColumns({f"{b}_mape": F.col("historical_block_mape")[b] for b in ("night", "peak")})


@query("fit_feature_screen", "meter_id:s position:i feature:s", f"WITH RECURSIVE {FIT_LEVEL} SELECT meter_id, unnest(range(1, len(kept) + 1)) AS position, unnest(list_transform(kept, lambda i: {NAMES}[i])) AS feature FROM fit")
def _(t):
    """What the screen of each stored model kept, in the order chosen."""
    folder, _ = store(t)
    return training.load(t.spark, folder, KEY).select("meter_id", F.posexplode("features").alias("p", "feature")).withColumn("position", F.col("p") + 1)


PARAM_SQL = """WITH b AS (SELECT msn, tier, k * 10 AS n_samples, variant, CASE WHEN tier LIKE 'HT%' THEN 63 WHEN tier LIKE 'Small%' THEN 15 ELSE 31 END AS lv, CASE WHEN tier LIKE 'HT%' THEN 20 WHEN tier LIKE 'Small%' THEN 80 ELSE 50 END AS mr,
    CASE WHEN tier LIKE 'HT%' THEN 0.8 WHEN tier LIKE 'Small%' THEN 0.5 ELSE 0.7 END AS fs, CASE WHEN tier LIKE 'HT%' THEN 0.035 ELSE 0.03 END AS lr, CASE WHEN tier LIKE 'Small%' THEN 6 ELSE 8 END AS md, CASE WHEN tier LIKE 'Small%' THEN 0.5 ELSE 0.1 END AS l1, CASE WHEN tier LIKE 'Small%' THEN 5.0 ELSE 1.0 END AS l2
    FROM registry, (VALUES ('base'), ('conservative'), ('aggressive'), ('deep'), ('wide'), ('regularized')) v(variant)), c AS (SELECT *, CASE WHEN n_samples < 3000 THEN least(lv, 15) ELSE lv END AS cl, CASE WHEN n_samples < 3000 THEN greatest(mr, 100) ELSE mr END AS cm FROM b)
    SELECT msn, variant, CASE variant WHEN 'conservative' THEN greatest(15, cl // 2) WHEN 'aggressive' THEN least(127, cl * 2) WHEN 'deep' THEN least(127, cl + 32) ELSE cl END AS num_leaves, CASE variant WHEN 'conservative' THEN cm * 2 WHEN 'aggressive' THEN greatest(10, cm // 2) WHEN 'deep' THEN greatest(20, cm - 10) ELSE cm END AS min_rows,
    CASE variant WHEN 'aggressive' THEN least(0.9, fs + 0.1) WHEN 'wide' THEN least(0.95, fs + 0.2) WHEN 'regularized' THEN greatest(0.4, fs - 0.15) ELSE fs END AS feature_share, CASE variant WHEN 'wide' THEN 0.9 ELSE 0.8 END AS row_share, CASE variant WHEN 'conservative' THEN 0.02 WHEN 'aggressive' THEN 0.05 ELSE lr END AS learning_rate,
    CASE variant WHEN 'deep' THEN 12 ELSE md END AS max_depth, CASE variant WHEN 'regularized' THEN l1 * 5 ELSE l1 END AS l1, CASE WHEN variant IN ('conservative', 'regularized') THEN l2 * 3 ELSE l2 END AS l2 FROM c"""


@query("fit_tier_params", "msn:s variant:s num_leaves:i min_rows:i feature_share:4 row_share:4 learning_rate:4 max_depth:i l1:3 l2:3", PARAM_SQL)
def _(t):
    df = t.registry.select("msn", "tier", (F.col("k") * 10).alias("n_samples")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in models.VARIANTS])))
    return models.tier_params(df)


@query("fit_quantile_band", "meter_id:s ts:t demand_kwh:4 predicted_kwh:3 q10_kwh:3 q90_kwh:3", f"WITH RECURSIVE {FIT} SELECT meter_id, ts, demand_kwh, predicted_kwh, q10_kwh, q90_kwh FROM held")
def _(t):
    """Band of the stored models over the rows that they were judged on."""
    folder, df = store(t)
    n = F.count("*").over(Window.partitionBy("meter_id"))
    held = df.filter(F.col("ts") <= F.lit(CUTOFF).cast("timestamp")).withColumn("_held", F.row_number().over(Window.partitionBy("meter_id").orderBy("ts")) > F.floor(n * 0.85)).filter("_held")
    return training.predict(held, training.load(t.spark, folder, KEY), KEY, FEATURES).filter("predicted_kwh is not null")


@query("fit_group_band", "tier:s block_label:s low_kwh:3 high_kwh:3", f"""WITH RECURSIVE {FIT}, tiers AS (SELECT meter_id, CASE WHEN avg(demand_kwh) < 60 THEN 'small' ELSE 'large' END AS tier FROM train GROUP BY 1)
    SELECT tier, {BLOCK_SQL} AS block_label, quantile_cont(demand_kwh - predicted_kwh, 0.1) AS low_kwh, quantile_cont(demand_kwh - predicted_kwh, 0.9) AS high_kwh FROM shifted JOIN tiers USING (meter_id) WHERE split = 'train' GROUP BY 1, 2""")
def _(t):
    """Band by size of the meter and block of the day, from the residuals that the stored models leave on their training rows."""
    folder, df = store(t)
    n = F.count("*").over(Window.partitionBy("meter_id"))
    rows = df.filter(F.col("ts") <= F.lit(CUTOFF).cast("timestamp")).withColumn("_train", F.row_number().over(Window.partitionBy("meter_id").orderBy("ts")) <= F.floor(n * 0.85)).filter("_train")
    scored = training.predict(rows, training.load(t.spark, folder, KEY), KEY, FEATURES).filter("predicted_kwh is not null")
    scored = cut_lineage(scored, "band-rows")
    tiers = scored.groupBy("meter_id").agg(F.when(F.avg(Y) < 60, "small").otherwise("large").alias("tier"))
    return heads.group_bands(scored.join(tiers, "meter_id"), ["tier", "block_label"], Y, "predicted_kwh")


HEAD_FEATURES = ["lag_1", "lag_24", "lag_168", "rmean_24", "hour_sin", "hour_cos", "temperature"]


@query("fit_quantile_heads", "meter_id:s ts:t demand_kwh:4 q10_kwh:2 q90_kwh:2", ms.heads_sql(HEAD_FEATURES, Y, CUTOFF))
def _(t):
    """Ten and ninety percent heads learned up to the cutoff, over everything after it."""
    df = cut_lineage(table(t), "head-table")
    late = F.col("ts") > F.lit(CUTOFF).cast("timestamp")
    return heads.add_heads(df.filter(late), heads.fit_heads(df.filter(~late), KEY, HEAD_FEATURES, Y), KEY, HEAD_FEATURES)


@query("fc_batch", "meter_id:s ts:t predicted_kwh:3 q10_kwh:3 q90_kwh:3 block_label:s historical_block_mape:2", f"""WITH RECURSIVE {FIT},
    bm AS (SELECT meter_id, {BLOCK_SQL} AS block_label, avg(abs(demand_kwh - predicted_kwh) / demand_kwh * 100.0) FILTER (demand_kwh > 0.5) AS historical_block_mape FROM held GROUP BY ALL),
    s AS (SELECT t.meter_id, ts, {BLOCK_SQL} AS block_label, CASE WHEN coef IS NOT NULL THEN greatest({ms.linear(FEATURES)} - trail_mbe_capped, 0.0) END AS predicted_kwh, r10, r90 FROM tbl t LEFT JOIN fit USING (meter_id) LEFT JOIN gate USING (meter_id) LEFT JOIN band USING (meter_id) WHERE ts > TIMESTAMP '{CUTOFF}')
    SELECT s.meter_id, ts, predicted_kwh, CASE WHEN predicted_kwh IS NOT NULL THEN least(greatest(predicted_kwh + r10, 0.0), predicted_kwh) END AS q10_kwh, CASE WHEN predicted_kwh IS NOT NULL THEN greatest(predicted_kwh + r90, 0.0, predicted_kwh) END AS q90_kwh, s.block_label, historical_block_mape
    FROM s LEFT JOIN bm ON bm.meter_id = s.meter_id AND bm.block_label = s.block_label""")
def _(t):
    """Score everything after the cutoff with the stored models."""
    folder, df = store(t)
    return training.predict(df.filter(F.col("ts") > F.lit(CUTOFF).cast("timestamp")), training.load(t.spark, folder, KEY), KEY, FEATURES)


def recursive(t, cutoff=None, steps=168):
    df = filled(t)
    if cutoff:
        df = df.filter(F.col("ts") < F.lit(cutoff).cast("timestamp"))
    df = cut_lineage(df, "context")
    fit = models.fit_ridge(models.step_features(df, KEY).filter("lag_168 is not null"), KEY, models.STEP_FEATURES, Y, keep_share=1.0)
    return models.recursive_forecast(df, fit, KEY, steps)


@query("fc_recursive", "meter_id:s ts:t step:i predicted_kwh:3", f"WITH RECURSIVE filled AS MATERIALIZED {ms.FILLED}, {ms.recursive_ctes('filled')} SELECT * FROM path")
def _(t):
    return recursive(t)


@query("fc_strategy_tables", "strategy:s meter_id:s ts:t predicted_kwh:3", ms.strategies_sql(PROFILE_SQL))
def _(t):
    """Seasonal anchor, batch model on a primed context and recursive model over one window."""
    seen = cut_lineage(filled(t), "seen")
    horizon = forecasts.horizon_after(seen, KEY, "1 hour", "7 days")
    a = forecasts.seasonal_anchor(seen, horizon, KEY).select("meter_id", "ts", F.col("mean_kwh").alias("predicted_kwh"), F.lit("A").alias("strategy"))
    fit = models.fit_ridge(models.step_features(seen, KEY).filter("lag_168 is not null"), KEY, models.STEP_FEATURES, Y, keep_share=1.0)
    primed = forecasts.priming_context(seen, KEY, "1 hour", horizon_days=7, pseudo_days=0, tail_days=14)
    scored = models.score(models.step_features(primed, KEY), fit, KEY, models.STEP_FEATURES).filter("source = 'horizon'")
    b = scored.select("meter_id", "ts", "predicted_kwh", F.lit("B").alias("strategy"))
    c = models.recursive_forecast(seen, fit, KEY).select("meter_id", "ts", "predicted_kwh", F.lit("C").alias("strategy"))
    return a.unionByName(b).unionByName(c)


@query("fc_missing_features", "meter_id:s ts:t lag_1:4 unseen:2 temperature:4", f"SELECT meter_id, s.ts, coalesce(lag(demand_kwh) OVER (PARTITION BY meter_id ORDER BY s.ts), 0.0) AS lag_1, 0.0 AS unseen, coalesce(temperature, 0.0) AS temperature FROM sites s LEFT JOIN weather wx ON {weather_at('s')} AND hour(wx.ts) <> 7")
def _(t):
    """Weather lacks every seventh hour of a day, so that something is missing."""
    df = located(feat.add_lags(t.sites, KEY, Y, {1: "lag_1"})).join(t.weather.filter(F.hour("ts") != 7).select("location_id", "ts", "temperature"), ["location_id", "ts"], "left")
    return models.with_missing(df, ["lag_1", "unseen", "temperature"])


@query("fc_solar_hybrid", "location_id:s ts:t generation_kwh:3 physics_kwh:4 tree_kwh:3")
def _(t):
    """0.4 physics plus 0.6 trees learned on measured irradiance."""
    df = t.weather.withColumns({"lat": F.lit(17.0), "lon": F.lit(81.8), "cap": F.lit(100.0), "hour": F.hour("ts"), "dow": F.weekday("ts")})
    df = wf.add_solar_generation(df.withColumn("ghi_clear", wf.clear_sky_ghi("ts", F.col("lat"), F.col("lon"))), "ghi_clear", "cap", "cloud_cover").withColumn("measured", F.col("ghi") * 0.08)
    df = cut_lineage(df, "solar")
    names = ["ghi_clear", "hour", "dow", "temperature", "cloud_cover", "humidity", "wind_speed"]
    path = training.save_pipeline(models.fit_trees(df, names, "measured", rounds=4, depth=3), scratch_path(t.spark, "solar"), "irradiance", 1)
    out = training.load_pipeline(path).transform(models.with_missing(df, names))
    return out.withColumnRenamed("generation_kwh", "physics_kwh").withColumn("generation_kwh", 0.4 * F.col("physics_kwh") + 0.6 * F.greatest("tree_kwh", F.lit(0.0)))


BACK_SQL = f"""WITH RECURSIVE filled AS MATERIALIZED (SELECT * FROM {ms.FILLED} WHERE ts < TIMESTAMP '2024-01-23 00:00:00'), {ms.recursive_ctes('filled')},
    scored AS (SELECT p.meter_id, p.ts, p.predicted_kwh, s.demand_kwh AS actual_kwh FROM path p JOIN sites s ON s.meter_id = p.meter_id AND s.ts = p.ts)"""


def hourly_blocks(rows):
    """Errors of hourly and four-hour blocks of hourly rows."""
    one = lambda c: f"""SELECT meter_id, {IDS[c]} AS block_id, b AS block_start_ts, 100.0 * abs(p - a) / greatest(a, 0.0005) AS ape, '{c}' AS cadence FROM (
        SELECT meter_id, {STARTS[c]} AS b, sum(predicted_kwh) AS p, sum(actual_kwh) AS a FROM {rows} GROUP BY 1, 2) WHERE a >= 0.0005"""  # noqa: E731
    return " UNION ALL ".join(one(c) for c in ("hourly", "tod_4h"))


@query("ev_recursive_backtest", "meter_id:s mape:2 mae:3 mbe:3 n:i", f"""{BACK_SQL} SELECT meter_id, {ms.metrics('actual_kwh', 'predicted_kwh')}, count(*) AS n FROM scored GROUP BY 1""")
def _(t):
    p = recursive(t, "2024-01-23 00:00:00")
    actual = t.sites.select("meter_id", "ts", F.col(Y).alias("actual_kwh"))
    return accuracy.point_metrics(p.join(actual, ["meter_id", "ts"]), KEY, "actual_kwh", "predicted_kwh")


@query("ev_recursive_blocks", "meter_id:s block_id:i block_start_ts:t ape:2 cadence:s", f"{BACK_SQL} " + hourly_blocks("scored"))
def _(t):
    p = recursive(t, "2024-01-23 00:00:00").select("meter_id", "ts", "predicted_kwh")
    return accuracy.block_accuracy(p, t.sites.select("meter_id", "ts", F.col(Y).alias("actual_kwh")), ["hourly", "tod_4h"], native_minutes=60)


# Days of a meter numbered from 0, and its three ways of holding rows out.
DAYS_SQL = f"""{ms.TABLE}, dd AS (SELECT meter_id, CAST(ts AS DATE) AS d, count(*) AS slots FROM tbl GROUP BY ALL),
    di AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY meter_id) AS nd, sum(CASE WHEN slots >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS full_i FROM dd),
    r AS (SELECT t.*, i, nd, row_number() OVER (PARTITION BY t.meter_id ORDER BY ts) <= floor(count(*) OVER (PARTITION BY t.meter_id) * 0.75) AS early, NOT (slots >= 20 AND full_i % 4 = 0) AS other_day FROM tbl t JOIN di ON di.meter_id = t.meter_id AND di.d = CAST(t.ts AS DATE)),
    folds AS (SELECT 'chrono' AS strategy, 0 AS fold, early AS train, * FROM r UNION ALL SELECT 'stratified', 0, other_day, * FROM r
        UNION ALL SELECT 'rolling', f, i < 9 + 4 * f, r.* FROM r, range(0, 40) x(f) WHERE 9 + 4 * f + 3 <= nd AND i < 9 + 4 * f + 3)"""
FOLD_KEY = ["strategy", "meter_id", "fold"]


def fold_parts(t):
    """(tests, grams) of the three strategies, from one sum over the rows."""
    df = backtests.by_day(splits.every_nth_day(splits.by_rows(table(t), KEY).withColumnRenamed("split", "chrono"), KEY, 4, 0, 20).withColumnRenamed("split", "stratified"), KEY)
    df = cut_lineage(df, "folds")
    sums = backtests.block_sums(df, KEY, ["block", "chrono", "stratified"], FEATURES, Y)
    named = lambda d, s: d.withColumn("strategy", F.lit(s))
    grams = [named(backtests.total(sums.filter(f"{s} = 'train'"), KEY, FEATURES).withColumn("fold", F.lit(0)), s) for s in ("chrono", "stratified")]
    days = backtests.total(sums, [*KEY, "block"], FEATURES)
    grams.append(named(backtests.expanding_folds(days, KEY, FEATURES, 9, 4, 3), "rolling"))
    tests = [named(df.filter(f"{s} = 'test'").withColumn("fold", F.lit(0)), s) for s in ("chrono", "stratified")]
    tests.append(named(df.withColumn("fold", F.explode(backtests.test_folds(F.col("block"), F.col("n_blocks"), 9, 4, 3))), "rolling"))
    return tests[0].unionByName(tests[1]).unionByName(tests[2]), grams[0].unionByName(grams[1]).unionByName(grams[2])


@query("ev_holdout_folds", "strategy:s meter_id:s fold:i mape:2 mae:3 mbe:3 n_train:i n_test:i", f"""WITH RECURSIVE {DAYS_SQL}, tr AS (SELECT * FROM folds WHERE train), {ms.ridge_ctes('tr', FOLD_KEY, FEATURES, Y, KEEP, min_rows=200)},
    sc AS (SELECT f.*, n, {ms.linear(FEATURES)} AS p FROM folds f JOIN fit USING (strategy, meter_id, fold) WHERE NOT train)
    SELECT strategy, meter_id, fold, {ms.metrics(Y, 'p')}, max(n) AS n_train, count(*) AS n_test FROM sc GROUP BY strategy, meter_id, fold HAVING count(*) >= 48""")
def _(t):
    """Every meter, strategy and fold in one fit; a fold trains on sums by day, so no row is copied for it."""
    tests, grams = fold_parts(t)
    return backtests.fold_metrics(tests, grams, FOLD_KEY, FEATURES, Y)


@query("ev_cross_validate", "meter_id:s mae_mean:3 mae_std:3 rmse_mean:3 mape_mean:2 n_folds:i", f"""WITH RECURSIVE {ms.TABLE}, k AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) - 1 AS i, floor((count(*) OVER (PARTITION BY meter_id) - 240) / 4.0) AS z FROM tbl),
    folds AS (SELECT *, i < 240 + fold * z AS train FROM k, range(0, 4) x(fold) WHERE z > 0 AND i < 240 + (fold + 1) * z), tr AS (SELECT * FROM folds WHERE train), {ms.ridge_ctes('tr', ['meter_id', 'fold'], FEATURES, Y, KEEP, min_rows=200)},
    sc AS (SELECT f.*, {ms.linear(FEATURES)} AS p FROM folds f JOIN fit USING (meter_id, fold) WHERE NOT train),
    m AS (SELECT meter_id, fold, {ms.metrics(Y, 'p')} FROM sc GROUP BY 1, 2 HAVING count(*) >= 24)
    SELECT meter_id, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, avg(mape) AS mape_mean, count(*) AS n_folds FROM m GROUP BY 1""")
def _(t):
    df = cut_lineage(backtests.by_rank(table(t), KEY, 4, 240), "cv")
    sums = backtests.block_sums(df, KEY, ["block"], FEATURES, Y)
    tests = df.filter("block > 0").withColumn("fold", F.col("block") - 1)
    m = backtests.fold_metrics(tests, backtests.expanding_folds(sums, KEY, FEATURES, 1, 1, 1), ["meter_id", "fold"], FEATURES, Y, min_train=200, min_test=24)
    return m.groupBy("meter_id").agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.avg("mape").alias("mape_mean"), F.count("*").alias("n_folds"))


@query("ev_window_backtest", "meter_id:s mape:2 mae:3 n:i", ms.WINDOW_BACKTEST)
def _(t):
    """Train before a window; inside it lags come from the primed value of the weeks before."""
    cut = F.lit("2024-01-23 00:00:00").cast("timestamp")
    df = cut_lineage(filled(t), "window")
    past = df.filter(F.col("ts") < cut)
    primed = weekly_lookback(past, df.filter(F.col("ts") >= cut).select("meter_id", "ts"), KEY, Y).withColumnRenamed("primed", Y)
    context = past.select("meter_id", "ts", Y, F.lit(False).alias("ahead")).unionByName(primed.withColumn("ahead", F.lit(True)))
    fit = models.fit_ridge(models.step_features(past, KEY).filter("lag_168 is not null"), KEY, models.STEP_FEATURES, Y, keep_share=1.0)
    p = models.score(models.step_features(context, KEY), fit, KEY, models.STEP_FEATURES).filter("ahead").drop(Y)
    return accuracy.point_metrics(p.join(t.sites.select("meter_id", "ts", F.col(Y).alias("actual_kwh")), ["meter_id", "ts"]), KEY, "actual_kwh", "predicted_kwh")


@query("ev_rolling_origin_job", "origin:i cohort:s cadence:s mean_mape:2 n_blocks:i n_meters:i", f"""WITH RECURSIVE {DAYS_SQL}, rf AS (SELECT * FROM folds WHERE strategy = 'rolling'), tr AS (SELECT * FROM rf WHERE train), {ms.ridge_ctes('tr', ['meter_id', 'fold'], FEATURES, Y, KEEP, min_rows=100)},
    sc AS (SELECT f.meter_id || '@' || fold AS meter_id, ts, demand_kwh AS actual_kwh, {ms.linear(FEATURES)} AS predicted_kwh FROM rf f JOIN fit USING (meter_id, fold) WHERE NOT train), b AS ({hourly_blocks('sc')}),
    m AS (SELECT split_part(meter_id, '@', 1) AS meter, CAST(split_part(meter_id, '@', 2) AS INTEGER) AS origin, cadence, sum(ape) AS a, count(*) AS c FROM b GROUP BY ALL)
    SELECT origin, CASE right(meter, 1) WHEN '0' THEN 'A' WHEN '1' THEN 'B' WHEN '2' THEN 'C' ELSE 'D' END AS cohort, cadence, sum(a) / sum(c) AS mean_mape, sum(c) AS n_blocks, count(*) AS n_meters FROM m GROUP BY ALL""")
def _(t):
    """All origins in one job keyed by (origin, meter): fit from sums by day, forecast, block errors, cohort rollup."""
    df = cut_lineage(backtests.by_day(table(t), KEY), "origins")
    grams = backtests.expanding_folds(backtests.block_sums(df, KEY, ["block"], FEATURES, Y), KEY, FEATURES, 9, 4, 3)
    tests = df.withColumn("fold", F.explode(backtests.test_folds(F.col("block"), F.col("n_blocks"), 9, 4, 3)))
    _, scored = backtests.score_folds(tests, grams, ["fold", "meter_id"], FEATURES, min_rows=100)
    test = scored.filter("predicted_kwh is not null").withColumn("meter_id", F.concat_ws("@", "meter_id", F.col("fold").cast("string")))
    blocks = accuracy.block_accuracy(test, test.withColumnRenamed(Y, "actual_kwh"), ["hourly", "tod_4h"], native_minutes=60)
    name = F.split_part("meter_id", F.lit("@"), F.lit(1))
    cohort = F.when(name.endswith("0"), "A").when(name.endswith("1"), "B").when(name.endswith("2"), "C").otherwise("D")
    per_meter = blocks.groupBy("meter_id", "cadence").agg(F.sum("ape").alias("a"), F.count("*").alias("c"))
    return per_meter.groupBy(F.split_part("meter_id", F.lit("@"), F.lit(2)).cast("int").alias("origin"), cohort.alias("cohort"), "cadence").agg((F.sum("a") / F.sum("c")).alias("mean_mape"), F.sum("c").alias("n_blocks"), F.count("*").alias("n_meters"))


SETS = {"mape_base": [f for f in FEATURES if f not in ("temperature", "cooling_deg")], "mape_weather": FEATURES, "mape_day_ahead": [f for f in FEATURES if f not in ("lag_1", "lag_2", "rmean_24")]}


@query("ev_multistep", "meter_id:s mape_base:2 mape_weather:2 mape_day_ahead:2 gain_pct:2", ms.multistep_sql(SETS, Y))
def _(t):
    """Feature sets side by side: without weather, with weather, and with lags of a day or more only."""
    df = cut_lineage(splits.by_rows(table(t), KEY, 0.8), "multistep")
    out = None
    for name, cols in SETS.items():
        _, scored = models.train_and_score(df, KEY, cols, Y, keep_share=1.0)
        m = scored.filter("split = 'test'").groupBy("meter_id").agg(accuracy.masked_mape(Y, "predicted_kwh", 0.5).alias(name))
        out = m if out is None else out.join(m, "meter_id")
    return out.withColumn("gain_pct", (F.col("mape_base") - F.col("mape_weather")) / F.nullif(F.col("mape_base"), F.lit(0.0)) * 100.0)
