"""Quantile heads and the table function."""

import numpy as np
from pyspark.sql import functions as F

from wattloom.operators import dispatch, table_functions
from wattloom.plans import heads

KEY = ["meter_id"]


def pinball(y, p, q):
    r = y - p
    return np.where(r >= 0, q * r, (q - 1) * r).mean()


def test_heads_reach_the_least_pinball_loss(spark):
    """Against a descent of the loss itself, one coordinate at a time by exact weighted medians; noise grows with x."""
    rnd = np.random.default_rng(8)
    n = 600
    x = rnd.random((n, 2)) * [10, 1]
    y = 3 + 2 * x[:, 0] - x[:, 1] + rnd.normal(size=n) * (0.5 + x[:, 0])
    df = spark.createDataFrame([("m", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "meter_id string, a double, b double, y double")
    got = heads.fit_heads(df, KEY, ["a", "b"], "y", rounds=25).first()
    full = np.column_stack([np.ones(n), x])
    for q in (0.1, 0.9):
        best = min((descend(full, y, q, start) for start in (np.zeros(3), np.linalg.lstsq(full, y, rcond=None)[0], np.array(got[heads.name(q)]))), key=lambda b: pinball(y, full @ b, q))
        mine = np.array(got[heads.name(q)])
        assert pinball(y, full @ mine, q) <= pinball(y, full @ best, q) * 1.003
        assert abs((y <= full @ mine).mean() - q) < 0.01


def descend(x, y, q, b):
    b = b.astype(float).copy()
    for _ in range(300):
        for j in range(x.shape[1]):
            rest = y - x @ b + x[:, j] * b[j]
            use = np.abs(x[:, j]) > 1e-12
            points = rest[use] / x[use, j]
            losses = [pinball(y, x @ b + x[:, j] * (c - b[j]), q) for c in np.quantile(points, np.linspace(0.02, 0.98, 25))] + [pinball(y, x @ b, q)]
            candidates = [*np.quantile(points, np.linspace(0.02, 0.98, 25)), b[j]]
            b[j] = candidates[int(np.argmin(losses))]
    return b


def test_held_out_coverage(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for m, wide in (("calm", 1.0), ("wild", 6.0)):
        for i in range(6000):
            x = rnd.random() * 4
            rows.append((m, i, x, 20 + 3 * x + rnd.normal() * wide * (0.3 + x / 4)))
    df = spark.createDataFrame([(m, i, float(x), float(y)) for m, i, x, y in rows], "meter_id string, i int, x double, y double")
    fitted = heads.fit_heads(df.filter("i < 3000"), KEY, ["x"], "y")
    held = heads.add_heads(df.filter("i >= 3000"), fitted, KEY, ["x"])
    for r in held.groupBy("meter_id", (F.col("x") > 2).alias("far")).agg(F.avg(F.col("y").between(F.col("q10_kwh"), F.col("q90_kwh")).cast("int")).alias("c")).collect():
        assert abs(r.c - 0.8) < 0.03
    assert heads.add_heads(df.limit(1).withColumn("meter_id", F.lit("new")), fitted, KEY, ["x"]).first().q10_kwh is None


def test_band_by_group(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "double(id) as y", "0.0 as p")
    got = {r.g: r for r in heads.group_bands(df, ["g"], "y", "p").collect()}
    for g in (0, 1):
        want = np.quantile(np.arange(g, 1000, 2), [0.1, 0.9])
        assert np.allclose([got[g].low_kwh, got[g].high_kwh], want)


def test_table_function_equals_the_array_form(spark):
    rnd = np.random.default_rng(1)
    rows = [(s, d, h, float(rnd.random() * 90), float(rnd.random() * 60), float(2 + rnd.random() * 7)) for s in "ab" for d in range(3) for h in range(24) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "site_id string, d int, hour int, demand double, solar double, price double").selectExpr("site_id", "timestamp_seconds(d * 86400) as day", "hour", "demand", "solar", "price")
    from wattloom.functions.money import landed_cost

    table_functions.register(spark)
    df.withColumn("landed", landed_cost(F.col("price"))).repartition(4).createOrReplaceTempView("test_hours")
    got = spark.sql(f"select * from battery_day(table(test_hours) partition by (site_id, day) order by (hour), 120, 30, 'cheap_grid', 6.5, {table_functions.idle_cost(spark)})").collect()
    days = dispatch.day_vectors(df, ["site_id", "day"], "hour", ["demand", "solar", "price"]).withColumns({"capacity_kwh": F.lit(120.0), "power_kw": F.lit(30.0), "strategy": F.lit("cheap_grid")})
    want = dispatch.hourly_rows(dispatch.greedy_day(days), ["site_id", "day"]).collect()
    assert len(got) == len(want) == 144
    assert np.allclose([list(r)[3:] for r in sorted(got)], [list(r)[3:] for r in sorted(want)])
