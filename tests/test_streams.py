"""A drained stream continues where an earlier run stopped."""

import random

from pyspark.sql import functions as F

from wattloom.streaming import jobs


def test_runs_continue_across_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def write(values, start):
        rows = [("a", start + i, float(v)) for i, v in enumerate(values)]
        spark.createDataFrame(rows, "k string, s long, v double").selectExpr("k", "timestamp_seconds(s) as ts", "v").coalesce(1).write.mode("append").parquet(source)

    def run():
        live = spark.readStream.schema("k string, ts timestamp, v double").parquet(source)
        return [(r.v, r.run_length) for r in jobs.drain(jobs.frozen_runs(live, "k", "v"), "runs", out, state).orderBy("ts").collect()]

    write([1, 1, 2, 2], 0)
    assert run() == [(1, 0), (1, 1), (2, 0), (2, 1)]
    write([2, 2, 3], 10)
    assert run() == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0)]


def test_runs_in_any_order_equal_the_ordered_ones(spark, tmp_path):
    """Rows shuffled within the delay over many files, one file a trigger; a second key falls silent early."""
    rnd, source = random.Random(5), str(tmp_path / "in")
    rows = [(k, 1_700_000_000 + 600 * i, float(rnd.randrange(2))) for k, n in (("a", 300), ("b", 40)) for i in range(n)]
    shuffled = sorted(rows, key=lambda r: r[1] + rnd.randrange(7000))
    for i in range(0, len(shuffled), 34):
        spark.createDataFrame(shuffled[i : i + 34], "k string, s long, v double").selectExpr("k", "timestamp_seconds(s) as ts", "v").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(source)
    end = jobs.EndOfInput(live)
    got = jobs.drain(jobs.frozen_runs_any_order(end.stream, "k", "v", "2 hours"), "runs", end=end)
    want, last, run = [], {}, {}
    for k, s, v in sorted(rows):
        run[k] = run.get(k, 0) + 1 if last.get(k) == v else 0
        last[k] = v
        want.append((k, s, v, run[k], run[k] >= 3))
    assert sorted(map(tuple, got.withColumn("ts", F.unix_seconds("ts")).collect())) == want


def test_the_end_of_input_closes_windows_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.sql("select timestamp_seconds(id * 60) as ts, double(id) as v from range(100)").repartition(4).write.parquet(source)
    live = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(source)
    end = jobs.EndOfInput(live)
    windows = jobs.fleet_tumbling(end.stream, "v", "30 minutes", "2 hours", min_count=1)
    assert jobs.drain(windows, "w", out, state).count() == 0  # all within the delay
    assert sorted(r.fleet_count for r in jobs.drain(windows, "w", out, state, end=end).collect()) == [10, 30, 30, 30]
