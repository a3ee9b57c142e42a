"""Keys of the frozen runs share states, so that calls do not grow with the keys."""

import random

from pyspark.sql import functions as F

from wattloom.streaming import jobs


def test_many_keys_share_states(spark, tmp_path):
    """3000 long keys, of which doubles could not tell some apart, and a null one; rows shuffled over files of one trigger each."""
    rnd, source, out, state = random.Random(3), *(str(tmp_path / n) for n in ("in", "out", "state"))
    keys = [*((1 << 60) + i for i in range(3000)), None]
    rows = [(k, 1_700_000_000 + 600 * i + (j % 7), float(rnd.randrange(2))) for j, k in enumerate(keys) for i in range(6 if k else 60)]
    shuffled = sorted(rows, key=lambda r: r[1] + rnd.randrange(7000))
    for lo in range(0, len(shuffled), 7000):
        spark.createDataFrame(shuffled[lo : lo + 7000], "k long, s long, v double").selectExpr("k", "timestamp_seconds(s) as ts", "v").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema("k long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(source)
    end = jobs.EndOfInput(live)
    got = jobs.drain(jobs.frozen_runs_any_order(end.stream, "k", "v", "2 hours"), "runs", out, state, end=end)
    want, last, run = [], {}, {}
    for k, s, v in sorted(rows, key=lambda r: r[1:]):
        run[k] = run.get(k, 0) + 1 if last.get(k) == v else 0
        last[k] = v
        want.append((k, s, v, run[k], run[k] >= 3))
    order = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.withColumn("ts", F.unix_seconds("ts")).collect()), key=order) == sorted(want, key=order)
    assert spark.read.format("statestore").load(state).count() <= jobs.RUN_GROUPS + 1
