"""Structured Streaming jobs over meter packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.operators import ami
from wattloom.session import scratch_path

#: States over which the keys of ``frozen_runs_any_order`` are dealt; a stream keeps the number it began with.
RUN_GROUPS = 512


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream with an event-time ``ts`` that watermarks accept."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


class EndOfInput:
    """A second source beside a stream's own, empty until the stream is declared complete.

    Its one row lies so far ahead in time that the watermark passes everything that is still open; the row itself stays
    open for ever.  What arrives after it is late, so a stream is ended once.
    """

    AT = "2200-01-01 00:00:00"

    def __init__(self, stream: DataFrame, ts: str = "ts", **values: object):
        """``values`` are the columns that the row needs to pass the filters of the job; all others are null."""
        self.spark, self.path, schema = stream.sparkSession, scratch_path(stream.sparkSession, "end-of-input"), stream.schema
        row = {f.name: F.lit(self.AT if f.name == ts else values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields}
        self.row = self.spark.range(1).select(*row.values())
        self.row.limit(0).write.parquet(self.path)
        self.stream = stream.unionByName(self.spark.readStream.schema(schema).parquet(self.path))

    def declare(self) -> None:
        self.row.coalesce(1).write.mode("append").parquet(self.path)


def drain(stream: DataFrame, name: str, out: str | None = None, state: str | None = None, end: EndOfInput | None = None) -> DataFrame:
    """Process everything available into a table and read it back.

    A run that is given the output and state paths of an earlier one continues it; without paths it starts fresh ones in
    the shared folder.  With ``end`` the input is then declared complete, and what was open is processed too.
    """
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")

    def run() -> None:
        job = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        job.awaitTermination()

    run()
    if end:
        end.declare()
        run()
    return spark.read.schema(stream.schema).parquet(out)


def late_filter(packets: DataFrame, max_intervals: int = 8, minutes: int = 15) -> DataFrame:
    """Stateless lateness rule; the watermark is not used, because lateness is a property of the packet."""
    return ami.flag_late(packets, max_intervals=max_intervals, minutes=minutes)


def dedupe_latest(packets: DataFrame, keys: list[str], arrival: str, values: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """One packet per key and slot with the latest arrival; the slot is final once the watermark has passed it."""
    newest = F.max(F.struct(arrival, *values)).alias("_m")
    out = packets.withWatermark(ts, delay).groupBy(*keys, ts).agg(newest)
    return out.select(*keys, ts, F.col(f"_m.{arrival}").alias(arrival), *[F.col(f"_m.{v}").alias(v) for v in values])


def fleet_tumbling(events: DataFrame, value: str, width: str, delay: str, min_count: int = 5, ts: str = "ts") -> DataFrame:
    """Fleet mean, deviation and count per tumbling window."""
    out = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.avg(value).alias("fleet_mean"), F.stddev_samp(value).alias("fleet_std"), F.count(value).alias("fleet_count"))
    return out.filter(F.col("fleet_count") >= min_count).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "fleet_mean", "fleet_std", "fleet_count")


def baseline_sliding(events: DataFrame, key: str, value: str, slot: str, width: str, slide: str, delay: str, ts: str = "ts") -> DataFrame:
    """Trailing median and deviation on a slide grid over slot sums, so the state of a key is bounded by its slots."""
    slots = events.withWatermark(ts, delay).groupBy(key, F.window(ts, slot).alias("s")).agg(F.sum(value).alias("slot_sum"))
    out = slots.groupBy(key, F.window(F.window_time("s"), width, slide).alias("w")).agg(F.percentile("slot_sum", F.lit(0.5)).alias("base_median"), F.stddev_samp("slot_sum").alias("base_sigma"), F.count("*").alias("n_slots"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "base_median", "base_sigma", "n_slots")


def flagged_sessions(flagged: DataFrame, key: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """Consecutive flagged rows of a key as one period."""
    out = flagged.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_rows"), F.max(ts).alias("last_ts"))
    return out.select(key, F.col("w.start").alias("period_start"), "last_ts", "n_rows")


def quality_scores(packets: DataFrame) -> DataFrame:
    return ami.interval_score(ami.check_consistency(ami.check_limits(ami.sync_channels(packets))))


def frozen_runs(events: DataFrame, key: str, value: str, min_run: int = 3, ts: str = "ts") -> DataFrame:
    """Length of the current run of equal values per row, kept in state across batches.

    A row is frozen from the ``min_run``-th repeat on: a stream cannot mark the earlier rows of a run any more.  Batches
    must arrive in time order per key; rows of one batch are ordered here.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {ts} timestamp, {value} double, run_length bigint, is_frozen boolean"

    def update(group, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(chunks)).sort_values(ts, kind="stable")
        v, at = rows[value].to_numpy(dtype=float), np.arange(len(rows))
        same = np.concatenate([[last is not None and v[0] == last], v[1:] == v[:-1]])
        start = np.maximum.accumulate(np.where(same, -1, at))  # -1: still the run of the batches before
        lengths = np.where(start < 0, at + 1 + run, at - start)
        state.update((float(v[-1]), int(lengths[-1])))
        rows = rows.assign(run_length=lengths)
        yield rows.assign(is_frozen=rows["run_length"] >= min_run)[[key, ts, value, "run_length", "is_frozen"]]

    slim = events.select(key, ts, F.col(value).cast("double").alias(value))
    return slim.groupBy(key).applyInPandasWithState(update, out, "last double, run long", "append", "NoTimeout")


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def frozen_runs_any_order(events: DataFrame, key: str, value: str, delay: str, min_run: int = 3, ts: str = "ts", groups: int = RUN_GROUPS) -> DataFrame:
    """``frozen_runs`` for rows that arrive in any order within ``delay``.

    A row waits in the state until the watermark has passed it; then it extends or ends the run before it.  Keys are dealt by
    hash over ``groups`` states, so that calls do not grow with the keys; a null key has a state of its own.  A timer at the
    oldest waiting row wakes a state without new rows.  A state holds its keys' open runs and the rows of ``delay``, both as
    Arrow tables.  Rows of one time are ordered by value.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {ts} timestamp, {value} double, run_length bigint, is_frozen boolean"

    def update(group, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [_unpacked(bytes(b)) for b in state.get] if state.exists else []
        came = [] if state.hasTimedOut else [pd.DataFrame({"k": c[key], "t": c[ts].astype("datetime64[us]").astype("int64"), "v": c[value].astype("float64")}) for c in chunks]
        rows = pd.concat([*held[1:], *came], ignore_index=True)
        keys = pd.concat([held[0]["k"], rows["k"]], ignore_index=True) if held else rows["k"]
        code, names = pd.factorize(keys, use_na_sentinel=False)
        n_open = len(keys) - len(rows)
        last, run = np.full(len(names), np.nan), np.full(len(names), -1, np.int64)
        if n_open:
            last[code[:n_open]], run[code[:n_open]] = held[0]["v"], held[0]["run"]
        code, passed = code[n_open:], state.getCurrentWatermarkMs() * 1000
        early = np.flatnonzero(rows["t"].to_numpy() < passed)
        early = early[np.lexsort((rows["v"].to_numpy()[early], rows["t"].to_numpy()[early], code[early]))]
        ready, c = rows.iloc[early], code[early]
        v, at = ready["v"].to_numpy(), np.arange(len(early))
        first = np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
        same = v == np.where(first, last[c], np.concatenate([[np.nan], v[:-1]])[: len(v)])
        start = np.maximum.accumulate(np.where(first | ~same, at, 0))
        lengths = at - start + np.where(first & same, run[c] + 1, 0)[start]
        ends = np.flatnonzero(np.concatenate([c[1:] != c[:-1], [True]])[: len(c)])
        last[c[ends]], run[c[ends]] = v[ends], lengths[ends]
        on = run >= 0
        opened = pd.DataFrame({"k": names[on], "v": last[on], "run": run[on]})
        waiting = rows[rows["t"] >= passed]
        state.update((_packed(opened), _packed(waiting)))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["t"].min()) // 1000, passed // 1000) + 1)
        if len(early):
            yield pd.DataFrame({key: ready["k"].to_numpy(), ts: pd.to_datetime(ready["t"].to_numpy(), unit="us"), value: v, "run_length": lengths, "is_frozen": lengths >= min_run})

    slim = events.select(key, ts, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() | F.col(key).isNull()).withWatermark(ts, delay)
    dealt = slim.withColumn("_group", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups))))
    return dealt.groupBy("_group").applyInPandasWithState(update, out, "open binary, waiting binary", "append", "EventTimeTimeout")
