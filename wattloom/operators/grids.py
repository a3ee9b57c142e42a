"""Slot grids: one row per key and slot, gap detection, resampling and stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def one_per_slot(df: DataFrame, keys: list[str], prefer: str | None = None, earliest: bool = False) -> DataFrame:
    """One row per key, chosen by ``prefer``.

    A hash aggregate with map-side combine: however many copies a key has, each task sends one row of it.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [prefer] if prefer else []
    packed = F.struct(*first, *[c for c in rest if c not in first])
    pick = F.min(packed) if earliest else F.max(packed)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def reindex(df: DataFrame, keys: list[str], ts: str, step: str, fill: float | None = None) -> DataFrame:
    """Every slot between the first and the last row of a key; absent slots become null or ``fill``.

    Rows lie on slots.  Each row emits itself and the absent slots up to the next row, so the rows are shuffled once by
    key, no grid is joined, and later windows by key reuse the partitioning.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    values = [c for c in df.columns if c not in (*keys, ts)]
    df = df.withColumn("_next", F.lead(ts).over(w))
    slots = F.expr(f"sequence({ts}, greatest({ts}, coalesce(_next - interval {step}, {ts})), interval {step})")
    out = df.select(*keys, *values, F.posexplode(slots).alias("_pos", ts))
    kept = {c: F.when(F.col("_pos") == 0, F.col(c)) for c in values}
    out = out.select(*keys, ts, *[e.alias(c) for c, e in kept.items()])
    return out if fill is None else out.fillna(fill)


def detect_gaps(df: DataFrame, keys: list[str], ts: str, minutes: int) -> DataFrame:
    """Missing intervals between present rows, without building the grid."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = minutes * 60_000_000
    here, after = F.unix_micros(ts), F.unix_micros("_next")
    return (
        df.select(*keys, ts)
        .withColumn("_next", F.lead(ts).over(w))
        .withColumn("gap_intervals", F.floor((after - here) / F.lit(step)) - F.when((after - here) % F.lit(step) == 0, 1).otherwise(0))
        .filter("gap_intervals > 0")
        .select(
            *keys,
            F.timestamp_micros(here + step).alias("gap_start"),
            F.timestamp_micros(here + F.col("gap_intervals") * step).alias("gap_end"),
            "gap_intervals",
            (F.col("gap_intervals") * float(minutes)).alias("gap_duration_min"),
        )
    )


def split_slots(df: DataFrame, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Two rows per slot; columns ending in ``_kwh`` are halved, the rest is repeated."""
    out = df.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1))))
    for c in df.columns:
        if c.endswith("_kwh"):
            out = out.withColumn(c, F.col(c).cast("double") / 2.0)
    step = minutes * 60_000_000
    return out.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) + F.col("_part") * step)).drop("_part")


def interpolate_to_half(df: DataFrame, keys: list[str], ts: str, energy: list[str], linear: list[str], labels: list[str], minutes: int, cap: int | None = None) -> DataFrame:
    """Halve the step: energy is halved and held, linear columns take the midpoint, labels are held."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = minutes * 60_000_000
    src = df.withColumns({f"_next_{c}": F.lead(c).over(w) for c in linear})
    src = src.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1))))
    out = {c: F.col(c) / 2.0 for c in energy}
    for c in linear:
        out[c] = F.when(F.col("_part") == 0, F.col(c)).otherwise(F.coalesce((F.col(c) + F.col(f"_next_{c}")) / 2.0, F.col(c)))
    res = src.withColumns(out).withColumn(ts, F.timestamp_micros(F.unix_micros(ts) + F.col("_part") * step))
    res = res.select(*keys, ts, *energy, *linear, *labels)
    if cap:
        res = res.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= cap).drop("_i")
    return res


def hold_to_step(df: DataFrame, keys: list[str], ts: str, values: list[str], step: str) -> DataFrame:
    """Finer grid with the last known value held."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    grid = reindex(df.select(*keys, ts, *values), keys, ts, step)
    return grid.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def union_by_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames; the earliest frame wins where several hold a key."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return one_per_slot(out, keys, prefer="_source", earliest=True).drop("_source")


def stitch(late: DataFrame, early: DataFrame, fallback: DataFrame, key: str, ts: str, boundary: str) -> DataFrame:
    """Before the boundary rows of ``early`` (of ``fallback`` for keys absent there), after it rows of ``late``."""
    cut = F.lit(boundary).cast("timestamp")
    known = early.select(key).distinct()
    return (
        early.filter(F.col(ts) < cut)
        .unionByName(fallback.filter(F.col(ts) < cut).join(known, key, "left_anti"))
        .unionByName(late.filter(F.col(ts) >= cut))
    )
