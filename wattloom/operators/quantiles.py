"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from wattloom.session import cut_lineage

#: Accuracy of the approximate ranks that bracket a wanted rank, and half the width of the bracket as a share of the rows.
ACCURACY = 20_000
SPREAD = 2e-4
#: Rows of a group below which one place may be wider than the bracket; its whole range is the bracket.
NARROW_ROWS = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], materialised: bool = False, accuracy: int = ACCURACY, spread: float = SPREAD, narrow_rows: int = NARROW_ROWS) -> DataFrame:
    """Linearly interpolated quantiles per key, equal to ``percentile``.

    ``percentile`` holds every distinct value of a group in one task.  Here ``percentile_approx``, whose ranks are off by at
    most rows / accuracy, brackets each wanted rank.  One more aggregate, combined on the map side, counts the rows below
    each bracket and the copies of each value inside, and only the values inside are ordered: ``2 * spread`` of the distinct
    values of a group.  The input is written once because two passes read it.
    """
    if spread * accuracy < 2:
        raise ValueError("the bracket must be wider than the error of the approximate ranks")
    names = list(probs)
    df = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # a column for the rows without keys that the optimiser does not take for a constant, so that brackets meet rows by a key
    base = (df if materialised else cut_lineage(df, "quantile-input")).withColumn("_k", F.pmod(F.xxhash64("_v"), F.lit(1)))
    group = [*keys, "_k"]
    borders = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-spread, spread)]
    stats = base.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", borders, accuracy).alias("_q"))
    whole = F.col("_n") < narrow_rows

    def bracket(i: int, p: float):
        low = F.when(whole | F.lit(p <= spread), F.col("_lo")).otherwise(F.col("_q")[2 * i])
        high = F.when(whole | F.lit(p >= 1 - spread), F.col("_hi")).otherwise(F.col("_q")[2 * i + 1])
        return F.struct(F.lit(names[i]).alias("name"), F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high"))

    brackets = stats.select(*[F.col(k).alias(f"_i{k}") for k in group], "_n", F.array(*[bracket(i, p) for i, p in enumerate(probs.values())]).alias("_b"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_i{k}")) for k in group])
    rows = base.join(brackets, same).select(*group, "_n", "_v", F.explode("_b").alias("_b")).filter(F.col("_v") <= F.col("_b.high"))
    inside = F.when(F.col("_v") >= F.col("_b.low"), F.col("_v"))  # null: somewhere below the bracket
    counts = rows.groupBy(*group, "_n", F.col("_b.name").alias("name"), F.col("_b.p").alias("_p"), inside.alias("_x")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group, "name").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.col("_p")
    holds = lambda rank: (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
    found = counts.withColumn("_upto", upto).withColumn("_place", place).filter("_x is not null")
    low, high = F.max(F.when(holds(F.floor("_place")), F.col("_x"))), F.max(F.when(holds(F.ceil("_place")), F.col("_x")))
    point = found.groupBy(*group, "name").agg((low + (high - low) * F.max(F.col("_place") - F.floor("_place"))).alias("_q"))
    return point.groupBy(*group).pivot("name", names).agg(F.max("_q")).drop("_k")


def attach_quantiles(df: DataFrame, summarise, keys: list[str], value: str, probs: dict[str, float], materialised: bool = False) -> DataFrame:
    """``summarise(rows)`` by key with exact quantiles added; both read one materialised input."""
    rows = df if materialised else cut_lineage(df, "summary-input")
    q = exact_quantiles(rows, keys, value, probs, materialised=True)
    if keys:
        return summarise(rows).join(q, keys, "left")
    return merge_single_rows(summarise(rows), q)


def merge_single_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames side by side."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
