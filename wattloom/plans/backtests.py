"""Backtests whose training never copies rows: Gram sums by block of time, added up along time.

Every row is summed once into the block of its key.  The running sum up to a block is all that a fold which trains up to
there needs, and the difference of two running sums is a window of blocks; so rows read and shuffled for training are the
same for one fold as for a hundred.  Test rows go once into each fold that tests them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattloom.operators.accuracy import point_metrics
from wattloom.operators.frames import ordered
from wattloom.plans import models
from wattloom.session import cut_lineage


def block_sums(df: DataFrame, keys: list[str], blocks: list[str], features: list[str], y: str) -> DataFrame:
    """(keys, blocks, gram): one row per block, written once."""
    rows = df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    return cut_lineage(models.gram_sums(models.with_missing(rows, features), [*keys, *blocks], features, y), "block-sums")


def _size(features: list[str]) -> int:
    return (len(features) + 2) * (len(features) + 3) // 2


def total(sums: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Sum of Gram arrays by key."""
    n = _size(features)
    return sums.groupBy(*keys).agg(*[F.sum(F.col("gram")[i]).alias(f"_g{i}") for i in range(n)]).select(*keys, F.array(*[f"_g{i}" for i in range(n)]).alias("gram"))


def running(sums: DataFrame, keys: list[str], block: str, features: list[str], width: int | None = None) -> DataFrame:
    """Gram array of all blocks up to each block, or of the last ``width`` blocks as a difference of two running sums.

    Blocks of a key are numbered from 0 without gaps.
    """
    n = _size(features)
    w = Window.partitionBy(*keys).orderBy(block)
    upto = sums.select(*keys, block, F.array(*[F.sum(F.col("gram")[i]).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in range(n)]).alias("gram"))
    if width is None:
        return upto
    before = F.lag("gram", width).over(w)
    return upto.withColumn("gram", F.when(before.isNull(), F.col("gram")).otherwise(F.zip_with("gram", before, lambda a, b: a - b)))


def by_day(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Number of each row's day among the days of its key, and how many there are."""
    day = F.date_trunc("day", F.col(ts))
    w = Window.partitionBy(*keys)
    df = df.withColumn("_new", (F.row_number().over(Window.partitionBy(*keys, day).orderBy(ts)) == 1).cast("int"))
    return df.withColumns({"block": (F.sum("_new").over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"), "n_blocks": F.sum("_new").over(w).cast("int")}).drop("_new")


def by_rank(df: DataFrame, keys: list[str], folds: int, first: int, ts: str = "ts") -> DataFrame:
    """Block 0 is the first ``first`` rows; what follows is cut into ``folds`` blocks of equal size, the rest left out."""
    w = Window.partitionBy(*keys)
    rank, size = F.row_number().over(ordered(keys, ts)) - 1, F.floor((F.count("*").over(w) - first) / F.lit(folds))
    df = df.withColumns({"_i": rank, "_size": size}).filter("_size > 0")
    block = F.when(F.col("_i") < first, 0).otherwise(1 + F.floor((F.col("_i") - first) / F.col("_size"))).cast("int")
    return df.withColumns({"block": block, "n_blocks": F.lit(folds + 1)}).filter(F.col("block") <= folds).drop("_i", "_size")


def expanding_folds(sums: DataFrame, keys: list[str], features: list[str], initial: int, step: int, horizon: int, width: int | None = None) -> DataFrame:
    """(keys, fold, gram): what each fold trains on, read off the running sums; a fold exists if its whole horizon does."""
    last = Window.partitionBy(*keys)
    ends = running(sums, keys, "block", features, width).withColumn("_n", F.max("block").over(last) + 1)
    cut = F.col("block") + 1 - initial
    return ends.filter((cut >= 0) & (cut % step == 0) & (F.col("block") + 1 + horizon <= F.col("_n"))).select(*keys, F.floor(cut / step).cast("int").alias("fold"), "gram")


def test_folds(block: Column, blocks: Column, initial: int, step: int, horizon: int) -> Column:
    """The folds that test a block; at most horizon / step, rounded up."""
    first = F.greatest(F.lit(0), F.ceil((block - horizon - initial + 1) / F.lit(step))).cast("int")
    last = F.least(F.floor((block - initial) / F.lit(step)), F.floor((blocks - horizon - initial) / F.lit(step))).cast("int")
    return F.when((block >= initial) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def score_folds(tests: DataFrame, grams: DataFrame, keys: list[str], features: list[str], **limits) -> tuple[DataFrame, DataFrame]:
    """Models of all folds and their scored test rows; ``keys`` include the fold."""
    fitted = cut_lineage(models.solve_sums(grams, keys, features, **limits), "fold-models")
    return fitted, models.score(tests, fitted, keys, features)


def fold_metrics(tests: DataFrame, grams: DataFrame, keys: list[str], features: list[str], y: str, min_train: int = 200, min_test: int = 48, **limits) -> DataFrame:
    """Test metrics by key and fold; folds below the row minimums are left out."""
    fitted, scored = score_folds(tests, grams, keys, features, min_rows=min_train, **limits)
    found = point_metrics(scored.filter("predicted_kwh is not null"), keys, y, "predicted_kwh").withColumnRenamed("n", "n_test")
    return found.filter(F.col("n_test") >= min_test).join(fitted.select(*keys, "n_train"), keys)
