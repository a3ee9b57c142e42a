"""Top-k, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Display order of meter tiers.
TIER_ORDER = ["HT (>5kWh)", "Large (1.5-5k)", "Medium (0.5-1.5k)", "Small (<500)"]


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each key; Spark keeps only n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_meters(df: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col("tier"))
    return df.withColumn("tier_rank", F.when(rank > 0, rank - 1).otherwise(9)).orderBy("tier_rank", "mape", "msn")


def correlation(x: Column, y: Column) -> Column:
    """Correlation of two columns of whole numbers in a group, to 12 digits.

    Sums are exact, so no order of rows turns a covariance of zero, level groups or values that do not vary into noise.
    Not a number where either side does not vary or a pair has a value beyond 10**15; null without pairs.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    fits = [c.between(-(10**15), 10**15) for c in (x, y)]
    far = F.count(F.when(~(fits[0] & fits[1]), 1))
    x, y = (F.when(fit, c).cast("decimal(16,0)") for fit, c in zip(fits, (x, y)))

    def moment(a: Column, b: Column) -> Column:
        return (F.count(x) * F.sum(a * b) - F.sum(a) * F.sum(b)).cast("double")

    spread = F.sqrt(moment(x, x) * moment(y, y))
    return F.when((far > 0) | (spread == 0), F.lit(float("nan"))).when(spread > 0, F.floor(moment(x, y) / spread * 1e12 + 0.5) / 1e12)


def select_features(gains: DataFrame, keys: list[str], keep_min: int = 25, keep_frac: float = 0.55, floor: int = 20) -> DataFrame:
    """The strongest features per key with positive gain; the top ``keep_min`` where too few remain."""
    w = Window.partitionBy(*keys)
    df = gains.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("gain"), F.asc_nulls_last("feature"))), "_n": F.count("*").over(w)})
    hit = (F.col("_r") <= F.greatest(F.lit(keep_min), F.floor(F.col("_n") * keep_frac))) & (F.col("gain") > 0)
    df = df.withColumn("_hit", hit).withColumn("_k", F.sum(F.col("_hit").cast("int")).over(w))
    return df.filter(F.when(F.col("_k") < floor, F.col("_r") <= keep_min).otherwise(F.col("_hit"))).drop("_r", "_n", "_hit", "_k")
