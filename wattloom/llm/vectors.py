"""Vectors as classes of equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(column: Column) -> Column:
    """Not null, not empty, all components finite and some not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def valid_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that have an id and a usable vector; minus zero counts as zero."""
    kept = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return kept.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
