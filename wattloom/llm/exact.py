"""Exact dedup against a persistent index of digests, by DataFrame functions only.

The index is a table of one row per distinct text, bucketed and sorted by the SHA-256 digest of the text.  New data is
reduced to one row per digest before anything moves, set against the index by a sort-merge anti-join that shuffles the new
data alone, and what is left is appended.  Texts themselves never move.

Defined cases: a null text counts as empty, and empty texts equal one another.  The row with the largest id of a batch stays;
texts that the index already holds stay with the id it holds, so a batch that is given twice changes nothing.  Rows that
repeat both id and text count one by one, and each is marked as its group says.  Rows without an id never win over rows with
one; in a group without any id ``keep_id`` is null and every row is kept.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.llm.support import cut, new_folder

#: Buckets of a new index: one for so many rows of its first data, and at least so many.
BUCKET_ROWS = 1 << 20
BUCKETS_LEAST = 32
#: A group above one part in so many of the rows is hot; there are at most so many such groups (48 bytes each).
HOT_PARTS = 10_000


def open_index(spark: SparkSession, folder: str, buckets: int = BUCKETS_LEAST) -> str:
    """Register the index in ``folder`` with this session, creating it if it is new; returns its table name.

    The number of buckets belongs to the index: an existing one keeps its own.
    """
    try:
        buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    except AnalysisException:
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    name = f"digest_index_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}/digests'")
    return name


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, written once."""
    return cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")), "digests")


def ingest(index: str, rows: DataFrame) -> None:
    """Append the digests of a batch that the index does not hold."""
    known = rows.sparkSession.table(index)
    batch = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    batch.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id").write.insertInto(index)


def resolve(index: str, rows: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of rows whose digests are in the index.

    Groups are sized by a map-combined count.  Groups of more than one part in ``hot_parts`` of the rows, of which there can
    be no more than that many, are broadcast, so that their rows stay where they are; all others go by a shuffled join.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = cut(sizes.join(spark.table(index).hint("merge"), "digest"), "digest-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * F.lit(hot_parts) > F.lit(total)
    hot = F.broadcast(groups.filter(is_hot))
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(~is_hot).hint("merge"), "digest"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Dedup a whole table so that the largest id of equal texts stays, by way of the index in ``folder`` (a new one by default).

    The index keeps what came first; therefore the upper half of the ids goes in before the lower half and the rows
    without an id.
    """
    spark = docs.sparkSession
    rows = digests(docs)
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).first()
    index = open_index(spark, folder or new_folder(spark, "digest-index"), max(BUCKETS_LEAST, ends.rows // BUCKET_ROWS))
    if ends.low is not None:
        middle = (ends.low + ends.high) // 2
        ingest(index, rows.filter(F.col("doc_id") > middle))
        ingest(index, rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= middle)))
    else:
        ingest(index, rows)
    return resolve(index, rows)
