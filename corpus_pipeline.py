"""Corpus pipeline: language, near copies, personal data, packing.

Each stage gets the rows that the stage before it kept, works on all of them, and returns the columns of ``documents``; the
last returns the packed pieces.  Rows with a null text: rejected as of no language.  Equal rows are near copies; one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.llm import langid, minhash, packing, pii
from wattloom.llm.support import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language: texts that are null or without a letter go, all others stay.

    Without any labelled text there is no model; then every text with a letter stays.
    """
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = docs.withColumn("_found", langid.predictor(spark, model)("text"))
    return found.filter(F.col("_found.lang") != langid.UNKNOWN).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id; of rows that share it, one.

    Near copies share at least 80 percent of the union of their five-word shingles (op7 by itself links from 85 on).
    Forty bands of eight hashes miss a pair at exactly 80 percent with a chance of about 0.0006.  Rows without an id are
    kept: they can't be told apart by id.
    """
    found = cut(minhash.near_duplicates(docs, percent=80, bands=40), "pipeline-near")
    ids = cut(found.filter("doc_id is not null").groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("n")).filter("n <> 1"), "pipeline-ids")
    # the ids that go are fewer than those that stay, so the texts seldom have to move
    rest = docs.select(*COLUMNS).join(ids.filter("n = 0").select("doc_id"), "doc_id", "left_anti")
    shared = ids.filter("n > 1").select("doc_id")
    one = rest.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("r")).select("doc_id", "r.*")
    return rest.join(shared, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in angle brackets; n_chars follows the text, untouched texts keep theirs."""
    masked = docs.withColumn("_text", pii.masker(spark, pii.train(docs))("text"))
    changed = ~F.col("text").eqNullSafe(F.col("_text"))
    return masked.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("PII", personal_data), ("best-fit packing", packed)]

#: No stage can be expressed in SQL whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
