"""Interaction of quality filters: what each removes alone, together and in every order, by the Hart-Mas-Colell potential.

A document is reduced to the set of filters that it fails, documents are counted by part and set, and the removal game of a
part is v(S) = documents that some filter of the coalition S removes, for all 32 coalitions.  Its potential is
P(S) = (v(S) + sum of P(S without i) over i in S) / |S| with P of the empty coalition 0; the Shapley value of a filter is the
grand potential minus the potential without that filter.  60 P is a whole number, so all is exact.  What a filter removes at
a step of an order is a difference of two coalitions.

Defined cases: a null text is empty and has no words; a null part is the empty string.  A row without an id has no smaller
id before it and no label.  Rows that repeat an id count one by one.  A document labelled more than once counts as good or
toxic if any of its labels says so.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.support import cut, map_rows

FILTERS = "ABCDE"
#: The filters that look at one text; the last one looks at all texts.
BY_TEXT = 4
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = re.compile(rb"[A-Z]+")
STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: str, data: bytes) -> int:
    """The filters A to D that a text fails, as bits; ``data`` is the text in UTF-8."""
    words = data.split()  # bytes are split exactly at \x20 and \x09-\x0D
    capitals = sum(map(len, CAPITALS.findall(data)))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | (SIGNS.search(data) is not None) << 3


def _reader() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, digests = [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            data = text.encode()
            masks.append(failed(text, data))
            digests.append(hashlib.sha256(data).digest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return read


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (bits of the failed filters), n, good, toxic: documents counted by part and failures.

    The first of equal texts is found by a map-combined minimum; it is joined by text and id together, so that a text with
    very many copies is spread over all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = cut(map_rows(rows, _reader, "doc_id long, part string, mask int, digest binary"), "audit-rows")
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << BY_TEXT).otherwise(0)
    return seen.groupBy("part", F.col("mask").bitwiseOR(copy).alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """v[S]: documents failing some filter of S, from the documents per set of failures."""
    sets = np.arange(len(counts))
    return np.array([counts[(sets & s) != 0].sum() for s in sets])


def potentials(v: np.ndarray, scale: int) -> list[int]:
    """scale * P(S) for all coalitions; the scale is a multiple of 1 to the number of filters."""
    out = [0] * len(v)
    for s in range(1, len(v)):
        members = [1 << i for i in range(s.bit_length()) if s >> i & 1]
        out[s] = (scale * int(v[s]) + sum(out[s ^ m] for m in members)) // len(members)
    return out


def orders(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """Rows of STEP without the part, for all orders of the filters."""
    size = len(FILTERS)
    v, vg, vt = (removal_game(c) for c in (counts, good, toxic))
    total, grand = int(counts.sum()), len(counts) - 1
    p = potentials(v, 60)
    for order in itertools.permutations(range(size)):
        before = 0
        for step, f in enumerate(order, 1):
            after, bit = before | 1 << f, 1 << f
            removed = int(v[after] - v[before])
            # 120 orders in all: 120 times the Shapley value is twice the difference of the potentials times 60
            yield "".join(FILTERS[i] for i in order), step, total - int(v[after]), removed, int(v[bit]) - removed, int(v[grand] - v[grand ^ bit]), int(vg[after] - vg[before]), int(vt[after] - vt[before]), 2 * (p[grand] - p[grand ^ bit])
            before = after


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see ``STEP``.  A part moves as at most 32 counts."""
    by_part = failures(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, sets in zip(batch["part"], batch["sets"]):
                table = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
                for row in sets:
                    table[:, row["mask"]] = row["n"], row["good"], row["toxic"]
                yield pd.DataFrame([(name, *r) for r in orders(*table)], columns=[c.split()[0] for c in STEP.split(", ")])

    return by_part.mapInPandas(steps, STEP)
