"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the counts by length say all that a packing needs.  They are summed by
Spark; the reduction and the best fit then work on at most ``capacity`` counts and give a list of runs: "so many
sequences, each holding these lengths".  Every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wattloom.llm.support import cut, map_rows
from wattloom.llm.tokens import encoder

#: Ranks within a length are counted in so many parts, so that a frequent length is no single task.
RANK_PARTS = 1024


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    Null text counts as empty: one piece that holds the end id.  Other columns are left behind.  Rows with equal or null
    ids stay rows of their own.
    """

    def make():
        words = encoder(tokenizer, "dropped")
        end = int(end_id).to_bytes(4, "little")
        width = 4 * capacity

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for values, value in zip(out, (doc, piece, at // 4, len(part) // 4, part), strict=True):
                        values.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, piece int, start long, length long, ids binary")


def reduce_dominated(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fix sequences that some best packing must be able to hold; lowers ``counts`` in place.

    ``counts[s]`` is the number of items of length s; the capacity is ``len(counts) - 1``.  A set F with item j dominates
    when any set with j that fits can be exchanged for F, item by item, without a new sequence:

    * nothing fits beside j: F = {j};
    * k, the longest that fits beside j, fills the sequence, or no two others fit, or no three fit and no two others are
      longer than k together: F = {j, k};
    * no three fit, b is the longest beside j and k, and no two that fit are both longer than b: F = {j, k, b}.

    The conditions stay true while items go, so a set is fixed as often as its items last.
    """
    capacity = len(counts) - 1
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*items: int) -> None:
        need = defaultdict(int)
        for s in items:
            need[s] += 1
        times = min(int(counts[s]) // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
        fixed.append((items, times))

    def one_round() -> bool:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                counts[j] -= 1
                present = np.flatnonzero(counts)
                counts[j] += 1
                room = capacity - j
                fitting = [int(s) for s in present[: np.searchsorted(present, room, side="right")]]
                if not fitting:
                    fixed.append(((j,), int(counts[j])))
                    counts[j] = 0
                    changed = True
                    break
                k = fitting[-1]
                smallest: list[int] = []
                for s in fitting[:3]:
                    smallest += [s] * min(3, int(counts[s]) - (s == j))
                    if len(smallest) >= 3:
                        break
                chosen: tuple[int, ...] = ()
                if k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                    chosen = (j, k)
                elif len(smallest) < 3 or sum(smallest[:3]) > room:
                    have = lambda s: int(counts[s]) - (s == j)
                    best = max((x + y for x, y in _best_pairs(fitting, room, have)), default=0)
                    b = next((s for s in reversed(fitting) if s + k <= room and have(s) > (s == k)), 0)
                    if k >= best:
                        chosen = (j, k)
                    elif b and not _two_above(fitting, b, room, have):
                        chosen = (j, k, b)
                if not chosen:
                    break
                fix(*chosen)
                changed = True
        return changed

    while one_round():
        pass
    return fixed


def _best_pairs(sizes: list[int], room: int, have) -> list[tuple[int, int]]:
    """For each size the longest partner that fits with it."""
    out = []
    for x in sizes:
        i = bisect_right(sizes, min(x, room - x)) - 1
        if i >= 0 and sizes[i] == x and have(x) < 2:
            i -= 1
        if i >= 0:
            out.append((x, sizes[i]))
    return out


def _two_above(sizes: list[int], b: int, room: int, have) -> bool:
    """Whether two items, both longer than b, fit into the room."""
    above = [s for s in sizes if s > b][:2]
    if not above:
        return False
    first = above[0]
    return 2 * first <= room if have(first) >= 2 else len(above) > 1 and first + above[1] <= room


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts by length: the fullest sequences that still take an item get it."""
    capacity = len(counts) - 1
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_runs[capacity] = []
    done: list[tuple[tuple[int, ...], int]] = []
    smallest = int(np.flatnonzero(counts)[0]) if counts.any() else 0

    def put(items: tuple[int, ...], bins: int, room: int) -> None:
        (open_runs[room] if room >= smallest else done).append((items, bins))

    for s in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[s])
        for room in sorted(r for r, runs in open_runs.items() if r >= s and runs and r < capacity):
            while left and open_runs[room]:
                items, bins = open_runs[room].pop()
                each = room // s
                full = min(bins, left // each)
                left -= full * each
                rest = bins - full
                if full:
                    put(items + (s,) * each, full, room - each * s)
                if rest and left:  # fewer than would fill one more
                    put(items + (s,) * left, 1, room - left * s)
                    rest, left = rest - 1, 0
                if rest:
                    open_runs[room].append((items, rest))
        each = capacity // s
        if left // each:
            put((s,) * each, left // each, capacity - each * s)
        if left % each:
            put((s,) * (left % each), 1, capacity - (left % each) * s)
    return done + [run for runs in open_runs.values() for run in runs]


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first sequence, items in each, offset) rows that place every item.

    A sequence holds at most sqrt(2 * capacity) different lengths and there are at most a few runs for each length, so the
    plan is bounded by the capacity, whatever the number of items.
    """
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] += n
    runs = reduce_dominated(table)
    runs += best_fit(table)
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for items, bins in runs:
        offset = 0
        by_length: dict[int, int] = {}
        for s in items:
            by_length[s] = by_length.get(s, 0) + 1
        for s, each in by_length.items():
            out.append((s, rank[s], bins * each, sequence, each, offset))
            rank[s] += bins * each
            offset += s * each
        sequence += bins
    return out


def place(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    ``pieces`` is read three times, so pass a written table.  Pieces of equal length are exchangeable: they are ranked in
    ``RANK_PARTS`` parts and take their places in the order of ``order``.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS)).alias("_part")
    keyed = pieces.withColumn("_part", part)
    sizes = keyed.groupBy(F.col(length_col).alias("_length"), "_part").agg(F.count("*").alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("_length").agg(F.sum("_n")).collect()}
    plan = plan_runs(counts, capacity)
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_part")) - F.col("_n")).select(F.col("_length").alias("_l"), F.col("_part").alias("_p"), "_before")
    own = F.row_number().over(Window.partitionBy(length_col, "_part").orderBy(*order)) - 1
    ranked = keyed.withColumn("_own", own)
    ranked = ranked.join(before, (ranked[length_col] == before["_l"]) & (ranked["_part"] == before["_p"])).withColumn("_rank", F.col("_own") + F.col("_before"))
    runs = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "_s long, _first long, _items long, _sequence long, _each long, _offset long")
    hit = (F.col(length_col) == F.col("_s")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_items"))
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(runs), hit)  # bounded by the capacity, see plan_runs
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col(length_col)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place, and the checksum of their ids."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    return place(cut(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), capacity)
