"""Near copies of vectors by spherical-cap filters.

Filter directions are a random product code: the rotated space is split into two blocks with a list of random directions
each, and every pair of directions is a filter.  A vector is decoded to all filters whose inner product exceeds the cap's
height, from the sorted scores of its blocks, without a look at the other filters.  Vectors that share a filter are compared
exactly.  Several codes with rotations of their own make a miss unlikely: a pair at cosine 0.95 shares a filter of one code
with a chance of about 0.86 (more when closer), so of six with all but about one in 100,000.

The number of filters grows in proportion to the vectors, so that a vector meets a fixed number of strangers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.components import components
from wattloom.llm.support import cut, map_rows
from wattloom.llm.vectors import valid_vectors

CODES = 6
#: Filters of a code for each vector, and filters that a random vector exceeds on average.
FILTERS_EACH = 64
LIST = 24
#: Members of a group compared in one task; a larger group is split into blocks, and pairs of blocks are tasks.
BLOCK = 1500


@lru_cache(maxsize=32)
def _code(d: int, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation and the two lists of unit directions of a code, from its number."""
    rng = np.random.default_rng((7, d, number))
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    half = (d + 1) // 2
    blocks = [rng.normal(size=(size, w)) for w in (half, d - half) if w]
    return rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in blocks]


def _block_scores(unit: np.ndarray, size: int, number: int) -> list[np.ndarray]:
    rotation, blocks = _code(unit.shape[1], size, number)
    turned, at, out = unit @ rotation, 0, []
    for b in blocks:
        out.append(turned[:, at : at + b.shape[1]] @ b.T / len(blocks) ** 0.5)
        at += b.shape[1]
    return out


@lru_cache(maxsize=32)
def height(d: int, size: int) -> float:
    """Height of the caps such that a random unit vector exceeds LIST filters on average; found by bisection on 200 of them."""
    rng = np.random.default_rng((8, d))
    unit = rng.normal(size=(200, d))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = _block_scores(unit, size, 0)
    second = np.sort(scores[1], axis=1) if len(scores) > 1 else np.zeros((200, 1))
    lo, hi = 0.0, 1.0
    for _ in range(30):
        mid = (lo + hi) / 2
        n = sum(second.shape[1] - np.searchsorted(second[i], mid - scores[0][i]).sum() / len(scores[0][i]) for i in range(200)) * scores[0].shape[1] / 200
        lo, hi = (mid, hi) if n > LIST else (lo, mid)
    return lo


def decode_list(unit: np.ndarray, size: int, number: int) -> list[dict[int, list[int]]]:
    """For each vector its filters, as second directions by first direction."""
    cap = height(unit.shape[1], size)
    scores = _block_scores(unit, size, number)
    out = []
    for i in range(len(unit)):
        first = scores[0][i]
        if len(scores) == 1:
            out.append({int(c): [0] for c in np.flatnonzero(first >= cap)})
            continue
        order = np.argsort(-scores[1][i])
        ranked = scores[1][i][order]
        mine = {}
        for c in np.flatnonzero(first >= cap - ranked[0]):
            mine[int(c)] = order[: np.searchsorted(-ranked, first[c] - cap, side="right")].tolist()
        out.append(mine)
    return out


def _entries(vectors: DataFrame, size: int, codes: int) -> DataFrame:
    """(grp, node, second, vec): a row for each first direction of a vector's filters."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            rows = batch.column(1).to_pylist()
            nodes = batch.column(0).to_pylist()
            for d in sorted(set(map(len, rows))):
                at = [i for i, r in enumerate(rows) if len(r) == d]
                x = np.array([rows[i] for i in at])
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for number in range(codes):
                    for i, u, mine in zip(at, unit, decode_list(unit, size, number), strict=True):
                        raw = u.tobytes()
                        for first, second in mine.items():
                            for values, value in zip(out, ((d * codes + number) * size + first, nodes[i], np.array(second, "<u4").tobytes(), raw), strict=True):
                                values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["grp", "node", "second", "vec"])

        return step

    return map_rows(vectors, make, "grp long, node long, second binary, vec binary")


def _compare(threshold: float):
    def compare(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        node = rows["node"].to_numpy()
        unit = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.float64).reshape(len(node), -1)
        seconds = [np.frombuffer(b, "<u4") for b in rows["second"].to_pylist()]
        names, place = np.unique(np.concatenate(seconds), return_inverse=True)
        held = np.zeros((len(node), len(names)), np.float32)
        held[np.repeat(np.arange(len(node)), [len(s) for s in seconds]), place] = 1
        own = rows["own"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            hit = (held[part] @ held[right].T > 0) & (unit[part] @ unit[right].T >= threshold - 1e-9)
            x, y = np.nonzero(hit)
            x, y = part[x], right[y]
            cos = np.einsum("ij,ij->i", unit[x], unit[y])
            ok = (cos >= threshold) & ((node[x] < node[y]) if i == j else (node[x] != node[y]))
            a.append(np.minimum(node[x[ok]], node[y[ok]]))
            b.append(np.maximum(node[x[ok]], node[y[ok]]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return compare


def linked_pairs(vectors: DataFrame, threshold: float, codes: int = CODES) -> DataFrame:
    """(a, b), a < b: nodes whose vectors share a filter and have at least that cosine; ``vectors`` is (node, embedding)."""
    n = vectors.count()
    size = max(4, int(np.ceil((FILTERS_EACH * max(1, n)) ** 0.5)))
    entries = _entries(vectors, size, codes)
    large = cut(entries.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "cap-large")
    blocks = F.coalesce("k", F.lit(1))
    tiled = entries.join(large, "grp", "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = tiled.select("grp", "i", "j", "own", "node", "second", "vec").groupBy("grp", "i", "j").applyInArrow(_compare(threshold), "a long, b long")
    return found.distinct()


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Equal vectors are one class and count each other as links.  Vectors that are null, zero, or hold null or non-finite
    components, and rows with a null id, have no link; such a row with an id is its own component, one without has a null
    component and is kept.  Rows that share an id but not a vector share that id's component.  Vectors of different length
    are not compared.
    """
    rows = cut(valid_vectors(embeddings), "cap-rows")
    classes = cut(rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "cap-classes")
    pairs = cut(linked_pairs(classes.select("node", "embedding"), threshold), "cap-pairs")
    copies = classes.groupBy("node").agg(F.sum("copies").alias("copies"))
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degrees = both.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("links"))
    labels = components(pairs)
    nodes = copies.join(degrees, "node", "left").join(labels, "node", "left")
    nodes = nodes.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    by_class = classes.select("embedding", "node").join(nodes, "node").select("embedding", "n_links", "component_id")
    # ids of the smallest vec_id of a class are node numbers, so the smallest node of a component is its smallest vec_id
    by_row = cut(rows.join(cut(by_class, "cap-by-class"), "embedding").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "cap-by-row")
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_row, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == F.coalesce("component_id", "vec_id"))).alias("kept"),
    )
