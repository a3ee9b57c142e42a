"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Each shard's vectors are inserted in batches.  A greedy search from the shard's centre proposes neighbours; going from the
nearest on, a neighbour is kept unless one kept before is nearer to it by the slack factor, which leaves diverse edges.
Reverse edges are added and pruned alike.  Queries run a beam search in every shard, and the best of all shards remain.

Inner products become distances by one more coordinate that brings all vectors to the same length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wattloom.llm.support import OneFile, cut, new_folder, open_store, prepare
from wattloom.llm.vectors import valid_vectors

SHARD_ROWS = 4096
DEGREE = 40
BUILD_BEAM = 64
SEARCH_BEAM = 80
SLACK = 1.15
#: Queries that one task searches in a shard, and that move through the graph together.
QUERY_BLOCK = 2048
STEP = 256


class Graph:
    """Vectors of a shard (float32, equal lengths) and their out-edges, padded with -1."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.vectors, self.edges, self.start = vectors, edges, start

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances of the beam of each query, nearest first; -1 where there are fewer."""
        q, v = len(queries), self.vectors
        ids = np.full((q, beam), -1, np.int64)
        dist = np.full((q, beam), np.inf, np.float32)
        done = np.zeros((q, beam), bool)
        ids[:, 0] = self.start
        dist[:, 0] = ((queries - v[self.start]) ** 2).sum(1)
        rows = np.arange(q)
        while True:
            open_dist = np.where(done | (ids < 0), np.inf, dist)
            pick = open_dist.argmin(1)
            live = np.flatnonzero(np.isfinite(open_dist[rows, pick]))
            if not len(live):
                return ids, dist
            done[live, pick[live]] = True
            near = self.edges[ids[live, pick[live]]].astype(np.int64)
            new = near >= 0
            new &= ~(near[:, :, None] == ids[live][:, None, :]).any(2)
            d = v[near] - queries[live][:, None, :]
            d = np.where(new, np.einsum("qrd,qrd->qr", d, d), np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(new, near, -1)], 1)
            all_dist = np.concatenate([dist[live], d], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            dist[live] = np.take_along_axis(all_dist, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Out-edges of points from candidate nodes (-1: none), both by rows."""
    d = vectors[candidates] - vectors[points][:, None, :]
    dist = np.where((candidates < 0) | (candidates == points[:, None]), np.inf, np.einsum("qkd,qkd->qk", d, d))
    order = np.argsort(dist, axis=1)[:, : 3 * degree]
    cand, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    own = vectors[cand]
    square = np.einsum("qkd,qkd->qk", own, own)
    between = square[:, :, None] + square[:, None, :] - 2 * np.einsum("qkd,qjd->qkj", own, own, optimize=True)
    alive = np.isfinite(dist)
    same = cand[:, 1:] == cand[:, :-1]
    alive[:, 1:] &= ~same
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = cand[rows, first][ok]
        alive &= slack**2 * between[rows, first] > dist
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK, seed: int = 3) -> Graph:
    """Insert all vectors in random order, in batches that at most double the graph."""
    n = len(vectors)
    start = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin()) if n else 0
    graph = Graph(vectors, np.full((n, degree), -1, np.int32), start)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(np.int64) if n else order
    at = 1
    while at < n:
        batch = order[at : at + min(at, STEP)]
        near, _ = graph.search(vectors[batch], beam)
        if at < 2 * beam:  # a small graph may not reach all of itself yet
            near = np.concatenate([near, np.tile(order[:at], (len(batch), 1))], 1)
        _insert(graph, batch, np.concatenate([near, graph.edges[batch].astype(np.int64)], 1), slack)
        at += len(batch)
    return graph


def _insert(graph: Graph, batch: np.ndarray, candidates: np.ndarray, slack: float) -> None:
    degree = graph.edges.shape[1]
    graph.edges[batch] = robust_prune(graph.vectors, batch, np.sort(candidates, 1), degree, slack)
    source = np.repeat(batch, degree)
    target = graph.edges[batch].ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, first, counts = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(heads), STEP):
        h, f, c = heads[lo : lo + STEP], first[lo : lo + STEP], counts[lo : lo + STEP]
        extra = np.full((len(h), int(c.max())), -1, np.int64)
        for i in range(len(h)):
            extra[i, : c[i]] = source[f[i] : f[i] + c[i]]
        both = np.concatenate([graph.edges[h].astype(np.int64), extra], 1)
        full = (both >= 0).sum(1) > degree
        if full.any():
            graph.edges[h[full]] = robust_prune(graph.vectors, h[full], np.sort(both[full], 1), degree, slack)
        for i in np.flatnonzero(~full):
            kept = np.unique(both[i][both[i] >= 0])
            graph.edges[h[i], : len(kept)] = kept


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that all rows have the length ``longest``."""
    rest = np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def write_index(embeddings: DataFrame, folder: str, keep: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, float]:
    """Build and write a graph file for each shard; returns the table of files and the greatest length of a vector.

    Equal vectors are one node, which keeps the ``keep`` smallest of their ids: no more can be among the nearest
    ``keep - 1`` of a query, ties going to the smaller id.
    """
    prepare(embeddings.sparkSession)
    rows = valid_vectors(embeddings)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))  # Spark keeps the first of each task before it deals them out
    nodes = rows.withColumn("_rank", first).filter(F.col("_rank") <= keep).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.select("ids", "embedding", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("len")), "graph-nodes")
    count, longest = nodes.agg(F.count("*"), F.max("len")).first()
    shards = max(1, -(-int(count) // shard_rows))

    def make_shard(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        x = np.array(rows["embedding"].to_pylist())
        g = build(_lifted(x, longest))
        ids = rows["ids"].to_pylist()
        out = OneFile(folder, name := f"shard-{shard:08d}.graph")
        ends = np.cumsum([len(i) for i in ids])
        out.write(np.array([*x.shape, g.edges.shape[1], g.start, ends[-1]], "<i8").tobytes())
        for part in (x.astype("<f8"), g.edges.astype("<i4"), ends.astype("<i8"), np.concatenate([np.array(i, "<i8") for i in ids])):
            out.write(part.tobytes())
        out.close()
        return pa.table({"shard": pa.array([shard], pa.int32()), "file": [name], "nodes": pa.array([len(ids)], pa.int64())})

    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return cut(sharded.groupBy("shard").applyInArrow(make_shard, "shard int, file string, nodes long"), "graph-files"), float(longest or 0.0)


def _read_shard(folder: str, name: str, longest: float) -> tuple[np.ndarray, Graph, np.ndarray, np.ndarray]:
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/{name}") as source:
        raw = source.readall()
    n, d, degree, start, n_ids = np.frombuffer(raw, "<i8", 5)
    at = 40
    x = np.frombuffer(raw, "<f8", n * d, at).reshape(n, d)
    at += 8 * n * d
    edges = np.frombuffer(raw, "<i4", n * degree, at).reshape(n, degree)
    at += 4 * n * degree
    ends = np.frombuffer(raw, "<i8", n, at)
    return x, Graph(_lifted(x, longest), edges, int(start)), ends, np.frombuffer(raw, "<i8", n_ids, at + 8 * n)


def search_index(files: DataFrame, folder: str, longest: float, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates found with the largest inner product, in double precision.

    ``queries`` is (query_id, embedding).  Rows with the query's id are no candidates.  Blocks of queries meet all shards.
    """
    spark = files.sparkSession
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def search(rows: pa.Table) -> pa.Table:
        x, graph, ends, ids = _read_shard(folder, rows["file"][0].as_py(), longest)
        own = rows["query_id"].to_numpy()
        q = np.array(rows["embedding"].to_pylist())
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), STEP):
            part = q[at : at + STEP]
            scale = longest / np.linalg.norm(part, axis=1, keepdims=True)  # a query's length changes no order
            near, _ = graph.search(np.concatenate([part * scale, np.zeros((len(part), 1))], 1).astype(np.float32), max(beam, k + 1))
            score = np.einsum("qkd,qd->qk", x[near], part)
            score[near < 0] = -np.inf
            for i in range(len(part)):
                order = np.argsort(-score[i], kind="stable")
                # ties of the last place stay, so that the smaller ids win
                last = score[i][order[min(k, len(order) - 1)]]
                found = [(s, int(v)) for s, node in zip(score[i][order], near[i][order], strict=True) if node >= 0 and s >= last for v in ids[ends[node - 1] if node else 0 : ends[node]] if v != own[at + i]]
                for s, v in sorted(found, key=lambda t: (-t[0], t[1]))[:k]:
                    for values, value in zip(out, (int(own[at + i]), v, float(s)), strict=True):
                        values.append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    shards = [r[0] for r in files.select("shard").collect()]
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.array(*map(F.lit, shards)) if len(shards) < 1000 else F.sequence(F.lit(0), F.lit(max(shards)))))
    found = dealt.join(files, "shard").groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search for the rows whose vec_id is divisible by ``every`` among all rows.

    Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part; a query row
    that is repeated counts once.  All vectors must have one length.
    """
    folder = new_folder(embeddings.sparkSession, "graph")
    files, longest = write_index(embeddings, folder, k + 1)
    queries = valid_vectors(embeddings).filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    return search_index(files, folder, longest, queries, k)
