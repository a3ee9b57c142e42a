"""Near copies by MinHash bands, sequential Bayesian pruning and an exact check on full shingle sets.

Equal sets are one class from the start.  The members of a band bucket are first compared with one pivot of the bucket, by
random choice in each; what that links is one component, and later rounds compare only members of different components.  The
last round looks at every pair of a bucket that is still apart, in blocks whose pruned pairs never become rows, so no link
between different sets that share a bucket is lost, while a bucket of near copies makes about as many rows as it has members.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.components import components
from wattloom.llm.support import cut, map_rows, prepare, take_memory

WORDS = 5
BANDS = 25
ROWS = 8
#: Hashes compared before the posterior is looked at again.
BATCH = 20
#: A candidate is pruned when the probability that it is similar enough is below this.
MISS = 1e-5
PIVOT_ROUNDS = 1
#: Members of a bucket compared in one task of the last round, and their shingles; a larger bucket is split, and pairs of
#: blocks are tasks.
BLOCK = 1000
BLOCK_SHINGLES = 2_000_000
#: Pairs whose bands are compared at once.
PAIRS = 4096
#: Words remembered by a worker.
WORDS_KEPT = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHash()


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle, one without words has none."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    tokens = raw.lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, n)
    size = min(n, words)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = _scramble(out * _MIX2 + h[k : n - size + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=4)
def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(hashes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Smallest value of each hash function over a set, 32 bits each."""
    a, b = _family(count)
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        best = np.minimum(best, (hashes[at : at + 512, None] * a + b).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), sig (16 bits a hash), bands (hashes with their number)."""

    def make():
        take_memory("minhash", _HASHES.clear)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, nodes, sigs, keys = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                own = shingles(text, words)
                sizes.append(len(own))
                if not len(own) or doc is None:
                    nodes.append(None)
                    sigs.append(None)
                    keys.append(None)
                    continue
                nodes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                sig = signature(own, bands * rows)
                sigs.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for part in sig.reshape(bands, rows).T:
                    key = _scramble(key * _MIX2 + part.astype(np.uint64))
                keys.append(key.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "sig", "bands"]
            )

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, node long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, hashes (binary) of the sets of documents."""

    def make():
        take_memory("minhash", _HASHES.clear)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = [shingles(t, words).tobytes() for t in pc.cast(batch.column(0), pa.binary()).to_pylist()]
            nodes = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raws]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], ["node", "hashes"])

        return step

    return map_rows(docs.select("text"), make, "node long, hashes binary")


def least_matches(threshold: float, batch: int, batches: int, miss: float) -> np.ndarray:
    """Least equal hashes after each batch with which a pair stays.

    With an even prior on the similarity s and m of n hashes equal, s has a Beta(m + 1, n - m + 1) posterior, and
    P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for k in range(1, batches + 1):
        n, total, m = k * batch, 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return np.array(out)


def _likely(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of signatures are not pruned; only those left go into the next batch of hashes."""
    stay, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k in range(len(need)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (left[x[stay], at] == right[y[stay], at]).sum(1)
        ok = equal >= need[k]
        stay, equal = stay[ok], equal[ok]
    return stay


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < percent * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of both nodes."""
    for end in ("a", "b"):
        pairs = pairs.join(values.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    @F.arrow_udf("boolean")
    def links(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)], pa.bool_())

    return _with_both(pairs, sets, "hashes").filter(links("hashes_a", "hashes_b")).select("a", "b")


def _block_links(apart: DataFrame, involved: DataFrame, sets: DataFrame, percent: int, need: np.ndarray) -> DataFrame:
    """(a, b): the links of each bucket between components; ``apart`` is (bucket, node, comp, k).

    A pair is looked at in the first bucket that its nodes share.  Rows carry half of each hash; what is within a hundredth of
    similar enough by these goes to the exact check.
    """

    def compare(rows: pa.Table) -> pa.Table:
        i, j, bucket = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["bucket"][0].as_py()
        node, comp, own = (rows[c].to_numpy() for c in ("node", "comp", "own"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(len(node), -1)
        bands = np.array(rows["bands"].to_pylist(), np.int64)
        hashes = [np.frombuffer(b, np.uint32) for b in rows["halves"].to_pylist()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out: tuple[list[int], list[int]] = ([], [])
        for at in range(0, len(left), 128):
            part = left[at : at + 128]
            x, y = np.nonzero(comp[part][:, None] < comp[right] if i == j else comp[part][:, None] != comp[right])
            x, y = part[x], right[y]
            stay = _likely(sig, sig, x, y, need)
            x, y = x[stay], y[stay]
            for cut_at in range(0, len(x), PAIRS):
                u, v = x[cut_at : cut_at + PAIRS], y[cut_at : cut_at + PAIRS]
                first = bands[u, (bands[u] == bands[v]).argmax(1)] == bucket
                for a, b in zip(u[first].tolist(), v[first].tolist(), strict=True):
                    if _similar(hashes[a], hashes[b], percent - 1):
                        out[0].append(min(node[a], node[b]))
                        out[1].append(max(node[a], node[b]))
        return pa.table([pa.array(v, pa.int64()) for v in out], ["a", "b"])

    @F.arrow_udf("binary")
    def halves(x: pa.Array) -> pa.Array:
        return pa.array([np.unique((np.frombuffer(b.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for b in x], pa.binary())

    tiled = apart.join(involved.select("node", "sig", "bands"), "node").join(sets.select("node", halves("hashes").alias("halves")), "node")
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiled = tiled.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("bucket", "i", "j", "own", "node", "comp", "sig", "bands", "halves")
    close = cut(tiled.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long"), "minhash-close")
    return _exact_links(close, sets, percent)


def _pair_links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, need: np.ndarray) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; pruned by signature, then compared exactly."""

    @F.arrow_udf("boolean")
    def may_link(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(v.to_pylist()), "<u2").reshape(len(v), -1) for v in (x, y))
        keep = np.zeros(len(x), bool)
        keep[_likely(left, right, np.arange(len(x)), np.arange(len(x)), need)] = True
        return pa.array(keep)

    return _exact_links(cut(_with_both(pairs, sigs, "sig").filter(may_link("sig_a", "sig_b")).select("a", "b"), "minhash-likely"), sets, percent)


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked.  component_id is the smallest
    doc_id of the component and kept is true for its document.  A text that is null or has no words links with nothing.  A
    row with a null id links with nothing, has a null component_id and is kept.  Rows that share an id stay rows of their own.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(docs, words, bands, rows), "minhash-signed")
    classes = cut(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "minhash-classes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "minhash-buckets")
    members = cut(entries.join(shared, "bucket"), "minhash-members")
    involved = cut(classes.join(members.select("node").distinct(), "node", "left_semi"), "minhash-involved")
    sets = cut(shingle_sets(docs.join(involved.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), words).groupBy("node").agg(F.first("hashes").alias("hashes")), "minhash-sets")
    sigs = involved.select("node", "sig")
    need = least_matches(percent / 100, BATCH, max(1, bands * rows // BATCH), miss)

    links: DataFrame | None = None
    placed = members.withColumn("comp", F.col("node"))
    for k in range(PIVOT_ROUNDS + 1):
        if k < PIVOT_ROUNDS:
            order = F.xxhash64("node", "bucket", F.lit(k))
            pivots = placed.groupBy("bucket").agg(F.min_by(F.struct("node", "comp"), order).alias("p"))
            pivots = cut(pivots.select("bucket", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp")), "minhash-pivots")
            pairs = placed.join(pivots, "bucket").filter("comp <> pivot_comp").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            found = _pair_links(cut(pairs.distinct(), "minhash-pairs"), sigs, sets, percent, need)
        else:  # buckets of more than a pivot and one other whose members are still in several components
            sizes = placed.join(involved.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
            still_open = cut(sizes.filter("lo <> hi and n > 2").select("bucket", blocks.alias("k")), "minhash-open")
            found = _block_links(placed.join(still_open, "bucket"), involved, sets, percent, need)
        found = cut(found, "minhash-links")
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links), "minhash-labels")
        if k < PIVOT_ROUNDS:
            placed = cut(members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp")), "minhash-placed")

    nodes = cut(classes.select("node", "doc").join(labels, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("comp")), "minhash-nodes")
    firsts = cut(nodes.groupBy("comp").agg(F.min("doc").alias("component_id")), "minhash-firsts")
    of_node = cut(nodes.join(firsts, "comp").select("node", "component_id"), "minhash-of-node")
    out = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
