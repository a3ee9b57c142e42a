"""The maximum-entropy model learns from all texts and all words."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from wattloom.llm import maxent


def test_rare_words_have_histories_and_are_predicted(spark):
    """2000 pairs of words of about three texts each: held-out texts of a pair score above those of a mixed one."""
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2][:2000]
    rows = [(i, f"key{i % 2000} answer{i % 2000}") for i in range(8000) if zlib.crc32(str(i).encode()) % 7 != 2]
    probes = {d: (k // 2, (k // 2 + k % 2) % 2000) for k, d in enumerate(held)}
    rows += [(d, f"key{x} answer{y}") for d, (x, y) in probes.items()]
    means = {True: [], False: []}
    for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).filter("held_out").collect():
        x, y = probes[r.doc_id]
        means[x == y].append(r.score)
    assert len(means[True]) == len(means[False]) == 1000
    assert np.mean(means[True]) > np.mean(means[False]) + 0.2


def test_a_round_sums_all_texts(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(0, 12)))) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    start, _ = maxent.train(docs, rounds=0)
    model, _ = maxent.train(docs, rounds=1)
    g = np.zeros_like(start.weights)
    _, lengths, ids, _, hashes = maxent._batch_ids(start, [t.encode() for _, t in rows])
    start.add_gradient(g, ids, lengths, hashes)
    assert lengths.sum() == start.total and start.rare > 2900
    assert np.allclose(model.weights, maxent.STEP * g / np.sqrt(1 + g * g), atol=1e-4)


def test_buckets_of_rare_words_are_sparks(spark):
    words = [f"wörd{i}".encode() for i in range(50)]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select(F.xxhash64("w").bitwiseAND(F.lit(15).cast("long"))).collect()
    assert [r[0] for r in got] == maxent._buckets(words, 16).tolist()


def test_tree_is_a_distribution_over_leaves():
    rng = np.random.default_rng(0)
    for n in (1, 2, 16, 17, 500):
        mass = rng.integers(1, 1000, n).astype(float)
        first, node, child, bias = maxent._tree(mass)
        logs = np.add.reduceat(bias[node, child].astype(float), first[:-1])
        assert np.allclose(np.exp(logs), mass / mass.sum(), rtol=1e-3)


def test_each_text_gives_its_gradient_once_in_a_fit(spark):
    """Rounds take disjoint parts of all texts; copies of a text under other ids fall to several rounds."""
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(0, 12)))) for i in range(1500)] + [(i, None if i % 2 else "w1 w2 w3") for i in range(1500, 1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    model, _ = maxent.train(docs, rounds=0)
    parts, squares, tokens = {}, np.ones_like(model.weights), 0
    for r in docs.withColumn("part", F.expr("pmod(xxhash64(doc_id, text), 4)")).collect():
        parts.setdefault(r.part, []).append(r.text and r.text.encode())
    assert sorted(parts) == [0, 1, 2, 3] and sum(map(len, parts.values())) == 1700
    assert all(b"w1 w2 w3" in p for p in parts.values())
    for part in range(4):
        g = np.zeros_like(model.weights)
        _, lengths, ids, _, hashes = maxent._batch_ids(model, parts[part])
        model.add_gradient(g, ids, lengths, hashes)
        squares += g * g
        model.weights += np.float32(maxent.STEP) * g / np.sqrt(squares)
        tokens += int(lengths.sum())
    assert tokens == model.total
    assert np.allclose(maxent.train(docs, rounds=4)[0].weights, model.weights, atol=1e-4)
