"""Runs, filter audit and exact dedup against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests_llm_fixtures import CLASH, documents, empty_documents, texts

from wattloom.llm import audit, exact, repeats
from wattloom.llm.support import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) of all runs of at least two periods, one distance at a time."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def odd_words(rnd):
    root = [rnd.randrange(2) for _ in range(rnd.randrange(1, 5))]
    block = [rnd.randrange(3) for _ in range(rnd.randrange(1, 90))]
    broken = (block * 40)[: rnd.randrange(400)]
    for _ in range(rnd.randrange(4) if broken else 0):
        broken[rnd.randrange(len(broken))] = 9
    inner = (root * 90)[: rnd.randrange(20, 150)]
    return [
        [rnd.randrange(2) for _ in range(rnd.randrange(300))], fibonacci(rnd.randrange(1, 400)), broken, [0] * rnd.randrange(300),
        [x for _ in range(rnd.randrange(1, 6)) for x in (root * 60)[: rnd.choice([30, 60, 61, 97, 119])]], (inner * 4)[: 2 * len(inner) - 2 + rnd.randrange(2 * len(inner))],
        repeats.planted([rnd.randrange(60) for _ in range(rnd.randrange(300))], 10 * rnd.randrange(10**6)), [], [1],
    ]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    docs = [d for _ in range(3) for d in odd_words(rnd)]
    got = repeats.all_runs([np.array(d, dtype=np.int64) for d in docs]).tolist()
    assert got == [[i, *r] for i, d in enumerate(docs) for r in brute_runs(d)]


def test_synchronised_positions_are_dense_and_consistent():
    rnd = random.Random(3)
    w = [rnd.randrange(3) for _ in range(600)]
    w[300:420] = ([0, 1, 2, 2, 1] * 24)
    text = repeats.Layout([np.array(w)], 1)
    runs = repeats.all_runs([np.array(w)])
    runs = np.column_stack([runs[:, 1], runs[:, 1] + runs[:, 2], runs[:, 3]])
    for t in (4, 8, 16):
        chosen = set(repeats.synchronised(text.names[t.bit_length() - 1][: len(w) - t + 1], t, runs).tolist())
        by_context = {}
        for i in range(len(w) - 2 * t + 1):
            assert by_context.setdefault(tuple(w[i : i + 2 * t]), i in chosen) == (i in chosen)
        for i in range(len(w) - 3 * t + 2):
            part = w[i : i + 3 * t - 1]
            low = any(part[:-p] == part[p:] for p in range(1, t // 3 + 1))
            assert low == (not chosen & set(range(i, i + t)))


def test_equal_names_of_unlike_windows_are_noticed(monkeypatch):
    """With names of two bits nearly all windows seem equal at first; other salts follow until every run holds word by word."""
    mix, calls = repeats._mix, []

    def poor(x, y):
        calls.append(int(y[0]))
        return mix(x, y) % np.uint64(2) if 1 in calls and calls.count(2) == 0 else mix(x, y)

    monkeypatch.setattr(repeats, "_mix", poor)
    w = [random.Random(5).randrange(9) for _ in range(200)] + list(range(100, 130)) * 3
    assert repeats.all_runs([np.array(w)])[:, 1:].tolist() == [list(r) for r in brute_runs(w)]


def expected_row(doc_id, text):
    words = repeats.planted(WORD.findall(text or ""), doc_id)
    runs = [r for r in brute_runs(words) if r[1] >= 12]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_rows_of_odd_documents(spark):
    rows = [(d, t) for d, t, _ in texts() if d not in (103, 104)]  # 30 000 words are too many for brute force
    rows += [(d, " ".join(f"w{random.Random(d).randrange(40)}" for _ in range(1 + d % 90))) for d in range(1000, 1200)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, period int").repartition(5)
    got = repeats.find_runs(df, repeats.planted).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected_row(*r)) for r in rows)
    assert repeats.find_runs(empty_documents(spark)).collect() == []


def test_runs_of_very_long_documents_and_many_chunks(spark, monkeypatch):
    """A period of 9 000 words, a run across half a text, and more words than one layout takes."""
    monkeypatch.setattr(repeats, "CHUNK_WORDS", 5000)
    rnd = random.Random(8)
    block = [f"w{rnd.randrange(10**6)}" for _ in range(9000)]
    docs = [block * 3, ["a", "b"] * 12000 + block[:500], block[:4000], block[4000:8100] * 2]
    find = repeats._finder(lambda words, _: words)
    import pyarrow as pa

    got = find(pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4), pa.int64()), "text": [" ".join(d) for d in docs]})).to_pylist()
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in got] == [(1, 0, 27000, 9000), (1, 0, 24000, 2), (0, None, None, None), (1, 0, 8200, 4100)]


def brute_audit(rows, labels):
    """All orders, one document at a time."""
    seen, fails = {}, []
    for d, t, _ in rows:
        if d is not None:
            seen[t or ""] = min(seen.get(t or "", d), d)
    for d, t, lang in rows:
        text = t or ""
        w = WORD.findall(text)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and seen[text] < d}
        fails.append((lang or "", {k for k, v in f.items() if v}, *labels.get(d, (0, 0))))
    out, removed_by = [], Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                removed_by[part, x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = texts()
    for d in range(200, 400):
        n = rnd.choice([3, 150, 250, 400])
        rows.append((d, " ".join(rnd.choice(["Ab", "word", "x#y", "é"]) + str(rnd.randrange(rnd.choice([20, 900]))) for _ in range(n)), rnd.choice(["en", "fr", None])))
    rows += [(d, rows[-1][1], "fr") for d in (450, 430, 440)]
    labels = {d: (rnd.randrange(2), rnd.randrange(2)) for d, _, _ in rows if d is not None and d % 3}
    table = [(d, *v) for d, v in labels.items()] + [(200, None, 1), (None, 1, 1)] + [(450, 1, 1)] * 2
    labels[450], labels[200] = (1, 1), (labels.get(200, (0, 0))[0], 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *CLASH.replace("1 as bucket", "1 as mask, 2 as good, 3 as digest").split(", ")[:-1]).repartition(5)
    got = audit.interactions(df, spark.createDataFrame(table, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert audit.interactions(empty_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_potential_of_a_small_game():
    """Glove game: filters 0 and 1 alone remove 1, together 3: potentials 1/1, 1/1 and (3 + 2) / 2."""
    assert audit.potentials(np.array([0, 1, 1, 3]), 2) == [0, 2, 2, 5]


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        keep = max((x for x in groups[t or ""] if x is not None), default=None)
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_equals_brute_force(spark):
    rows = [r[:2] for r in texts()] + [(1000 + i, "one very common text") for i in range(300)] + [(2000 + i, f"pair {i // 2}") for i in range(50)] + [(None, "no id")] * 2 + [(-5, "pair 3")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, keep_id int").repartition(7)
    want = brute_exact(rows)
    assert sorted(map(str, map(tuple, exact.deduplicate(df).collect()))) == want
    for hot in (3, 10**9):  # nearly all groups by the shuffled join, all by the broadcast
        index = exact.open_index(spark, new_folder(spark, "index"), 4)
        hashed = exact.digests(df)
        exact.ingest(index, hashed)
        assert sorted(map(str, map(tuple, exact.resolve(index, hashed, hot).collect()))) == want
    assert exact.deduplicate(empty_documents(spark)).collect() == []
    nameless = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.group_size for r in exact.deduplicate(nameless).filter("kept").collect()) == [1, 2, 2]


def test_index_outlives_its_session_and_takes_each_text_once(spark):
    folder = new_folder(spark, "index")
    batch = lambda rows: exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact.open_index(spark, folder, 4)
    exact.ingest(index, batch([(1, "a"), (2, "b"), (3, "a")]))
    spark.sql(f"DROP TABLE {index}")  # the files stay, as after the end of a session
    assert exact.open_index(spark, folder, 64) == index
    assert spark.sql(f"DESCRIBE FORMATTED {index}").filter("col_name = 'Num Buckets'").first()["data_type"] == "4"
    later = batch([(9, "a"), (8, "c")])
    for _ in range(2):  # given again after a failure
        exact.ingest(index, later)
    assert {r.keep_id for r in spark.table(index).collect()} == {3, 2, 8}
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact.resolve(index, later).collect()} == {(9, 3, False), (8, 8, True)}


def test_index_is_joined_by_merging_without_moving_it(spark):
    index = exact.open_index(spark, new_folder(spark, "index"), 16)
    rows = exact.digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    exact.ingest(index, rows)
    batch = rows.groupBy("digest").agg({"doc_id": "max"})
    plan = batch.join(spark.table(index).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
