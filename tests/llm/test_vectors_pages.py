"""Vector operators, archives and the pipeline on odd cases, against brute force."""

import hashlib
import sys
from collections import Counter

import numpy as np
import pytest

from check import compare, duck
from tests_llm_fixtures import documents, empty_documents
from wattloom.llm import capfilter, graph, warc
from wattloom.llm.components import components
from wattloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    x[100:130] = x[0] + 0.12 * rng.normal(size=(30, 24))  # a cloud of near copies
    x[130:135] = x[1]  # equal rows
    x[135] = 3 * x[2]  # another length
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 24), (502, [float("nan")] + [1.0] * 23), (503, [None] + [1.0] * 23), (504, [float("inf")] + [1.0] * 23), (505, []), (None, rows[0][1]), (7, rows[7][1])]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as n_links", "3 as label", "4 as shard", "5 as rank")


def test_cap_filters(spark, vectors):
    rows, odd = vectors
    got = {}
    for r in capfilter.near_duplicates(frame(spark, rows + odd)).collect():
        got.setdefault(r.vec_id, []).append(r)
    x = np.array([r[1] for r in rows])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = y @ y.T >= 0.95
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[close[i]].min() for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    for i in range(len(x)):
        want = int(close[i].sum() - 1)
        if i == 7:  # two equal rows of one id
            assert len(got[7]) == 2 and all(r.n_links == 1 for r in got[7])
            continue
        assert [(r.n_links, r.component_id, r.kept) for r in got[i]] == [(want, comp[i], comp[i] == i)]
    for i, _ in odd[:6]:
        assert [(r.n_links, r.component_id, r.kept) for r in got[i]] == [(0, i, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in got[None]] == [(0, None, True)]
    assert capfilter.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch, vectors):
    monkeypatch.setattr(capfilter, "BLOCK", 7)
    rows, _ = vectors
    got = {(r.a, r.b) for r in capfilter.linked_pairs(frame(spark, rows).selectExpr("vec_id as node", "embedding"), 0.95).collect()}
    x = np.array([r[1] for r in rows])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= 0.95, 1)), strict=True)}


def test_cap_filter_recall():
    """Pairs at cosine 0.95 share a filter of one of the codes."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(300, bool)
    for number in range(capfilter.CODES):
        for i, (a, b) in enumerate(zip(capfilter.decode_list(x, 800, number), capfilter.decode_list(y, 800, number), strict=True)):
            met[i] |= any(set(a[c]) & set(b[c]) for c in a.keys() & b.keys())
    assert met.all()


def test_components(spark):
    import random

    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(5, k) for k in range(400, 500)] + [(rnd.randrange(600, 700), rnd.randrange(600, 700)) for _ in range(60)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter((r.node, r.component) for r in got) == Counter((v, find(v)) for v in linked)


def test_nearest(spark, vectors):
    rows, odd = vectors
    got = {}
    for r in graph.nearest(frame(spark, rows + odd), 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    x = np.array([r[1] for r in rows])
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        hits += len(set(best) & {r.vec_id for r in found})
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits >= 0.97 * 20 * len(got)
    few = graph.nearest(frame(spark, rows[:6]), 20, 20).collect()
    assert Counter(r.query_id for r in few) == {0: 5}
    assert graph.nearest(frame(spark, rows).limit(0), 20, 20).count() == 0


def test_graph_recall_over_shards(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    g = graph.build(graph._lifted(x, float(np.linalg.norm(x, axis=1).max())))
    near, _ = g.search(g.vectors[::20], graph.SEARCH_BEAM)
    best = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near.tolist(), best.tolist(), strict=True)]) > 0.97


def test_archives(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a", page), (1, "http://b\r\nX: y", page), (2, None, page), (2, "http://twice", page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", page), (8, "é", "é" * 60), (9, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "0 as offset", "1 as refers_to", "2 as length")
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == page and i != 1
        want[i, "revisit" if again else "response", 1 if again else None, len(raw), hashlib.sha256(raw).hexdigest(), None if again else raw] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_selects_records(spark):
    from wattloom.llm.support import new_folder

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    picked = index.filter("page_id % 7 = 3")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(picked, folder).filter("payload is not null").collect()}
    want = {r.page_id: r.html for r in pages.filter("page_id % 7 = 3").collect()}
    assert got == {k: want[k] for k in got} and len(got) == picked.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(ORACLES[name]).df()) == ""


def test_pipeline_stages(spark):
    import corpus_pipeline
    from wattloom.llm import langid, minhash, pii

    docs = documents(spark)
    columns = list(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.columns == columns
    have = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == have
    near = corpus_pipeline.near_copies(spark, kept, FOLDER)
    assert near.columns == columns
    ids = [r.doc_id for r in near.collect()]
    best = {r.doc_id for r in minhash.near_duplicates(kept).collect() if r.kept}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in best if i is not None) and ids.count(None) == 1
    clean = corpus_pipeline.personal_data(spark, near, FOLDER)
    before, after = {r.doc_id: r for r in near.collect()}, {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(before) == set(after)
    for i, r in after.items():
        if not pii._SIGNS.search(before[i].text):
            assert r == before[i]
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    packed = corpus_pipeline.packed(spark, clean, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(after)
    assert langid.UNKNOWN not in columns


def test_pipeline_on_empty_table(spark):
    import corpus_pipeline

    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_entry_lists_all(spark):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
