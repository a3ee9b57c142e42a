"""Operators on documents against brute force, on all odd cases and on an empty table."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests_llm_fixtures import documents, empty_documents, texts
from wattloom.llm import langid, maxent, minhash, packing, pieces, pii, rans


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x, _ in texts()]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    want = Counter((d, i // 2048, i, len(ids[i : i + 2048]), crc(ids[i : i + 2048])) for d, ids in ids_of("word_bpe_49k.json", 0) for i in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(empty_documents(spark), path).count() == 0


def best_packing(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_dominance_keeps_the_best_packing():
    rng = np.random.default_rng(0)
    for _ in range(150):
        capacity = int(rng.integers(5, 30))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = packing.reduce_dominated(counts)
        rest = [s for s in range(capacity + 1) for _ in range(int(counts[s]))]
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert sum(n for _, n in fixed) + best_packing(rest, capacity) == best_packing(items, capacity)


def test_plan_places_every_item_once():
    rng = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in zip(rng.choice(2048, 300, replace=False) + 1, rng.integers(1, 10**6, 300), strict=True)}
    got = Counter()
    for length, first, items, _, _, _ in packing.plan_runs(counts, 2048):
        assert first == got[length]
        got[length] += items
    assert got == Counter(counts)


def test_token_files(spark, docs):
    rows = rans.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    want = ids_of("byte_bpe_50k.json", 2)
    assert Counter((r.doc_id, r.n_tokens, r.c) for r in rows) == Counter((d, len(i), crc(i)) for d, i in want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order)
    assert rans.round_trip(empty_documents(spark), public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 70_000, 300_001])
def test_rans_block_and_its_spans(n):
    rng = np.random.default_rng(n)
    ids = (rng.geometric(0.01, n) % 3000).astype(np.int64)
    freq = rans.normalise(np.bincount(ids, minlength=3000))
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[np.unique(ids)] > 0).all()
    starts = rans._starts(freq)
    data = rans.encode_block(ids, freq, starts)
    slots, f, c = np.repeat(np.arange(3000), freq), freq.astype(np.uint64), starts.astype(np.uint64)
    assert (rans.decode_block(data, slots, f, c) == ids).all()
    span = struct.unpack_from("<QIIIQ", data)[2]
    assert (rans.decode_block(data, slots, f, c, first=1, last=2) == ids[span : 2 * span]).all()


def test_sentencepiece(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for d, x, _ in texts():
        ids = model.encode(x or "", add_bos=True, add_eos=True)
        want[d, struct.pack(f"<{len(ids)}I", *ids), model.decode(ids)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encode_documents(docs, path).collect()) == want
    assert pieces.encode_documents(empty_documents(spark), path).count() == 0


def test_sentencepiece_on_odd_strings_and_ids():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own, rnd = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path), random.Random(1)
    parts = ["a", "the", "ing", "▁", " ", "  ", "\n", "\t", "é", "中", "😀", "\0", "�", "<s>", "<0x41>", "1", "==", "//", "\r\n", ","]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert list(own.encode(text)) == model.encode(text)
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == model.decode(ids)


def test_near_copies(spark, docs):
    rows = minhash.near_duplicates(docs).collect()
    sets = {}
    for d, x, _ in texts():
        w = words_of(x)
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {d: d for d in sets if d is not None}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a in comp:
        for b in comp:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    assert len(rows) == len(texts())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0


def test_near_copies_that_chain(spark):
    """A chain of edits, where ends are far apart, is one component; an unlike text that shares words is not."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        base[3 * i] = f"new{i}"
        rows.append((i, " ".join(base)))
    rows.append((99, " ".join(base[:60])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(40)} == {0} and got[99] == 99


def test_pruning_keeps_similar_pairs():
    need = minhash.least_matches(0.85, 20, 10, 1e-5)
    assert (np.diff(need) > 0).all() and need[-1] > 100
    rng = np.random.default_rng(0)
    equal = (rng.random((20000, 200)) < 0.85).reshape(20000, 10, 20).sum(2).cumsum(1)
    assert (equal < need).any(1).mean() < 1e-3


def test_language(spark, docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == held and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == r.lang
    assert langid.identify(empty_documents(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_scores(spark, docs):
    rows = maxent.score(docs).collect()
    counts = Counter()
    for d, x, _ in texts():
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*words_of(x), None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for d, x, _ in texts():
        tokens = [*words_of(x), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        want[d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 60]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.score(empty_documents(spark)).count() == 0


def test_model_is_a_distribution(spark, docs):
    model, _ = maxent.train(docs, vocabulary=64)
    all_ids = np.arange(len(model.vocabulary) + 1)
    for history in ([0, 1, 2], [5, model.rare, 3]):
        ids = np.concatenate([[*history, w] for w in all_ids])
        logs = model.log10(ids, np.full(len(all_ids), 4))[3::4]
        assert abs((10**logs).sum() - 1) < 1e-4


def pattern_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    import random

    rnd = random.Random(2)
    parts = ["a", "B", "@", "@", ".", "-", "+", "1", "22", "255", "4111111111111111", " ", "(", ")", "%", "é", "x.y", "\n", "1.2.3.4", "a@b.co", "+1 415 555"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(text) == pattern_spans(text)


def test_personal_data(spark, docs):
    want = {d: pii.base_spans(x or "") for d, x, _ in texts()}
    for r in pii.detect(docs).collect():
        if r.doc_id is not None:
            assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == want[r.doc_id]
            assert all(s.start < s.end for s in r.spans)
    assert pii.detect(empty_documents(spark)).count() == 0


def test_tagger_learns_held_out_windows():
    import random

    rnd = random.Random(3)

    def window():
        word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
        left, right = " ".join(word() for _ in range(3)) + " ", " " + " ".join(word() for _ in range(3))
        kind = rnd.choice(["email", "ip", "none"])
        value = {"email": f"{word()}@{word()}.com", "ip": ".".join(str(rnd.randint(0, 255)) for _ in range(4)), "none": f"{rnd.randint(0, 99)}"}[kind]
        text = (left + value + right)[: pii.WIDTH]
        return text, [] if kind == "none" else [(len(left), len(left) + len(value), kind)]

    data = [window() for _ in range(1100)]
    ids, tags = np.stack([pii.char_ids(t) for t, _ in data]), np.stack([pii._tags(0, len(t), s) for t, s in data])
    model = pii.Tagger().fit(ids[:1000], tags[:1000])
    path = model.viterbi(model.scores(ids[1000:])[0].astype(float))
    assert (path == tags[1000:]).all(1).mean() > 0.9


def test_windows_are_reconciled_without_overlaps():
    spans = [((0, 10, "ip"), 0.9), ((5, 30, "phone"), 0.99), ((28, 40, "ip"), 0.98), ((31, 36, "card"), 0.99)]
    assert pii._best_set(spans) == [(5, 30, "phone"), (31, 36, "card")]


def test_digest_of_spans_by_query(spark):
    from wattloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op4_personal_data"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        base = pattern_spans(r.text or "")
        got = found[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == tuple(sum(b[2] == k for b in base) for k in pii.KINDS)
        assert set(f"{k}:{s}:{e}" for s, e, k in base) <= set(got.spans.split(","))
