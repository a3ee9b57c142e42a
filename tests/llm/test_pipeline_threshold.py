"""The near-copy stage of the pipeline by brute force between 80 and 85 percent."""

import random

import corpus_pipeline


def test_near_copy_stage_takes_pairs_from_80_percent_on(spark):
    """One to three separate words of 100 changed: 0.90, 0.81 and 0.73 of the shingles."""
    rnd, rows = random.Random(7), []
    for i in range(90):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(words), "en", "src", 0))
        for k in range(1 + i % 3):
            words[20 + 25 * k] = f"new{i}"
        rows.append((2 * i + 1, " ".join(words), "en", "src", 0))
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in ((r[0], r[1].split()) for r in rows)}
    share = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in sets if d % 2 == 0}
    assert sum(0.8 <= s < 0.85 for s in share.values()) == 30 and sum(s < 0.8 for s in share.values()) == 30
    want = {d for d in sets if d % 2 == 0 or share[d - 1] < 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want
