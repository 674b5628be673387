"""Shingles of whole batches of texts, and the minima that candidates are met by."""

import random

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa

from skyloom.llm import copies


def test_shingles_of_many_texts_at_once():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbéß漢 \t\n\x0b\x1c ") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", None, "a", "A b c d", "a b c d e", "a b c d e f"]
    plain = {}
    # a slice, so that the bytes do not begin at 0
    for text, (hashes, known) in zip(texts, copies._sets(pa.array(["x", *texts]).slice(1)), strict=True):
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        own = [tuple(words[k : k + n]) for k in range(max(1, len(words) - 4))]
        assert len(own) == len(hashes) and len(set(own)) == len(known)
        assert all(plain.setdefault(a, b) == b for a, b in zip(own, hashes.tolist()))
    assert len(set(plain.values())) == len(plain)


def test_minima_agree_as_often_as_sets_are_alike():
    rng, mixers, n = np.random.default_rng(2), copies._mixers(), 400
    for similarity in (0.8, 0.5, 0.2):
        both = round(2 * n * similarity / (1 + similarity))
        found = []
        for _ in range(60):
            hashes = rng.integers(0, 2**64, 2 * n - both, np.uint64)
            found.append((copies.least_of(hashes[:n], mixers) == copies.least_of(hashes[n - both :], mixers)).mean())
        assert abs(np.mean(found) - similarity) < 0.02
    # equal bands of unequal places have keys of their own
    keys = copies.band_keys(np.zeros((2, copies.BANDS * copies.ROWS), np.uint32))
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == copies.BANDS


def test_texts_are_shuffled_once_by_the_stage(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "h i j k l m", "en", "s", 11), (0, "h i j k l m n", "en", "s", 13), (0, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = pipeline.near_duplicate_stage(spark, df, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [(False, 0, ""), (False, 0, "h i j k l m n"), (False, 1, "a b c d e f g"), (True, 0, "h i j k l m")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows with texts go through one exchange below the window
    window = plan[plan.index("Window [") :]
    assert "Exchange" not in window[: window.index("Join")]
