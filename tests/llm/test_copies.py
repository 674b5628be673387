"""Near copies of documents against brute force on shingle sets."""

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, DOC

from skyloom.llm import copies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_first(rows):
    """Keys of the least row of each group that is connected by similar pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (k, _) in zip(group, rows):
        least[g] = min(least.get(g, (True, 1 << 62)), (k is None, k or 0))
    return sorted(least.values())


def planted():
    """Texts, each with edited copies that are still 0.8 alike, and one that is less."""
    rng = np.random.default_rng(3)
    out = []
    for n in (60, 120, 300, 900):
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        out.append((len(out), " ".join(words)))
        for edits in (1, n // 60, n // 10):
            edited = list(words)
            for at in np.linspace(7, n - 8, edits).astype(int):
                edited[at] = f"new{at}"
            out.append((len(out), " ".join(edited)))
    return out


def test_edited_copies_go(spark):
    rows = planted()
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOC)
    kept = sorted((False, r.doc_id) for r in pipeline.near_duplicate_stage(spark, df, "").collect())
    assert kept == plain_first(rows)
    assert kept == sorted((False, k) for k, _ in rows if k % 4 in (0, 3))


@pytest.mark.parametrize("part", [1000, 3])
def test_first_copies_equal_brute_force(spark, small, part):
    df = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(AWKWARD, DOC).withColumn("doc_id", 10_000 + F.col("doc_id")))
    got = sorted((r.unknown, r.doc_id or 0) for r in copies.first_copies(spark, df, part).collect())
    assert got == plain_first([(r.doc_id, r.text) for r in df.collect()])
