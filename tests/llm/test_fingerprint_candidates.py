"""Near copies of the pipeline are met by op9's fingerprints and BK-trees too."""

import corpus_pipeline as pipeline
from test_copies import DOC, plain_first, planted

from skyloom.llm import copies


def test_stage_takes_links_of_fingerprints(spark, monkeypatch):
    called = []
    whole = copies.link_fingerprints
    monkeypatch.setattr(copies, "link_fingerprints", lambda *args: called.append(args) or whole(*args))
    rows = planted()
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOC)
    kept = sorted((False, r.doc_id) for r in pipeline.near_duplicate_stage(spark, df, "").collect())
    assert called and kept == plain_first(rows)


def test_links_of_fingerprints(spark):
    # 1 and 2 differ in three bits, 2 and 3 in two, 4 in more from all; 5 has the fingerprint of 4
    reps = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b11111), (4, -1), (5, -1), (6, 0xFFFF)], "sid long, fp long")
    pairs = {(r.u, r.v) for r in copies.fingerprint_links(spark, reps).collect() if r.u != r.v}
    assert pairs == {(2, 1), (3, 1), (5, 4)}
