"""Every stage of the pipeline against a plain rendering of its decisions."""

import corpus_pipeline as pipeline
import pytest
from test_copies import plain_first
from test_operators import AWKWARD, DOC, brute_tiles, check_packed, plain_lines, plain_words

from skyloom.llm import queries


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return plain_words(text or "").split()


@pytest.mark.parametrize("extra", [False, True])
def test_stages(spark, small, extra, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    if extra:
        docs = docs.filter("doc_id > 100").limit(60).unionByName(spark.createDataFrame(AWKWARD, DOC))
    benchmark = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    at = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, small)
        out.write.parquet(str(tmp_path / name))
        before, after, at = rows_of(at), rows_of(spark.read.parquet(str(tmp_path / name))), spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert at.columns == pipeline.COLUMNS
        if name == "language":
            assert {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in after}
        elif name == "lines":
            pairs = {r["doc_id"]: r["text"] for r in before}
            left = plain_lines(list(pairs.items()))
            expected = {k: v for k, v in left.items() if v == pairs[k] or words(v)}
            assert {r["doc_id"]: r["text"] for r in after} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == plain_first([(r["doc_id"], r["text"]) for r in before])
        elif name == "decontamination":

            def leaks(text):
                doc = words(text)
                for item in map(words, benchmark):
                    if {tuple(item[i : i + 5]) for i in range(len(item) - 4)} & {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}:
                        if sum(t[2] for t in brute_tiles(item, doc, 5)) >= 0.5 * len(item):
                            return True
                return False

            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not leaks(r["text"])}
        else:
            check_packed([type("Row", (), r) for r in after], {r["doc_id"]: r["text"] for r in before})


def test_pipeline_of_an_empty_table(spark, small, tmp_path):
    at = spark.createDataFrame([], DOC)
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, small)
        assert at.count() == 0


def test_registered(spark, small):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert known["pipeline"](spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    expected = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in expected.fetchall())
