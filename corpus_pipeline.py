"""A corpus pipeline of the llm operators: language, lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import copies, decontaminate, language, lines, packing
from skyloom.llm.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    model = language.train(docs)
    told = language.identify(spark, docs.select(*COLUMNS).withColumn("body", F.col("text")), model, [c if c != "text" else "body" for c in COLUMNS])
    return told.filter(~F.col("rejected")).withColumnRenamed("body", "text").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document that loses all its words goes."""
    found = lines.deduplicate_lines(spark, docs.select(*COLUMNS))
    left = found.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the one with the smallest doc_id, null last; of equal rows, one.

    Candidates come from op9's SimHash fingerprints, linked through BK-trees, and from MinHash keys; shingle sets decide.
    """
    # one set of keys without nulls for join and window, so that texts are shuffled once
    keys = ["unknown", "id", "text_hash"]
    id_ = F.coalesce("doc_id", F.lit(0))
    known = docs.select(*COLUMNS).withColumns({"unknown": F.col("doc_id").isNull(), "id": id_, "text_hash": F.xxhash64("text")})
    first = copies.first_copies(spark, docs).select("unknown", id_.alias("id"), "text_hash")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("text_hash"))
    return known.join(first, keys, "left_semi").withColumn("nth", nth).filter("nth = 1").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(spark, docs.select(*COLUMNS), benchmark)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the centroid classifier or the packing; tests/llm compare with plain renderings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; between stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
