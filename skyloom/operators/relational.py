"""Small relational operators whose order of nulls, limits and shapes differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascending(column: str | Column) -> Column:
    """Nulls last."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def descending(column: str | Column) -> Column:
    """Nulls first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


def top(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows of a sorted table from an offset; the offset is applied first."""
    return (df.offset(offset) if offset else df).limit(n)


def limited(df: DataFrame, max_records: int | None, default: int = 10_000, ceiling: int = 1_000_000) -> DataFrame:
    """At most ``max_records`` rows and one more, by which an overflow is told; unset means ``default``, more than ``ceiling`` means that."""
    if max_records is not None and max_records < 0:
        raise ValueError("the limit may not be negative")
    n = min(default if max_records is None else max_records, ceiling)
    return df.limit(n + 1)


def first_by(value: str, order: str | Column, where: Column | None = None) -> Column:
    """The value of the row that comes first by ``order``, of those that ``where`` holds for."""
    if where is None:
        return F.min_by(value, order)
    return F.min_by(value, F.when(where, F.col(order) if isinstance(order, str) else order))


def not_in(df: DataFrame, column: str, found: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose column is not among the keys of ``found``, as NOT IN has it.

    If there is a null key, no row is certain and none is kept; a null column is kept only
    where there are no keys at all. The keys' counts are a single row.
    """
    counts = found.agg(F.count("*").alias("keys_"), F.count(key).alias("known_"))
    certain = df.crossJoin(F.broadcast(counts)).filter((F.col("keys_") == 0) | ((F.col("keys_") == F.col("known_")) & F.col(column).isNotNull()))
    keys = found.select(F.col(key).alias("key_"))
    return certain.drop("keys_", "known_").join(keys, F.col(column) == F.col("key_"), "left_anti")


def json_rows(df: DataFrame, keys: list[str], columns: list[str], order: list[str], name: str = "rows") -> DataFrame:
    """The rows of each key as one JSON array of objects, in order."""
    row = F.struct(F.struct(*order).alias("order"), F.struct(*columns).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])
    return df.groupBy(*keys).agg(F.to_json(rows).alias(name))


def exact_sum(column: str) -> Column:
    """Sum of longs that cannot overflow, as a double."""
    return F.sum(F.col(column).cast("decimal(38,0)")).cast("double")


def keyset_page(df: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The ``size`` rows after a key and one more that tells whether there is a next page."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size + 1)


def with_child_counts(parents: DataFrame, children: DataFrame, keys: list[str], name: str = "n_children") -> DataFrame:
    """Parents with the number of their children, 0 included."""
    counts = children.groupBy(*keys).agg(F.count("*").alias(name))
    return parents.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
