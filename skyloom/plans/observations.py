"""The observation view: products joined with their observation and their first access artifact.

The view is kept as a table. After changes only the slice of the changed keys is made again,
which gives the same rows as making all of it again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.scalar import percent_encode


@dataclass
class ViewSource:
    """Where the view's rows come from.

    ``product_key`` are the product's key columns, of which ``observation_key`` lead to the
    observation; ``artifact_order`` (SQL, ties and all) picks the first of the artifacts for which ``artifact_where``
    holds. ``columns`` are the view's columns, SQL over the joined row.
    """

    product_key: list[str]
    observation_key: list[str]
    artifact_columns: list[str]
    artifact_order: str
    artifact_where: str
    columns: dict[str, str]


def first_artifacts(artifacts: DataFrame, source: ViewSource) -> DataFrame:
    """One row a product: the columns of its first artifact that counts, by partial aggregation."""
    first = F.min_by(F.struct(*source.artifact_columns), F.expr(source.artifact_order))
    chosen = artifacts.filter(source.artifact_where).groupBy(*source.product_key).agg(first.alias("first"))
    return chosen.select(*source.product_key, "first.*")


def observation_view(products: DataFrame, observations: DataFrame, artifacts: DataFrame, source: ViewSource) -> DataFrame:
    """The whole view."""
    joined = products.join(observations, source.observation_key).join(first_artifacts(artifacts, source), source.product_key, "left")
    return joined.select(*source.product_key, *[F.expr(c).alias(n) for n, c in source.columns.items()])


def refreshed(
    view: DataFrame, changed: DataFrame, products: DataFrame, observations: DataFrame, artifacts: DataFrame, source: ViewSource
) -> DataFrame:
    """The view after changes to the products whose keys are in ``changed``: inserted, updated, deleted or with changed artifacts."""
    keys = changed.select(*source.product_key).distinct()
    kept = view.join(keys, source.product_key, "left_anti")
    slice_ = observation_view(
        products.join(keys, source.product_key, "left_semi"), observations, artifacts.join(keys, source.product_key, "left_semi"), source
    )
    return kept.unionByName(slice_)


def publisher_id(prefix: str, *keys: str) -> Column:
    """The identifier of a row: a prefix and its encoded keys."""
    return F.concat(F.lit(prefix), F.concat_ws("/", *[percent_encode(F.col(k).cast("string")) for k in keys]))
