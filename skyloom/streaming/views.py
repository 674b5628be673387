"""Keeping the observation view up to date from a stream of changed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.plans.observations import ViewSource, refreshed


class VersionedTable:
    """A table of parquet versions: a new one is written beside the last, then named in the pointer file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        rows = self.spark.read.text(f"{self.path}/current").collect() if self._exists("current") else []
        return int(rows[0][0]) if rows else -1

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def replace(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as a version, by default the next; writing a version again gives the same table."""
        n = self.version() + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self.spark.createDataFrame([(str(n),)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        return n


def follow_changes(
    changes: DataFrame,
    view: VersionedTable,
    read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    source: ViewSource,
    checkpoint: str,
):
    """Refresh the view for each batch of changed product keys in a stream.

    ``read`` gives products, observations and artifacts as they are now. A batch that is run
    again after a failure makes the same slice again. Returns the started query.
    """

    def batch(keys: DataFrame, number: int) -> None:
        view.replace(refreshed(view.read(), keys, *read(), source))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
