"""Published tables and their self-description."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UsageError(ValueError):
    """What a caller asked for cannot be done."""


#: VOTable datatype and arraysize of each Spark type.
DATATYPES = {
    T.BooleanType: ("boolean", None),
    T.ShortType: ("short", None),
    T.IntegerType: ("int", None),
    T.LongType: ("long", None),
    T.FloatType: ("float", None),
    T.DoubleType: ("double", None),
    T.DecimalType: ("double", None),
    T.StringType: ("char", "*"),
    T.DateType: ("char", "*"),
    T.TimestampType: ("char", "*"),
    T.TimestampNTZType: ("char", "*"),
}
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def datatype(kind: T.DataType) -> tuple[str, str | None, str | None]:
    """(datatype, arraysize, xtype); what has no type of its own is text."""
    name, size = DATATYPES.get(type(kind), ("char", "*"))
    return name, size, "timestamp" if isinstance(kind, TIMES) else None


@dataclass
class Catalog:
    """Tables that queries may read, by schema-qualified name in any case, and what is known of them."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, list[tuple[str, str]]]] = field(default_factory=list)
    uploads: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: dict[str, list[str]]) -> Catalog:
        """Publish the parquet tables of a folder, as ``names`` lists them by schema."""
        out = cls(spark)
        for schema, tables in names.items():
            for t in tables:
                out.publish(f"{schema}.{t}", spark.read.parquet(f"{folder}/{t}.parquet"))
        return out

    def publish(self, name: str, df: DataFrame, description: str = "", columns: dict[str, dict] | None = None) -> None:
        """Publish a table; ``columns`` has unit, ucd and description of columns, kept as their metadata."""
        for c, told in (columns or {}).items():
            df = df.withMetadata(c, told)
        self.tables[name.lower()] = df
        self.descriptions[name.lower()] = description

    def upload(self, name: str, df: DataFrame) -> None:
        """Bind a caller's own table for this catalog's queries as tap_upload.name."""
        if not name[:1].isalpha() or not name.replace("_", "a").isalnum() or not name.isascii():
            raise UsageError(f"{name!r} is no name of an upload")
        if name.lower() in self.uploads:
            raise UsageError(f"upload {name} is given twice")
        self.uploads[name.lower()] = df

    def table(self, name: str) -> DataFrame:
        """A published or uploaded table; anything else is refused."""
        key = name.lower()
        if key.startswith("tap_upload."):
            if key[11:] in self.uploads:
                return self.uploads[key[11:]]
            raise UsageError(f"no table {name} was uploaded")
        if key.startswith("tap_schema."):
            return self.self_description()[key[11:]]
        if key not in self.tables:
            raise UsageError(f"table {name} is not published")
        return self.tables[key]

    def geometry_column(self, name: str, column: str):
        """A column for a place where a region is asked for; text is refused, and its companion suggested."""
        df = self.table(name)
        kind = df.schema[column].dataType
        if isinstance(kind, T.StringType):
            hint = f"; use {column}_geom" if f"{column}_geom" in df.columns else ""
            raise UsageError(f"column {column} is text, not a region{hint}")
        return df[column]

    def self_description(self) -> dict[str, DataFrame]:
        """schemas, tables, columns, keys and key_columns of all that is published."""
        names = sorted(self.tables)
        schemas = sorted({n.split(".")[0] for n in names})
        columns = []
        for n in names:
            for k, f in enumerate(self.tables[n].schema.fields):
                d, size, xtype = datatype(f.dataType)
                m = f.metadata
                columns.append((n, f.name, d, size, xtype, m.get("unit"), m.get("ucd"), m.get("description"), k))
        keys = [(str(k), a, b) for k, (a, b, _) in enumerate(self.foreign_keys)]
        pairs = [(str(k), a, b) for k, (_, _, on) in enumerate(self.foreign_keys) for a, b in on]
        make = self.spark.createDataFrame
        return {
            "schemas": make([(s,) for s in schemas], "schema_name string"),
            "tables": make(
                [(n.split(".")[0], n, "table", self.descriptions[n]) for n in names],
                "schema_name string, table_name string, table_type string, description string",
            ),
            "columns": make(
                columns,
                "table_name string, column_name string, datatype string, arraysize string, xtype string, unit string, ucd string, description string, column_index int",
            ),
            "keys": make(keys, "key_id string, from_table string, target_table string"),
            "key_columns": make(pairs, "key_id string, from_column string, target_column string"),
        }

    def missing_columns(self, advertised: DataFrame) -> DataFrame:
        """Of (table_name, column_name), those that no published table has."""
        return advertised.join(self.self_description()["columns"], ["table_name", "column_name"], "left_anti")

    def orphans(self, key: int) -> DataFrame:
        """Rows of a foreign key's table without their target; rows with a null in the key are none."""
        source, target, on = self.foreign_keys[key]
        a, b = self.table(source), self.table(target)
        known = b.select(*[F.col(t).alias(s) for s, t in on]).distinct()
        complete = a.dropna(subset=[s for s, _ in on])
        return complete.join(known, [s for s, _ in on], "left_anti")
