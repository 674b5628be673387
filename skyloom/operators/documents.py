"""Nested metadata documents as tables of levels, and back, with keyed changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Level:
    """A level of a document hierarchy: its name, its own key and scalar columns, and the array of its children."""

    name: str
    key: str
    columns: list[str] = field(default_factory=list)
    child_field: str | None = None
    child: Level | None = None
    checks: dict[str, str] = field(default_factory=dict)

    def chain(self) -> list[Level]:
        return [self, *(self.child.chain() if self.child else [])]


def flatten(documents: DataFrame, root: Level) -> dict[str, DataFrame]:
    """A table for each level: the keys of all levels above, its own key and its columns."""
    out: dict[str, DataFrame] = {}
    rows, above = documents, []
    for level in root.chain():
        out[level.name] = rows.select(*above, level.key, *level.columns)
        if level.child:
            above = [*above, level.key]
            rows = rows.select(*above, F.explode(level.child_field).alias("x")).select(*above, "x.*")
    return out


def rebuild(tables: dict[str, DataFrame], root: Level) -> DataFrame:
    """The nested documents again, children in the order of their keys; the inverse of ``flatten``."""
    levels = root.chain()
    below: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        level, above = levels[depth], [x.key for x in levels[:depth]]
        rows = tables[level.name]
        fields = [level.key, *level.columns]
        if below is not None:
            rows = rows.join(below, [*above, level.key], "left")
            fields.append(level.child_field)
        if depth:
            item = F.struct(*fields)
            below = rows.groupBy(*above).agg(F.array_sort(F.collect_list(item)).alias(levels[depth - 1].child_field))
        else:
            return rows.select(*fields)
    raise ValueError("no levels")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with their key, and all other old rows; columns that only one side has are null in the other."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def amend(df: DataFrame, where: Column, changes: dict[str, Column], keys: list[str]) -> DataFrame:
    """Change columns, none of them a key, of the rows that match."""
    if set(changes) & set(keys):
        raise ValueError("keys cannot be amended")
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete(tables: dict[str, DataFrame], root: Level, gone: DataFrame) -> dict[str, DataFrame]:
    """All levels without the documents whose root key is in ``gone``."""
    keys = gone.select(root.key).distinct()
    return {name: df.join(keys, root.key, "left_anti") for name, df in tables.items()}


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows that break a check (an SQL condition), with the check's name; an unknown result breaks none."""
    broken = F.filter(F.array(*[F.when(~F.expr(c), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def evolved(*parts: DataFrame) -> DataFrame:
    """Tables of successive models as one, with all columns that any has had."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
