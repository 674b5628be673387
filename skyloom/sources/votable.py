"""VOTable documents as tables.

A document is one uploaded file of bounded size, so it is read as a whole; many documents
are read by many tasks (``read_votables``).
"""

from __future__ import annotations

import base64
import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources.catalog import UsageError

#: Rows and bytes of one document at most.
MOST_ROWS, MOST_BYTES = 100_000, 32 << 20
#: Spark type and big-endian form of each datatype.
KINDS = {
    "boolean": ("boolean", "c"), "unsignedByte": ("smallint", "B"), "short": ("smallint", "h"), "int": ("int", "i"), "long": ("bigint", "q"),
    "float": ("float", "f"), "double": ("double", "d"), "char": ("string", "s"), "unicodeChar": ("string", "U"),
}


class Field:
    """A FIELD: its name, type and the value that stands for null."""

    def __init__(self, node: ET.Element) -> None:
        self.name, self.kind = node.get("name"), node.get("datatype")
        if not self.name or self.kind not in KINDS:
            raise UsageError(f"FIELD {self.name!r} has the unknown datatype {self.kind!r}")
        size = node.get("arraysize")
        self.array = size is not None and size != "1"
        self.text = self.kind in ("char", "unicodeChar")
        self.variable = size is not None and size.endswith("*")
        self.size = 1 if size in (None, "1") else int(size.rstrip("*") or 0) if size else 1
        self.time = node.get("xtype") == "timestamp"
        values = next((x for x in node if _bare(x) == "VALUES"), None)
        self.null = None if values is None else values.get("null")
        self.type = "string" if self.text or self.array else KINDS[self.kind][0]

    def value(self, text: str | None) -> object:
        if self.text or self.array:
            return text if text is not None else None
        text = (text or "").strip()
        if not text or text == self.null:
            return None
        if self.kind == "boolean":
            low = text.lower()
            return True if low in ("t", "true", "1") else False if low in ("f", "false", "0") else None
        if self.kind in ("float", "double"):
            x = float(text)
            return None if math.isnan(x) else x
        return int(text, 16) if text.lower().startswith("0x") else int(text)


def _bare(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _binary_rows(data: bytes, fields: list[Field]) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        row = []
        for f in fields:
            n = f.size
            if f.variable:
                (n,) = struct.unpack_from(">i", data, at)
                at += 4
            code = KINDS[f.kind][1]
            if f.text:
                width = 2 if code == "U" else 1
                raw = data[at : at + n * width]
                at += n * width
                row.append(raw.decode("utf-16-be" if width == 2 else "utf-8").rstrip("\0"))
                continue
            values = struct.unpack_from(f">{n}{code}", data, at)
            at += struct.calcsize(f">{n}{code}")
            if f.array:
                row.append(" ".join(str(v) for v in values))
            elif f.kind == "boolean":
                row.append({b"T": True, b"t": True, b"1": True, b"F": False, b"f": False, b"0": False}.get(values[0]))
            elif isinstance(values[0], float) and math.isnan(values[0]) or f.null is not None and str(values[0]) == f.null:
                row.append(None)
            else:
                row.append(values[0])
        yield tuple(row)


def parse_votable(document: bytes, most_rows: int = MOST_ROWS) -> tuple[str, list[tuple]]:
    """(schema, rows) of the first table of a document, in TABLEDATA or BINARY form."""
    if len(document) > MOST_BYTES:
        raise UsageError("the document is too large")
    try:
        root = ET.fromstring(document)
    except ET.ParseError as e:
        raise UsageError(f"no VOTable: {e}") from e
    table = next((x for x in root.iter() if _bare(x) == "TABLE"), None)
    if table is None:
        raise UsageError("the document has no TABLE")
    fields = [Field(x) for x in table if _bare(x) == "FIELD"]
    if not fields or len({f.name.lower() for f in fields}) < len(fields):
        raise UsageError("the table has no FIELD, or two of one name")
    rows: list[tuple] = []
    for node in table.iter():
        if _bare(node) in ("BINARY2", "FITS"):
            raise UsageError(f"{_bare(node)} is not supported")
        if _bare(node) == "TR":
            cells = [x.text for x in node if _bare(x) == "TD"]
            if len(cells) != len(fields):
                raise UsageError("a row has another number of cells than there are fields")
            try:
                rows.append(tuple(f.value(c) for f, c in zip(fields, cells, strict=True)))
            except ValueError as e:
                raise UsageError(str(e)) from e
        if _bare(node) == "STREAM":
            rows += _binary_rows(base64.b64decode(node.text or ""), fields)
        if len(rows) > most_rows:
            raise UsageError(f"the table has more than {most_rows} rows")
    return ", ".join(f"`{f.name}` {f.type}" for f in fields), rows


def read_votable(spark: SparkSession, document: bytes, most_rows: int = MOST_ROWS) -> DataFrame:
    """The table of one document; fields with xtype timestamp become timestamps."""
    schema, rows = parse_votable(document, most_rows)
    return spark.createDataFrame(rows, schema)


def read_votables(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The tables of all documents of a folder, which share a schema, each read in the task that has its file."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                told, rows = parse_votable(bytes(content))
                names = [c.split("`")[1] for c in told.split(", ")]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def upload_list(parameter: str) -> list[tuple[str, str]]:
    """(name, uri) of an upload parameter ``name,uri;name,uri``."""
    out: list[tuple[str, str]] = []
    for part in filter(None, parameter.split(";")):
        name, _, uri = part.partition(",")
        if not uri or not name[:1].isalpha() or not all(c.isalnum() or c == "_" for c in name):
            raise UsageError(f"{part!r} is not name,uri")
        if name.lower() in {n.lower() for n, _ in out}:
            raise UsageError(f"upload {name} is given twice")
        out.append((name, uri))
    return out


def row_elements(df: DataFrame) -> DataFrame:
    """One text column ``row`` with each row as a TR element, built by the executors."""
    from skyloom.sources.results import text_of

    cells = [
        F.when(v.isNull(), F.lit("<TD/>")).otherwise(F.concat(F.lit("<TD>"), _escaped(v), F.lit("</TD>")))
        for v in (text_of(df, f) for f in df.schema.fields)
    ]
    return df.select(F.concat(F.lit("<TR>"), *cells, F.lit("</TR>")).alias("row"))


def _escaped(v):
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
