"""Catalog, uploads, results, documents, views and streams."""

import base64
import csv
import io
import json
import struct
import xml.etree.ElementTree as ET
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyloom.functions import scalar
from skyloom.operators import documents, relational
from skyloom.plans import observations
from skyloom.plans import queries as plans
from skyloom.sources import results, votable
from skyloom.sources.catalog import Catalog, UsageError
from skyloom.streaming.views import VersionedTable, follow_changes


@pytest.fixture(scope="module")
def catalog(spark, small):
    out = Catalog.of_folder(spark, small, {"tpch": ["nation", "region", "orders", "customer"]})
    out.publish("sky.sources", spark.createDataFrame([(1, 10.0, "CIRCLE 1 2 3")], "id long, ra double, s_region string").withColumn("s_region_geom", F.lit(None).cast("string")), "positions", {"ra": {"unit": "deg", "ucd": "pos.eq.ra"}})
    out.foreign_keys.append(("tpch.orders", "tpch.customer", [("o_custkey", "c_custkey")]))
    return out


def test_catalog(spark, catalog):
    assert catalog.table("TPCH.Nation").count() == 25
    with pytest.raises(UsageError, match="not published"):
        catalog.table("tpch.lineitem")
    with pytest.raises(UsageError, match="s_region_geom"):
        catalog.geometry_column("sky.sources", "s_region")
    columns = {r.column_name: r for r in catalog.table("tap_schema.columns").filter("table_name = 'sky.sources'").collect()}
    assert columns["ra"].unit == "deg" and columns["id"].datatype == "long" and columns["s_region"].arraysize == "*"
    assert catalog.table("tap_schema.key_columns").count() == 1 and catalog.orphans(0).count() == 0
    missing = spark.createDataFrame([("tpch.nation", "n_name"), ("tpch.nation", "gone")], "table_name string, column_name string")
    assert [r.column_name for r in catalog.missing_columns(missing).collect()] == ["gone"]
    catalog.upload("mine", spark.range(3))
    assert catalog.table("TAP_UPLOAD.Mine").count() == 3
    for bad in ("mine", "1x", "a-b"):
        with pytest.raises(UsageError):
            catalog.upload(bad, spark.range(1))


FIELDS = '<FIELD name="id" datatype="int"><VALUES null="-99"/></FIELD><FIELD name="x" datatype="double"/><FIELD name="ok" datatype="boolean"/><FIELD name="s" datatype="char" arraysize="*"/>'


def document(data: str, fields: str = FIELDS) -> bytes:
    return f'<VOTABLE xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE><TABLE>{fields}<DATA>{data}</DATA></TABLE></RESOURCE></VOTABLE>'.encode()


ROWS = [(1, 1.5, True, "a<b"), (None, None, None, ""), (3, -2.0, False, "é")]


def test_uploads(spark, tmp_path):
    cells = "<TR><TD>1</TD><TD>1.5</TD><TD>T</TD><TD>a&lt;b</TD></TR><TR><TD>-99</TD><TD>NaN</TD><TD/><TD></TD></TR><TR><TD>0x3</TD><TD>-2</TD><TD>false</TD><TD>é</TD></TR>"
    plain = document(f"<TABLEDATA>{cells}</TABLEDATA>")
    got = [tuple(r) for r in votable.read_votable(spark, plain).collect()]
    assert [r[:3] for r in got] == [r[:3] for r in ROWS] and got[0][3] == "a<b" and got[2][3] == "é"
    raw = b""
    for i, x, ok, s in ROWS:
        text = s.encode()
        raw += struct.pack(">id", -99 if i is None else i, float("nan") if x is None else x) + {True: b"T", False: b"F", None: b"?"}[ok] + struct.pack(">i", len(text)) + text
    binary = document(f'<BINARY><STREAM encoding="base64">{base64.b64encode(raw).decode()}</STREAM></BINARY>')
    assert [tuple(r) for r in votable.read_votable(spark, binary).collect()] == ROWS
    for k, d in enumerate((plain, binary)):
        (tmp_path / f"{k}.xml").write_bytes(d)
    assert votable.read_votables(spark, str(tmp_path), "id int, x double, ok boolean, s string").count() == 6
    for bad in (b"nothing", document("<BINARY2/>"), document("<TABLEDATA><TR><TD>1</TD></TR></TABLEDATA>"), document("", '<FIELD name="a" datatype="odd"/>')):
        with pytest.raises(UsageError):
            votable.parse_votable(bad)
    with pytest.raises(UsageError, match="more than 1"):
        votable.parse_votable(plain, 1)
    assert votable.upload_list("a,http://x;b2,param:y") == [("a", "http://x"), ("b2", "param:y")]
    for bad in ("a", "1a,u", "a,u;A,v"):
        with pytest.raises(UsageError):
            votable.upload_list(bad)


@pytest.fixture(scope="module")
def kinds(spark):
    rows = [
        (1, "a,\"b\"<&>", Decimal("1.50"), datetime(2020, 1, 2, 3, 4, 5), True, [1, 2], bytearray(b"\x01\xff")),
        (2, None, None, None, None, None, None),
        (3, "", Decimal("2"), datetime(2020, 1, 2, 3, 4, 5, 60), False, [], bytearray(b"")),
    ]
    df = spark.createDataFrame(rows, "i long, s string, d decimal(5,2), t timestamp_ntz, b boolean, a array<int>, raw binary").orderBy("i")
    return df.withMetadata("i", {"unit": "m", "ucd": "meta.id"})


def written(df, format, most=10):
    out = io.BytesIO()
    return results.write_result(df, out, format, most), out.getvalue()


def test_text_formats(kinds):
    over, data = written(kinds, "csv")
    rows = list(csv.reader(io.StringIO(data.decode())))
    assert not over and rows[1] == ["1", 'a,"b"<&>', "1.5", "2020-01-02T03:04:05", "True", "[1, 2]", "01ff"] and rows[2] == ["2", *[""] * 6]
    assert rows[3][3] == "2020-01-02T03:04:05.000060"
    assert written(kinds, "text/tab-separated-values")[1].decode().startswith("i\ts\td")
    told = json.loads(written(kinds, "json", 2)[1])
    assert told["status"] == "OVERFLOW" and len(told["data"]) == 2 and told["metadata"][0]["unit"] == "m"
    over, data = written(kinds, "votable", 2)
    root = ET.fromstring(data)
    ns = "{http://www.ivoa.net/xml/VOTable/v1.3}"
    assert over and [x.get("value") for x in root.iter(f"{ns}INFO")] == ["OK", "OVERFLOW"]
    assert [x.get("datatype") for x in root.iter(f"{ns}FIELD")] == ["long", "char", "double", "char", "boolean", "char", "char"]
    assert [x.text for x in next(root.iter(f"{ns}TR"))][:2] == ["1", 'a,"b"<&>']
    assert b"QUERY_STATUS" in results.write_error("a < b") and b"a &lt; b" in results.write_error("a < b")
    with pytest.raises(UsageError):
        results.negotiated("pdf")
    assert results.negotiated(None) == "votable" and results.negotiated("TEXT/XML") == "votable"


def test_binary_formats(kinds):
    import pyarrow as pa
    import pyarrow.parquet as pq

    over, data = written(kinds, "parquet", 2)
    table = pq.read_table(io.BytesIO(data))
    assert over and table.num_rows == 2 and table.schema.metadata[b"IVOA.VOTable.QUERY_STATUS"] == b"OVERFLOW" and table.schema.field("i").metadata[b"unit"] == b"m"
    over, data = written(kinds, "arrow")
    assert not over and pa.ipc.open_stream(data).read_all().num_rows == 3
    assert written(kinds, "csv", 0) == (True, b"i,s,d,t,b,a,raw\n")


def test_parts(kinds, spark, tmp_path):
    for f in ("parquet", "csv", "json", "votable"):
        results.write_parts(kinds, str(tmp_path / f), f)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    rows = sorted(r.value for r in spark.read.text(str(tmp_path / "votable")).collect())
    assert rows[0].startswith("<TR><TD>1</TD><TD>a,\"b\"&lt;&amp;&gt;</TD>") and "<TD/>" in rows[1]


def test_limits(spark):
    assert relational.limited(spark.range(50), 10).count() == 11 and relational.limited(spark.range(50), 0).count() == 1
    with pytest.raises(ValueError):
        relational.limited(spark.range(1), -1)


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (7, 2)], "a long, b long")
    assert [r.q for r in df.select(scalar.integer_divide(F.col("a"), F.col("b")).alias("q")).collect()] == [-3, -3, 3]
    row = spark.range(1).select(
        scalar.to_integer(F.lit(2.5)).alias("e"), scalar.to_integer(F.lit(3.5)).alias("o"), scalar.to_char(F.lit("abcdef"), 2).alias("c"), scalar.to_char(F.lit("a"), 3).alias("p"),
        scalar.truncate(F.lit(-2.789), 1).alias("t"), scalar.percent_encode(F.lit("a b/é~")).alias("u"), scalar.round_even(F.lit(2.5)).alias("r"),
    ).first()
    assert tuple(row) == (2, 4, "ab", "a  ", -2.7, "a%20b%2F%C3%A9~", 2.0)
    for bad in (scalar.natural_log(F.lit(0.0)), scalar.square_root(F.lit(-1.0)), scalar.arc_cosine(F.lit(2.0)), scalar.exponential(F.lit(1000.0)), scalar.integer_divide(F.lit(1), F.lit(0))):
        with pytest.raises(PySparkException):
            spark.range(1).select(bad.alias("x")).collect()


def test_documents(spark, small):
    t = plans.Tables(spark, small)
    tables = documents.flatten(plans.nested(t), plans.LEVELS)
    again = documents.flatten(documents.rebuild(tables, plans.LEVELS), plans.LEVELS)
    for name, df in tables.items():
        assert df.count() > 0 and df.exceptAll(again[name]).count() == 0 == again[name].exceptAll(df).count()
    with pytest.raises(ValueError):
        documents.amend(tables["orders"], F.lit(True), {"o_orderkey": F.lit(1)}, ["o_orderkey"])
    broken = documents.violations(t.lineitem, {"few": "l_quantity < 10"}).select("broken").distinct().collect()
    assert [r.broken for r in broken] == [["few"]]


def test_view_from_a_stream(spark, small, tmp_path):
    t = plans.Tables(spark, small)
    products, observed, artifacts = plans._view_tables(t)
    view = VersionedTable(spark, str(tmp_path / "view"))
    view.replace(observations.observation_view(products.filter("o_orderkey % 4 <> 1"), observed, artifacts, plans.SOURCE))
    products.filter("o_orderkey % 4 = 1").select("o_orderkey").write.parquet(str(tmp_path / "changes"))
    changes = spark.readStream.schema("o_orderkey long").parquet(str(tmp_path / "changes"))
    follow_changes(changes, view, lambda: (products, observed, artifacts), plans.SOURCE, str(tmp_path / "checkpoint")).awaitTermination(120)
    whole = observations.observation_view(products, observed, artifacts, plans.SOURCE)
    assert view.version() == 1 and view.read().exceptAll(whole).count() == 0 == whole.exceptAll(view.read()).count()
    made = products.limit(1).select(observations.publisher_id("ivo://x/", "o_orderkey", "o_orderpriority").alias("id")).first().id
    assert made.startswith("ivo://x/") and "%20" in made or "-" in made
