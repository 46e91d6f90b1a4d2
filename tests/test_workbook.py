"""Workbooks, read again with the standard library alone."""

import datetime as dt
import zipfile
from decimal import Decimal
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from basketry.operators import lookups
from basketry.sources import workbook as W

ODD = "a\r\n<b> & \"c\"\t_x0041_ \x01\x1f \U0001f600  end "


def cells_of(path, sheet=1):
    """Rows of (type, style, text), as the file has them."""
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        root = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml"))
        for name in book.namelist():
            ElementTree.fromstring(book.read(name))
    return [[(c.get("t"), c.get("s"), "".join(c.itertext())) for c in row] for row in root.iter(f"{{{W.MAIN}}}row")]


def test_kinds_of_cells(spark, tmp_path):
    row = (ODD, 7, 10**16, 1.5, float("nan"), True, dt.date(2030, 1, 2), dt.date(1899, 1, 1), dt.datetime(2030, 1, 2, 6, 0), Decimal("12.50"), ["x"])
    df = spark.createDataFrame([row, (None,) * 11, ("", 0, 0, 0.0, 0.0, False, None, None, None, Decimal(0), [])], "t string, i int, l long, d double, nan double, b boolean, day date, old date, at timestamp, m decimal(10,2), a array<string>")
    path = str(tmp_path / "book.xlsx")
    W.write_workbook({"odd": df.coalesce(1)}, path)
    head, one, none, zero = cells_of(path)
    assert [x[2] for x in head] == df.columns
    serial = (dt.date(2030, 1, 2) - dt.date(1899, 12, 30)).days
    assert one[0] == ("inlineStr", None, 'a_x000D_\n<b> & "c"\t_x005F_x0041_ _x0001__x001F_ \U0001f600  end ')
    assert one[1:6] == [(None, None, "7"), ("inlineStr", None, str(10**16)), (None, None, "1.5"), ("inlineStr", None, "NaN"), ("b", None, "1")]
    assert one[6:9] == [(None, "1", str(serial)), ("inlineStr", None, "1899-01-01"), (None, "2", f"{serial}.25")] and one[9:] == [(None, None, "12.50"), ("inlineStr", None, '["x"]')]
    assert none == [(None, None, "")] * 11 and zero[0] == ("inlineStr", None, "")
    got = W.read_workbook(spark, path).orderBy("row").collect()
    assert [(r.sheet, r.row) for r in got] == [("odd", k) for k in (1, 2, 3, 4)] and got[1].cells[0] == ODD and got[2].cells == [None] * 11 and got[3].cells[0] == ""


def test_order_of_many_parts_and_tables(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    many = spark.range(5000).repartition(7).orderBy(F.col("id").desc())
    W.write_workbook({"many": many, "none & more": spark.range(0)}, path)
    assert [r[0][2] for r in cells_of(path)[1:]] == [str(k) for k in range(4999, -1, -1)]
    assert cells_of(path, 2) == [[("inlineStr", None, "id")]]
    with zipfile.ZipFile(path) as book:
        refs = [ElementTree.fromstring(book.read(f"xl/tables/table{k}.xml")).get("ref") for k in (1, 2)]
        assert refs == ["A1:A5001", "A1:A2"] and b"none &amp; more" in book.read("xl/workbook.xml")
    W.write_workbook({"few": spark.range(1)}, path)
    assert len(cells_of(path)) == 2 and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["book.xlsx"]


def test_what_no_workbook_holds_is_refused(spark, tmp_path, monkeypatch):
    df, path = spark.range(40), str(tmp_path / "book.xlsx")
    for frames in ({}, {"a/b": df}, {"x" * 32: df}, {"a": df, "A": df}, {"a": df.select("id", F.lit(1).alias("ID"))}, {"a": df.select()}):
        with pytest.raises(ValueError):
            W.write_workbook(frames, path)
    with pytest.raises(Exception, match="longer than a cell"):
        W.write_workbook({"a": df.select(F.repeat(F.lit("x"), W.MOST_CHARACTERS + 1).alias("t"))}, path)
    monkeypatch.setattr(W, "MOST_ROWS", 21)
    with pytest.raises(Exception, match="more rows than a sheet"):
        W.write_workbook({"a": df.coalesce(1)}, path)
    with pytest.raises(ValueError, match="more than 20 rows"):
        W.write_workbook({"a": df.repartition(4)}, path)
    W.write_workbook({"a": df.limit(20)}, path)
    assert len(cells_of(path)) == 21 and len([x for x in tmp_path.iterdir() if not x.name.startswith(".")]) == 1


def test_names_of_columns_and_files(spark, tmp_path):
    assert [W.column_name(k) for k in (0, 25, 26, 701, 702, W.MOST_COLUMNS - 1)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    paths = W.write_workbooks({"one": spark.range(2), "two": spark.range(1)}, str(tmp_path), "e32")
    assert [x.rsplit("/", 1)[1] for x in paths] == ["e32_one.xlsx", "e32_two.xlsx"] and [len(cells_of(x)) for x in paths] == [3, 2]
    assert len(cells_of(W.write_report({"one": spark.range(2), "two": spark.range(1)}, str(tmp_path), "all"), 2)) == 2


def test_inspected(spark):
    df = spark.createDataFrame([(1, 1, 0, 2.5), (2, None, 1, None)], "k int, milk int, salt int, since double")
    got = lookups.inspected(df, ["k"], ["milk", "salt"], ["since"]).orderBy("k").collect()
    assert [(r.k, r["items"], r["values"]) for r in got] == [(1, ["milk"], {"since": "2.5"}), (2, ["salt"], {"since": None})]
