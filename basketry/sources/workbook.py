"""Workbooks: frames as sheets with tables of one .xlsx file, and back.

Spark renders and writes the rows of a sheet as parts in the shared folder, in the frame's
order; the driver's JVM then copies the parts' bytes into the file one after another, through
whatever file system the path names, and gives the file its name when it is whole. So no rows
come to Python on the driver, a lost executor only costs its parts, and a run that fails leaves
no file. What a workbook can hold bounds what it may take: a frame beyond a sheet's rows or
columns, or a text beyond a cell's, is refused.

Nulls are empty cells and a frame without rows has its header alone. Numbers, booleans, dates
and times are cells of their kind; whole numbers and decimals of more than 15 digits, which
a cell would round, are texts, as are what isn't finite, times before 1 March 1900, and
arrays, maps and structs (JSON).
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.storage import delete, shared_path

# Fixed values of the format: what a sheet and a cell may hold, names of parts' kinds and namespaces, the day from which dates are counted, and the table's style.
MOST_ROWS, MOST_COLUMNS, MOST_CHARACTERS, MOST_NAME, DIGITS = 1_048_576, 16_384, 32_767, 31, 15
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
FIRST_DAY, FIRST_SURE = dt.date(1899, 12, 30), dt.date(1900, 3, 1)
TABLE_STYLE = "TableStyleMedium9"
DATE, TIME = 1, 2
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ...: the name of the column behind i others."""
    name = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        name = chr(ord("A") + rest) + name
    return name


def _text(c: Column, name: str) -> Column:
    too_long = F.raise_error(F.lit(f"a text of column {name} is longer than a cell")).cast("string")
    plain = F.regexp_replace(c, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(x.rlike(_CONTROL), F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(x)), 4, "0"), F.lit("_"))).otherwise(x)), "")
    safe = F.when(plain.rlike(_CONTROL), spelt).otherwise(plain)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    cell = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), safe, F.lit("</t></is></c>"))
    return F.when(F.length(c) > MOST_CHARACTERS, too_long).otherwise(cell)


def _number(c: Column, style: int = 0) -> Column:
    return F.concat(F.lit(f'<c s="{style}"><v>' if style else "<c><v>"), c.cast("string"), F.lit("</v></c>"))


def cell(c: Column, kind: T.DataType, name: str) -> Column:
    """The markup of a column's cells."""
    text = _text(c.cast("string"), name)
    if isinstance(kind, T.BooleanType):
        found = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        found = F.when(F.isnan(c) | (F.abs(c) == float("inf")), text).otherwise(_number(c))
    elif isinstance(kind, T.NumericType):
        found = F.when(F.length(F.regexp_replace(c.cast("string"), "[^0-9]", "")) > DIGITS, text).otherwise(_number(c))
    elif isinstance(kind, T.DateType):
        found = F.when(c < F.lit(FIRST_SURE), text).otherwise(_number(F.datediff(c, F.lit(FIRST_DAY)), DATE))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = c.cast("date")
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
        found = F.when(day < F.lit(FIRST_SURE), text).otherwise(_number(F.datediff(day, F.lit(FIRST_DAY)) + seconds / 86400, TIME))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        found = _text(F.to_json(c), name)
    else:
        found = text
    return F.coalesce(found, F.lit("<c/>"))


def rows_of(df: DataFrame) -> DataFrame:
    """value: the markup of each row, on one line, in the frame's order. A part ends with an error once it alone has more rows than a sheet, so no more is written of a frame that is too long."""
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    begin = F.when(here >= MOST_ROWS - 1, F.raise_error(F.lit("more rows than a sheet holds")).cast("string")).otherwise(F.lit("<row>"))
    return df.select(F.concat(begin, *(cell(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType, f.name) for f in df.schema), F.lit("</row>")).alias("value"))


def _checked(frames: dict[str, DataFrame]) -> None:
    if not frames:
        raise ValueError("a workbook has one sheet at least")
    if len({x.lower() for x in frames}) < len(frames):
        raise ValueError("names of sheets differ by more than case")
    for name, df in frames.items():
        if not name or len(name) > MOST_NAME or re.search(r"[\[\]:*?/\\]|^'|'$", name):
            raise ValueError(f"not a name of a sheet: {name!r}")
        if not 1 <= len(df.columns) <= MOST_COLUMNS:
            raise ValueError(f"sheet {name}: {len(df.columns)} columns")
        if len({c.lower() for c in df.columns}) < len(df.columns) or not all(df.columns):
            raise ValueError(f"sheet {name}: a table's columns have names that differ by more than case")


def _written(text: str) -> str:
    """A name in markup."""
    return "".join(f"_x{ord(x):04X}_" if re.match(_CONTROL + "|[\t\n]", x) else x for x in re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text))


def _plain_parts(frames: dict[str, DataFrame], counts: list[int]) -> Iterator[tuple[str, str]]:
    """All of the file but its sheets: names and texts."""
    n = range(1, len(frames) + 1)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/><Override PartName="/xl/tables/table{k}.xml" ContentType="{KIND}.table+xml"/>' for k in n)
    kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>'
    yield "[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>'
    relations = lambda *rows: f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{RELATION}/{kind}" Target="{to}"/>' for i, kind, to in rows) + "</Relationships>"
    yield "_rels/.rels", relations(("rId1", "officeDocument", "xl/workbook.xml"))
    sheets = "".join(f'<sheet name={quoteattr(_written(name))} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, frames))
    yield "xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets>{sheets}</sheets></workbook>'
    yield "xl/_rels/workbook.xml.rels", relations(*((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in n), ("rIdStyles", "styles", "styles.xml"))
    formats = "".join(f'<xf numFmtId="{k}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for k in (0, 14, 22))
    yield "xl/styles.xml", (
        f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>'
    )
    for k, df, rows in zip(n, frames.values(), counts):
        # A table has one row below its header at least.
        ref = f"A1:{column_name(len(df.columns) - 1)}{max(rows, 1) + 1}"
        columns = "".join(f'<tableColumn id="{i}" name={quoteattr(_written(c))}/>' for i, c in enumerate(df.columns, 1))
        style = f'<tableStyleInfo name="{TABLE_STYLE}" showFirstColumn="0" showLastColumn="0" showRowStripes="1" showColumnStripes="0"/>'
        yield f"xl/tables/table{k}.xml", f'<table xmlns="{MAIN}" id="{k}" name="Table{k}" displayName="Table{k}" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(df.columns)}">{columns}</tableColumns>{style}</table>'
        yield f"xl/worksheets/_rels/sheet{k}.xml.rels", relations(("rId1", "table", f"../tables/table{k}.xml"))


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as a sheet of its name with a table in one .xlsx file, which takes the place of an older one. A frame's rows come in its order: sort it where that matters."""
    _checked(frames)
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    staged, counts = [], []
    half = f"{path}.{uuid.uuid4().hex}"
    fs = place(path).getFileSystem(conf)
    try:
        for name, df in frames.items():
            staged.append(shared_path(spark, "sheet"))
            rows_of(df).write.text(staged[-1])
            counts.append(spark.read.text(staged[-1]).count())
            if counts[-1] > MOST_ROWS - 1:
                raise ValueError(f"sheet {name}: more than {MOST_ROWS - 1} rows and a header")
        out = jvm.java.util.zip.ZipOutputStream(fs.create(place(half), True))
        try:

            def put(name: str, *texts) -> None:
                out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
                for x in texts:
                    out.write(bytearray(x.encode()))

            for name, text in _plain_parts(frames, counts):
                put(name, _HEAD + text)
                out.closeEntry()
            for k, (df, folder) in enumerate(zip(frames.values(), staged), 1):
                header = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_written(c))}</t></is></c>' for c in df.columns)
                put(f"xl/worksheets/sheet{k}.xml", f'{_HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{RELATION}"><sheetData><row>{header}</row>')
                own = place(folder).getFileSystem(conf)
                for part in sorted(x.getPath().toString() for x in own.listStatus(place(folder)) if x.getPath().getName().startswith("part-")):
                    source = own.open(place(part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                    finally:
                        source.close()
                out.write(bytearray(b'</sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>'))
                out.closeEntry()
        finally:
            out.close()
        fs.delete(place(path), False)
        if not fs.rename(place(half), place(path)):
            raise OSError(f"couldn't write {path}")
    finally:
        fs.delete(place(half), False)
        for folder in staged:
            delete(spark, folder)


def write_workbooks(frames: dict[str, DataFrame], folder: str, name: str = "") -> list[str]:
    """Each frame as a workbook of its own: paths, with the name before those of the frames where one is given."""
    paths = [f"{folder}/{name}{'_' if name else ''}{key}.xlsx" for key in frames]
    for path, (key, df) in zip(paths, frames.items()):
        write_workbook({key[:MOST_NAME]: df}, path)
    return paths


def write_report(frames: dict[str, DataFrame], folder: str, name: str) -> str:
    """All frames in one workbook, with the time in its name: its path."""
    path = f"{folder}/{name}_{dt.datetime.now():%Y%m%d_%H%M%S}.xlsx"
    write_workbook(frames, path)
    return path


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Of a workbook: names of sheets, numbers of rows from 1, and cells as texts (null where empty); a sheet's markup is read element by element."""
    spelt = lambda x: re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), x)
    with zipfile.ZipFile(BytesIO(content)) as book:
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
            with book.open("xl/" + targets[sheet.get(f"{{{RELATION}}}id")]) as part:
                n = 0
                for _, row in ElementTree.iterparse(part):
                    if row.tag == f"{{{MAIN}}}row":
                        n += 1
                        cells = []
                        for c in row.iter(f"{{{MAIN}}}c"):
                            found = c.find(f"{{{MAIN}}}v") if c.get("t") != "inlineStr" else c.find(f"{{{MAIN}}}is/{{{MAIN}}}t")
                            cells.append(None if found is None else spelt(found.text or "") if c.get("t") == "inlineStr" else found.text)
                        yield spelt(sheet.get("name")), n, cells
                        row.clear()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of workbooks as written here: a header is row 1, dates and times are days since 30 December 1899. A file, which the format bounds, is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for found in sheet_rows(content):
                    rows.append((file, *found))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, sheet string, row int, cells array<string>")
