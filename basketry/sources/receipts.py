"""Receipt texts to items, by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.text import compatible

# What a receipt's lines look like. White space is one space by then.
DATE_TIME = r"(?i)(\d{1,2}/\d{1,2}/\d{2,4}) *(?:,? *at +)?(\d{1,2}:\d{2}(?: *[ap]m)?)"
HEADER, STRICT_HEADER = "(?i)Reg +You *Pay", "(?i)^Reg +You +Pay$"
ITEM_LINE = r"(?i)^(?:QTY *(\d+) +)?(.*?) \$(\d+\.\d{2}) \$(\d+\.\d{2})(?: [A-Z])?$"
OCR_QTY = r"(?i)^[qo]ty[- ]*(\d+) *-? *(.+)$"
STOP = r"(?i)\btotal *(?:number *of *)?items *sold\b[^0-9]*([0-9]+)"


def read_receipts(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, value): one row per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")


def clean_name(c):
    """'&' to 'and', white space to '-', letters, digits and '-' only, lower case."""
    s = F.replace(c, F.lit("&"), F.lit("and"))
    for pattern, new in ((r"\s+", "-"), ("[^A-Za-z0-9-]", ""), ("-+", "-")):
        s = F.regexp_replace(s, pattern, new)
    return F.lower(s)


def parse(receipts: DataFrame, strict: bool = False) -> DataFrame:
    """(source, value) to (source, date, time, manager, cashier, reported, items, validation). strict: the header is a line of its own, and names are left as they are, without amends of quantities."""
    lines = F.filter(F.transform(F.split(compatible(F.col("value")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    df = receipts.select("source", lines.alias("lines")).withColumn("text", F.array_join("lines", "\n"))
    header = F.array_position(F.transform("lines", lambda x: x.rlike(STRICT_HEADER if strict else HEADER)), F.lit(True))
    df = df.withColumn("header", header.cast("int"))
    body = F.when(F.col("header") > 0, F.slice("lines", F.col("header") + 1, F.size("lines"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("body", body)
    stop = F.array_position(F.transform("body", lambda x: x.rlike(STOP)), F.lit(True)).cast("int")
    df = df.withColumn("stop", stop)
    reported = F.when(F.col("stop") > 0, F.regexp_extract(F.element_at("body", F.col("stop")), STOP, 1).cast("int"))
    rows = F.when(F.col("stop") > 0, F.slice("body", 1, F.col("stop") - 1)).otherwise(F.col("body"))
    wanted = F.filter(rows, lambda x: x.rlike(ITEM_LINE) & ~x.rlike(r"(?i)^you *save\b") & ~x.rlike("(?i)^CPN SCANNED COUPON"))

    def item(x):
        name, qty = F.regexp_extract(x, ITEM_LINE, 2), F.regexp_extract(x, ITEM_LINE, 1)
        ocr = F.lit(False) if strict else name.rlike(OCR_QTY)
        clean = (lambda c: c) if strict else clean_name
        return F.struct(
            clean(F.when(ocr, F.regexp_extract(name, OCR_QTY, 2)).otherwise(name)).alias("item"),
            F.when(ocr, F.regexp_extract(name, OCR_QTY, 1).try_cast("int")).otherwise(F.coalesce(qty.try_cast("int"), F.lit(1))).alias("qty"),
            F.regexp_extract(x, ITEM_LINE, 3).cast("double").alias("reg"),
            F.regexp_extract(x, ITEM_LINE, 4).cast("double").alias("youPay"),
        )

    found = lambda p, k: F.nullif(F.trim(F.regexp_extract("text", p, k)), F.lit(""))
    df = df.select(
        "source", found(DATE_TIME, 1).alias("date"), found(DATE_TIME, 2).alias("time"), found(r"(?i)store *manager *: *([^\n]+)", 1).alias("manager"), found(r"(?i)your *cashier *: *([^\n]+)", 1).alias("cashier"), reported.alias("reported"), F.transform(wanted, item).alias("items")
    )
    total = F.aggregate("items", F.lit(0), lambda a, x: a + x["qty"])
    same = lambda n: F.coalesce(n == F.col("reported"), F.lit(False))
    return df.withColumn("validation", F.struct(same(F.size("items")).alias("rowsMatchReported"), same(total).alias("qtyMatchReported"), F.size("items").alias("rowsCount"), total.alias("qtySum")))


def items_of(parsed: DataFrame, *columns) -> DataFrame:
    """The columns and i, a row per item. An inner explode would have the optimizer work out the items once more, in a filter below the parse, to see whether there are any; so receipts without items are left out behind it."""
    return parsed.select(*columns, F.explode_outer("items").alias("i")).where("i IS NOT NULL")


def events(parsed: DataFrame) -> DataFrame:
    """(source, d, t, item, qty), a row per item."""
    day = F.coalesce(F.try_to_timestamp("date", F.lit("M/d/yyyy")), F.try_to_timestamp("date", F.lit("M/d/yy"))).cast("date")
    return items_of(parsed, "source", day.alias("d"), F.col("time").alias("t")).select("source", "d", "t", "i.item", "i.qty")
