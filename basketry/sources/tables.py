"""Readers of order, weather, check-list and dictionary files, and writers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The weather columns used, and their names here.
WEATHER = {"temp": "temp_feat", "feelslike": "feelsLike_feat", "humidity": "humidity_feat", "precip": "precip_feat", "windspeed": "windspeed_feat", "sealevelpressure": "sealevelpressure_feat"}


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of orders by their first line. As the driver lists the files anyway, this has a row for each."""
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
    own = lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("n"))
    found: dict[str, list[str]] = {}
    for r in own.groupBy("file").agg(F.min_by("value", "n").alias("header")).orderBy("file").collect():
        found.setdefault(r["header"].lstrip("\ufeff"), []).append(r["file"])
    return found


def read_orders(spark: SparkSession, path: str, quoted_breaks: bool = True) -> DataFrame:
    """CSV orders as (source, date, item, qty); brand words are removed from names. Columns are found by each file's own header, which is one line, in any order and number; columns that a file lacks, dates and quantities that are none, are null. Values may hold line breaks in quotes; without quoted_breaks they may not, and large files are read in splits."""
    out = spark.createDataFrame([], "source string, date date, item string, qty int")
    for header, files in headers(spark, path).items():
        names = [x.strip() for x in next(csv.reader([header]), [])]
        schema = ", ".join(f"c{i} string" for i in range(max(1, len(names))))
        raw = spark.read.options(header=True, multiLine=quoted_breaks, escape='"', enforceSchema=True).schema(schema).csv(files)
        value = lambda name: F.col(f"c{names.index(name)}") if name in names else F.lit(None).cast("string")  # noqa: B023, E731
        item = F.regexp_replace(F.replace(F.replace(value("Product Description"), F.lit("Great Value"), F.lit("")), F.lit("Freshness Guaranteed"), F.lit("")), r"^\s+|\s+\z", "")
        rows = raw.select(F.col("_metadata.file_name").alias("source"), F.try_to_timestamp(value("Order Date")).cast("date").alias("date"), item.alias("item"), value("Product Quantity").try_cast("int").alias("qty"))
        out = out.unionByName(rows)
    return out


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.to_date("datetime").alias("date"), *(F.col(a).try_cast("double").alias(b) for a, b in WEATHER.items()))


def read_check_list(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    return raw.select(F.try_to_timestamp("datetime").alias("datetime"), "location", F.regexp_replace("cost", "[$,]", "").try_cast("double").alias("cost"), F.regexp_extract("itemcount", r"(\d+)", 1).try_cast("int").alias("itemcount"))


def read_dictionary(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(item, item_id) of a dictionary written as JSON rows. A row without a name or a number is an error; without strict it is left out."""
    raw = spark.read.schema("item string, item_id long").json(path)
    if not strict:
        return raw.where("item IS NOT NULL AND item_id IS NOT NULL")
    bad = F.col("item").isNull() | F.col("item_id").isNull()
    checked = F.when(bad, F.raise_error(F.lit("a row of the dictionary lacks its name or number")).cast("string")).otherwise(F.col("item"))
    return raw.select(checked.alias("item"), "item_id")


def read_snapshot(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A frame that was written as Parquet; columns that are asked for must be there."""
    frame = spark.read.parquet(path)
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"missing columns: {missing}")
    return frame


def read_frame_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frame that was written as CSV, by the schema that it had."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def manual_entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Purchases entered by hand, as (source, date, item, qty)."""
    return spark.createDataFrame(rows, "source string, date date, item string, qty int")


def frozen_events(panel: DataFrame, label: str = "buy") -> DataFrame:
    if label not in panel.columns:
        raise ValueError(f"no column {label}")
    return panel.where(F.col(label) == 1)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as CSV in a folder of its name, of any size; workbook.write_workbook writes one file of bounded sheets."""
    for name, df in frames.items():
        write_csv(df, f"{path}/{name}")
