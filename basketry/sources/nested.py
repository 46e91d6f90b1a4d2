"""Nested JSON files (forecasts, observations, foods, store receipts) and order reports with a preamble, as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<value:double>"
FORECAST = f"properties struct<periods:array<struct<name:string,startTime:string,temperature:double,relativeHumidity:{VALUE},shortForecast:string>>>"
OBSERVATION = f"properties struct<timestamp:string,temperature:{VALUE},relativeHumidity:{VALUE},precipitationLastHour:{VALUE}>"
FOODS = "foods array<struct<description:string,foodCategory:string>>"
ITEM = "struct<saleItem:struct<itemID:string>>"
STORE_RECEIPTS = f"Receipts struct<receipts:array<struct<transactionID:string,transactionDateTime:string,totals:struct<gross:string,grand:string>,itemsUngrouped:array<{ITEM}>>>>"
#: The first columns of an order report; those behind them are left out.
REPORT = ["Order Type", "Order ID", "Order Date", "No. of Shipment", "No. of Items"]


def to_celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """(name, d, temperature, humidity, summary), a row per period; a missing humidity is 0."""
    periods = _json(spark, path, FORECAST).select(F.explode("properties.periods").alias("p"))
    day = F.to_date(F.substring("p.startTime", 1, 10))
    return periods.select("p.name", day.alias("d"), "p.temperature", F.coalesce("p.relativeHumidity.value", F.lit(0.0)).alias("humidity"), F.col("p.shortForecast").alias("summary"))


def periods_on(periods: Column, day: Column) -> Column:
    """Of an array of periods with a date d, those of the day; where they are."""
    return F.filter(periods, lambda p: p["d"] == day)


def forecast_by_day(periods: DataFrame) -> DataFrame:
    """(d, high, humidity): of each day the highest temperature and humidity."""
    return periods.groupBy("d").agg(F.max("temperature").alias("high"), F.max("humidity").alias("humidity"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(at, temperature, humidity, precipitation); what is missing is 0."""
    zero = lambda c: F.coalesce(F.col(f"properties.{c}.value"), F.lit(0.0))
    at = F.try_to_timestamp(F.col("properties.timestamp"))
    return _json(spark, path, OBSERVATION).select(at.alias("at"), zero("temperature").alias("temperature"), zero("relativeHumidity").alias("humidity"), zero("precipitationLastHour").alias("precipitation"))


def read_food_categories(spark: SparkSession, path: str) -> DataFrame:
    """(source, category): the first food's category of each answer, in lower case with '_' for spaces; null if there is none."""
    raw = _json(spark, path, FOODS)
    return raw.select(F.col("_metadata.file_name").alias("source"), slug(F.try_element_at("foods", F.lit(1))["foodCategory"]).alias("category"))


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def read_store_receipts(spark: SparkSession, path: str) -> DataFrame:
    """(source, at, gross, grand, items): a row per receipt, with its items' ids in order."""
    receipts = _json(spark, path, STORE_RECEIPTS).select(F.explode("Receipts.receipts").alias("r"))
    at = F.timestamp_millis(F.regexp_extract("r.transactionDateTime", r"(-?\d+)", 1).try_cast("long"))
    ids = F.filter(F.transform("r.itemsUngrouped", lambda x: x["saleItem"]["itemID"]), lambda x: x.isNotNull())
    money = lambda c: F.col(f"r.totals.{c}").try_cast("double").alias(c)
    return receipts.select(F.col("r.transactionID").alias("source"), at.alias("at"), money("gross"), money("grand"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))


def read_order_report(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of reports below their header, which comes after a preamble of any length; files without the header have none. Columns are strings."""
    columns = columns or REPORT
    lines = F.split("value", r"\r?\n")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), lines.alias("lines"))
    header = F.array_position(F.transform("lines", lambda x: F.startswith(F.replace(x, F.lit('"'), F.lit("")), F.lit(columns[0]))), F.lit(True)).cast("int")
    body = raw.withColumn("header", header).where("header > 0").select("source", F.explode(F.slice("lines", F.col("header") + 1, F.size("lines"))).alias("line"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return body.where(F.trim("line") != "").select("source", F.from_csv("line", F.lit(schema)).alias("x")).select("source", *(F.col(f"x.`{c}`") for c in columns))
