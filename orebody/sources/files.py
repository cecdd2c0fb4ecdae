"""Readers with fixed schemas: JSON lines, CSV and numeric points; and local rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.plans.durable import durable

COMPLIMENTS = ["hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos"]

REVIEW = "user_id string, business_id string, stars double, date string"
BUSINESS_CITY = "business_id string, city string"
BUSINESS = "business_id string, stars double, review_count bigint, attributes map<string,string>"
USER = "user_id string, average_stars double, review_count bigint, useful bigint, funny bigint, cool bigint, fans bigint, elite string, " + ", ".join(f"compliment_{c} bigint" for c in COMPLIMENTS)
RATING = "user_id string, business_id string, stars string"
PAIR = "user_id string, business_id string"
TRANSACTION = "date string, customer string, c2 string, c3 string, c4 string, product string"


def json_lines(spark: SparkSession, path: str, schema: str, required: Iterable[str] = ()) -> DataFrame:
    """JSON lines; malformed lines fail the read, and so does a row without one of the required fields."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        df = df.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"missing field {name}")).cast(df.schema[name].dataType)))
    return df


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Comma-separated rows by position; quoted fields are understood."""
    return spark.read.schema(schema).option("header", header).option("enforceSchema", True).csv(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose stars are a number ('nan' is one)."""
    return valid_numbers(csv_rows(spark, path, RATING), "stars")


def valid_numbers(df: DataFrame, column: str) -> DataFrame:
    """df with column as double, without the rows where it isn't a number."""
    return df.withColumn(column, F.expr(f"try_cast(`{column}` AS double)")).where(F.col(column).isNotNull())


def points(spark: SparkSession, path: str) -> DataFrame:
    """Numeric matrix: id, an unused label, features."""
    cells = F.split(F.trim("value"), ",")
    return spark.read.text(path).select(
        F.get(cells, F.lit(0)).cast("double").cast("bigint").alias("id"),
        F.transform(F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))), lambda x: x.cast("double")).alias("features"),
    )


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, with its number from 1 on: files by name, lines in order, empty lines counted but left out.

    A file is read in blocks by several tasks; a line's number is its place in its block after the lines of the blocks
    before, of which there is one row each.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("user_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = durable(rows, "lines")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "block")) - F.col("n")).drop("n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return rows.join(base, ["file", "block"]).where(F.col("user_id") != "").select((F.col("base") + F.col("place")).alias("seq"), "user_id")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def basket_key(date: Column, customer: Column) -> Column:
    """date-customer without quotes and without the customer's leading zeros."""
    return F.concat_ws("-", bare(date), F.ltrim(bare(customer), F.lit("0")))


def bare(text: Column) -> Column:
    return F.trim(text, F.lit('"'))


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Baskets of retail transactions: key (date-customer) and item (product without leading zeros)."""
    rows = csv_rows(spark, path, TRANSACTION)
    return rows.select(basket_key(F.col("date"), F.col("customer")).alias("key"), F.ltrim(bare(F.col("product")), F.lit("0")).alias("item"))
