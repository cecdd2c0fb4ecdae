"""Exploration: counts, distinct values, top lists, joins and averages, partitions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(reviews: DataFrame) -> DataFrame:
    return reviews.select("user_id", "business_id", "stars")


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def in_year(date: Column, kind: T.DataType, year: int) -> Column:
    """Dates kept as text are tested by their beginning."""
    return date.startswith(str(year)) if isinstance(kind, T.StringType) else F.year(date) == year


def count_year(reviews: DataFrame, year: int, name: str = "n_review_year") -> DataFrame:
    return reviews.agg(F.count_if(in_year(F.col("date"), reviews.schema["date"].dataType, year)).alias(name))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values; null is one of them."""
    return df.select(column).distinct().agg(F.count("*").alias(name))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; equal counts by value."""
    return count_by(df, column).orderBy(F.col("n").desc(), F.col(column).asc()).limit(k)


def city_stars(reviews: DataFrame, business: DataFrame) -> DataFrame:
    return reviews.join(business, "business_id").select("city", "stars")


def average_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(F.avg(value), 6).alias(name))


def top_average(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    return average_by(df, key, value, value).orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)


def _ranked(df: DataFrame, column: str) -> Column:
    """The top list as one array of [id, n], in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).alias("id")))), lambda x: F.array(x["id"], -x["m"]))


def report(reviews: DataFrame, year: int) -> DataFrame:
    """The exploration report as one JSON object in one row."""
    parts = [
        row_count(reviews, "n_review"),
        count_year(reviews, year),
        distinct_count(reviews, "user_id", "n_user"),
        top(reviews, "user_id").agg(_ranked(reviews, "user_id").alias("top10_user")),
        distinct_count(reviews, "business_id", "n_business"),
        top(reviews, "business_id").agg(_ranked(reviews, "business_id").alias("top10_business")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:  # rows of one row each
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    names = ["n_review", "n_review_year", "n_user", "top10_user", "n_business", "top10_business"]
    return out.select(F.to_json(F.struct(*names)).alias("report"))


def partition_counts(df: DataFrame, key: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows of each partition, empty ones too; with a key, after dealing the rows to `parts` partitions by it."""
    dealt = df if key is None else df.repartition(parts, key)
    every = df.sparkSession.range(dealt.rdd.getNumPartitions()).withColumnRenamed("id", "part")
    found = dealt.groupBy(F.spark_partition_id().cast("bigint").alias("part")).agg(F.count("*").alias("n"))
    return every.join(found, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n_items"))


def timed(make) -> tuple:
    """What make() returns, and the seconds that it took."""
    began = time.monotonic()
    out = make()
    return out, time.monotonic() - began


def partition_report(df: DataFrame, key: str, parts: int) -> DataFrame:
    """kind (default: as the rows come; customized: dealt to `parts` partitions by key), n_partition, n_items of each
    partition and exe_time, the seconds that counting them took."""
    rows = []
    for kind, make in (("default", lambda: partition_counts(df)), ("customized", lambda: partition_counts(df, key, parts))):
        found, seconds = timed(lambda make=make: [r["n_items"] for r in make().orderBy("part").collect()])  # a row a partition
        rows.append((kind, len(found), found, seconds))
    return df.sparkSession.createDataFrame(rows, "kind string, n_partition bigint, n_items array<bigint>, exe_time double")


def dict_encode(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """column and number: the values' ranks from 0 on.

    Values are ranked within ranges, and a range begins where the ones below it end: no window holds all values.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    sample = values.orderBy(F.xxhash64(column)).limit(16 * parts)  # a bounded sample only balances the ranges
    cuts = [row[0] for row in sample.orderBy(column).collect()][8::16]
    ranges = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(column))) if cuts else F.lit(0)
    rows = values.withColumn("range", ranges)
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).drop("n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(column)))
    return rows.join(F.broadcast(base), "range").select(column, (F.col("base") + F.col("place") - 1).alias("number"))  # parts + 1 rows at most
