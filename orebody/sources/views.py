"""Logical tables over the driver's Parquet tables, as DataFrames and as the same SQL for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id, stars, date, seq: a review for each order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    stars = (F.col("l_quantity").cast("bigint") % 5 + 1).cast("double")
    return both.select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), stars.alias("stars"), F.col("o_orderdate").alias("date"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"))


def business_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("city"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows with the fields of the user files, made from customers and their orders."""
    from orebody.sources.files import COMPLIMENTS

    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    given = [((key + i) % (i + 3)).cast("bigint").alias(f"compliment_{c}") for i, c in enumerate(COMPLIMENTS)]
    return rows.select(
        key.alias("user_id"), ((key % 5) + 1).cast("double").alias("average_stars"), F.coalesce("n", F.lit(0)).alias("review_count"),
        (key % 17).alias("useful"), (key % 13).alias("funny"), (key % 11).alias("cool"), (key % 7).alias("fans"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")).alias("elite"), *given,
    )


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business rows with the fields of the business files, made from suppliers."""
    key = F.col("s_suppkey")
    kids = F.when(key % 2 == 0, F.lit("True")).otherwise(F.lit("False"))
    price = F.when(key % 5 == 0, F.lit("cheap")).otherwise((key % 4 + 1).cast("string"))
    attributes = F.when(key % 7 == 0, F.lit(None)).otherwise(F.create_map(F.lit("GoodForKids"), kids, F.lit("RestaurantsPriceRange2"), price))
    return table(spark, sf_dir, "supplier").select(key.alias("business_id"), ((key % 9) / 2 + 0.5).alias("stars"), (key % 100).alias("review_count"), attributes.alias("attributes"))


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("item")).distinct()


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").cast("string").alias("user_id"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, elem: the distinct lower-cased tokens, between single spaces, of each document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("elem"))
    return rows.where("elem <> ''").distinct()


def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, elems: the 64-bit hashes of the same tokens, a row for each document."""
    tokens = F.transform(F.array_remove(F.array_distinct(F.split(F.lower("text"), " ")), ""), lambda t: F.xxhash64(t))
    documents = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = documents.select(F.col("doc_id").alias("id"), tokens.alias("elems"))
    twice = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("id")
    if twice.isEmpty():
        return rows
    several = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("elems"))).alias("elems"))
    return rows.join(twice, "id", "left_anti").unionByName(several)


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item: who ordered which part."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("bigint").alias("label"))


def asked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business_id to predict, for all orders: known pairs, unknown users and unknown businesses."""
    orders = table(spark, sf_dir, "orders")
    user = F.when(F.col("o_orderkey") % 350 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    business = F.when(F.col("o_orderkey") % 550 == 0, F.lit(1_000_000_000).cast("bigint")).otherwise(F.col("o_orderkey") % 97 + 1)
    return orders.select(user.alias("user_id"), business.alias("business_id")).distinct()


#: The same tables as common table expressions.
SQL = {
    "reviews": "reviews AS (SELECT o_custkey AS user_id, l_suppkey AS business_id, CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS DOUBLE) AS stars, o_orderdate AS date, l_orderkey * 16 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "business_city": "business_city AS (SELECT s_suppkey AS business_id, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "pairs": "pairs AS (SELECT DISTINCT l_orderkey AS key, l_suppkey AS item FROM lineitem)",
    "stream": "stream AS (SELECT event_id + 1 AS seq, CAST(user_id AS VARCHAR) AS user_id FROM events)",
    "sets": "sets AS (SELECT DISTINCT id, elem FROM (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS elem FROM documents) WHERE elem <> '')",
    "bought": 'bought AS (SELECT DISTINCT o_custkey AS "user", l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey)',
    "asked": "asked AS (SELECT DISTINCT CASE WHEN o_orderkey % 350 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS user_id, CASE WHEN o_orderkey % 550 = 0 THEN 1000000000 ELSE o_orderkey % 97 + 1 END AS business_id FROM orders)",
    "dims": "dims AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
