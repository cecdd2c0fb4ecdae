"""Writers: one JSON report, CSV with a header, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; fields with commas are quoted. single: one file, for results of a bounded size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, line: str, path: str) -> None:
    df.select(F.col(line).cast("string")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(df.select("user_id", "business_id", "prediction"), path)


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """('a', 'b'), value: largest values first."""
    rows = edges.orderBy(F.col("betweenness").desc(), "a", "b")
    return rows.select(F.format_string("('%s', '%s'), %s", F.col("a").cast("string"), F.col("b").cast("string"), F.round("betweenness", 5).cast("string")).alias("line"))


def community_lines(groups: DataFrame) -> DataFrame:
    """'a', 'b', ... of each community: by size, then by members."""
    quoted = F.concat_ws(", ", F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))))
    return groups.select(F.size("members").alias("size"), quoted.alias("line")).orderBy("size", "line")
