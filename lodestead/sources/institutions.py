"""The list of institutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.functions.urls import normalize_url


def read_institutions(spark: SparkSession, path: str, url_column: str = "school.school_url", id_column: str = "UNITID") -> DataFrame:
    """CSV -> id and url as written, normalized_url, ordinal of the row; ids stay text, rows without a URL go."""
    return institutions(spark.read.option("header", True).csv(path), url_column, id_column)


def institutions(table: DataFrame, url_column: str, id_column: str) -> DataFrame:
    missing = [c for c in (id_column, url_column) if c not in table.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    df = table.select(F.col(f"`{id_column}`").cast("string").alias(id_column), F.col(f"`{url_column}`"), F.monotonically_increasing_id().alias("ordinal"))
    return df.dropna(subset=[f"`{url_column}`"]).withColumn("normalized_url", normalize_url(F.col(f"`{url_column}`")))


def shared_urls(inputs: DataFrame) -> int:
    """Rows beyond the first of their URL."""
    rows, urls = inputs.agg(F.count("*"), F.count_distinct("normalized_url")).first()
    return rows - urls


def unique_urls(inputs: DataFrame, limit: int | None = None) -> DataFrame:
    """input_url: each normalized URL once; with a limit the first by input order."""
    urls = inputs.groupBy(F.col("normalized_url").alias("input_url")).agg(F.min("ordinal").alias("ordinal"))
    return (urls.orderBy("ordinal").limit(limit) if limit else urls).select("input_url")


def join_back(inputs: DataFrame, features: DataFrame, only_found: bool = False) -> DataFrame:
    """Features on every institution; with ``only_found`` institutions without features go."""
    out = inputs.drop("ordinal").join(features, inputs["normalized_url"] == features["input_url"], "left").drop("normalized_url")
    return out.where("input_url is not null") if only_found else out
