"""Where results go: Parquet and CSV tables, the incremental results table, URL inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lodestead.functions.urls import file_name


def sanitised(df: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """Arrays sorted and without repeats, as a set is written; ``lists`` keep their order and repeats."""
    return df.withColumns({f.name: F.array_sort(F.array_distinct(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, ArrayType) and f.name not in lists})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns become JSON text."""
    flat = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The results table, None if there is none yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def todo(urls: DataFrame, done: DataFrame | None, key: str = "input_url") -> DataFrame:
    """What has no result yet."""
    return urls if done is None else urls.join(done.select(key), key, "left_anti")


def append_results(df: DataFrame, path: str) -> None:
    """Add a batch; the commit protocol makes it appear as a whole or not at all."""
    df.write.mode("append").parquet(path)


def write_inventory(inventory: DataFrame, domains: DataFrame, path: str) -> None:
    """All URLs of a site's sitemaps, one on a line, gzipped, in a folder per domain."""
    rows = inventory.where(F.size("urls") > 0).join(domains, "site_key").select(file_name(F.col("registered_domain")).alias("site"), F.explode("urls").alias("value"))
    rows.write.mode("append").partitionBy("site").option("compression", "gzip").text(path)
