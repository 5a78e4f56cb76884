"""From a CSV of institutions to features on disk: what the command does, as a function."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead import schemas, sinks
from lodestead.config import FeatureConfig
from lodestead.plans.features import Responses, build_feature_dataframe
from lodestead.sources.institutions import read_institutions, shared_urls, unique_urls


def build_from_csv(
    spark: SparkSession, csv_path: str, url_column: str = "school.school_url", id_column: str = "UNITID", checkpoint_path: str | None = None, output_csv: str | None = None, limit: int | None = None,
    got: Responses | None = None, as_of: str | None = None, config: FeatureConfig = FeatureConfig(), tasks: int = 64,
) -> DataFrame:
    """Features of all institutions, written as CSV and returned as written.

    Sites without a result in ``checkpoint_path`` are visited, unless their responses are given, and their results are
    appended there.  What a crawl was answered is kept beside the results, a folder for each run.
    """
    checkpoint, output = checkpoint_path or config.checkpoint_path, output_csv or config.output_path
    inputs = read_institutions(spark, csv_path, url_column, id_column)
    done, moment = sinks.results(spark, checkpoint), datetime.now(timezone.utc)
    before = 0 if done is None else done.count()
    print(f"{inputs.count()} institutions, {shared_urls(inputs)} of which share a URL with another; {before} sites done before")
    if not config.verify_ssl:
        print("certificates are not verified")
    if got is None:
        from lodestead.sources import crawl

        at = f"{checkpoint}-answers/{moment:%Y%m%dT%H%M%S%f}"
        sinks.write_table(crawl.crawl(sinks.todo(unique_urls(inputs, limit), done), config, tasks), at)
        got = crawl.responses(spark.read.schema(schemas.ANSWERS).parquet(at))
    out = build_feature_dataframe(inputs, got, F.lit(as_of or f"{moment:%Y-%m-%d %H:%M:%S}").cast("timestamp"), config, done, limit, checkpoint)
    sinks.write_csv(out, output)
    print(f"{sinks.results(spark, checkpoint).count() - before} sites done now; saved: {output}")
    return spark.read.option("header", True).csv(output)
