"""python -m lodestead.cli crawl|features|matrix: the steps as commands."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from lodestead import schemas, sinks
from lodestead.config import FeatureConfig
from lodestead.operators.matrix import build_model_matrix, summarize
from lodestead.plans.features import Responses
from lodestead.plans.run import build_from_csv

TABLES = ("fetch_log", "robots", "sitemap_docs", "link_checks", "css_files", "tls_certs", "whois")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestead")
    sub = parser.add_subparsers(dest="step", required=True)
    for name, what in (("crawl", "institutions -> visit their sites, then raw site features"), ("features", "institutions and tables of responses -> raw site features")):
        f = sub.add_parser(name, help=what)
        f.add_argument("csv_path")
        if name == "features":
            f.add_argument("responses", help="folder with fetch_log, robots, sitemap_docs, link_checks, css_files, tls_certs and whois as Parquet")
        else:
            f.add_argument("--pause", type=float, default=FeatureConfig.mid_run_pause_sec, help="seconds between two sites of a task, jittered")
            f.add_argument("--delay", type=float, default=FeatureConfig.request_delay_sec, help="seconds between two requests to a site")
            f.add_argument("--whois", action="store_true")
            f.add_argument("--tasks", type=int, default=64)
        f.add_argument("--url-column", default="school.school_url")
        f.add_argument("--id-column", default="UNITID")
        f.add_argument("--limit", type=int)
        f.add_argument("--insecure", action="store_true")
        f.add_argument("--max-pages", type=int, default=FeatureConfig.max_pages_per_site)
        f.add_argument("--inventory", help="folder for the URL lists of sitemaps")
        f.add_argument("--as-of", required=name == "features", help="date of the run, YYYY-MM-DD")
        f.add_argument("--checkpoint", default=FeatureConfig.checkpoint_path, help="results of this and earlier runs; URLs found there are not computed again")
        f.add_argument("--output", default=FeatureConfig.output_path)
    m = sub.add_parser("matrix", help="raw site features -> model matrix")
    m.add_argument("source")
    m.add_argument("--year", type=int)
    m.add_argument("--output", default="model_matrix")
    return parser


def read_responses(spark: SparkSession, folder: str) -> Responses:
    tables = {}
    for name in TABLES:
        schema = schemas.CRAWL_LOG if name == "fetch_log" else getattr(schemas, name.upper())
        tables[name] = spark.read.schema(schema).parquet(f"{folder}/{name}") if sinks.results(spark, f"{folder}/{name}") is not None else None
    return Responses(**tables)


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.step == "matrix":
        print(summarize(build_model_matrix(a.source, a.year, output_csv=a.output, spark=spark)[1]))
        return
    config = replace(FeatureConfig(), max_pages_per_site=a.max_pages, verify_ssl=not a.insecure, save_url_inventory_dir=a.inventory)
    if a.step == "crawl":
        config, got, tasks = replace(config, mid_run_pause_sec=a.pause, request_delay_sec=a.delay, lookup_whois=a.whois), None, a.tasks
    else:
        got, tasks = read_responses(spark, a.responses), 1
    build_from_csv(spark, a.csv_path, a.url_column, a.id_column, a.checkpoint, a.output, a.limit, got, a.as_of, config, tasks)


if __name__ == "__main__":
    main()
