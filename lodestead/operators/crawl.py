"""The crawl's decisions over a table of responses: what would be visited, in which order, and what robots.txt forbids.

Fetching itself is I/O (see ``lodestead.sources.fetch``).  Given a fetch log with links, the visiting order is a
breadth-first search in rounds of left anti joins; page and frontier caps are per site.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.config import FeatureConfig
from lodestead.functions import urls as U
from lodestead.session import ship, stage


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls(site_key, url, ...) with ``allowed`` by the site's robots.txt; no file allows everything."""
    ship(urls.sparkSession)
    rows = urls.join(robots, "site_key", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", allowed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, RobotFileParser] = {}
        for f in frames:
            out = []
            for text, url in zip(f["robots_text"], f["url"]):
                text = text or ""
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(known[text].can_fetch(agent, url))
            f["allowed"] = out
            yield f.drop(columns=["robots_text"])

    return rows.select(*urls.columns, "robots_text").mapInPandas(run, schema)


def refused(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The rows of urls(site_key, url, ...) that the site's robots.txt forbids; sites without rules are not looked at."""
    ruled = robots.where("robots_text rlike '(?i)disallow'").select("site_key", "robots_text")
    return allowed(urls.join(ruled.select("site_key"), "site_key", "left_semi"), ruled, agent).where("not allowed").drop("allowed")


def robots_blocked(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """site_key, robots_blocked_count over all of urls(site_key, url)."""
    return allowed(urls, robots, agent).groupBy("site_key").agg(F.count_if(~F.col("allowed")).alias("robots_blocked_count"))


def frontier_blocked(order: DataFrame, robots: DataFrame, pages: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """site_key, robots_blocked_count: refused URLs of the frontier (``crawl_order``) that come before the crawl ends, which
    it does with the page that reaches the cap.  pages(site_key, canon) are those that gave a page."""
    place = F.row_number().over(Window.partitionBy("site_key").orderBy("seq"))
    last = order.join(pages, ["site_key", "canon"], "left_semi").withColumn("place", place).where(F.col("place") == config.max_pages_per_site).select("site_key", F.col("seq").alias("last"))
    no = refused(order.select("site_key", F.col("canon").alias("url"), "seq"), robots, config.user_agent).join(last, "site_key", "left").where("last is null or seq < last")
    return order.select("site_key").distinct().join(no.groupBy("site_key").agg(F.count("*").alias("n")), "site_key", "left").select("site_key", F.coalesce("n", F.lit(0)).alias("robots_blocked_count"))


def page_cap(pages: DataFrame, config: FeatureConfig = FeatureConfig(), order: str = "page_seq") -> DataFrame:
    """The first pages of every site, renumbered from 0."""
    place = F.row_number().over(Window.partitionBy("site_key").orderBy(order))
    return pages.withColumn("_place", place).where(F.col("_place") <= config.max_pages_per_site).withColumn(order, F.col("_place") - 1).drop("_place")


def crawl_order(starts: DataFrame, links: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """starts(site_key, url), links(site_key, url, pos, target) -> site_key, canon, depth, seq: breadth first, each page
    once, at most the frontier cap of a site.  Ends with the first empty layer; each layer but the last adds a page under the
    cap, so there are never more layers than the cap."""
    cap = config.max_pages_per_site * 8
    canon = links.select("site_key", U.canonical_url(F.col("url")).alias("canon"), "pos", U.canonical_url(F.col("target")).alias("target"))
    seen = starts.select("site_key", U.canonical_url(F.col("url")).alias("canon"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("seq"))
    canon, _ = stage(canon, "links")
    spark, schema = seen.sparkSession, seen.schema
    layer, path = stage(seen, "layer")
    paths = [path]
    for depth in itertools.count(1):
        seen = spark.read.schema(schema).parquet(*paths)
        new = layer.join(canon, ["site_key", "canon"]).groupBy("site_key", F.col("target").alias("next")).agg(F.min(F.struct("seq", "pos")).alias("at"))
        new = new.join(seen.select("site_key", F.col("canon").alias("next")), ["site_key", "next"], "left_anti")
        base = seen.groupBy("site_key").agg(F.max("seq").alias("base"))
        rank = F.row_number().over(Window.partitionBy("site_key").orderBy("at", "next"))
        layer = new.join(base, "site_key").select("site_key", F.col("next").alias("canon"), F.lit(depth).alias("depth"), (F.col("base") + rank).alias("seq")).where(F.col("seq") <= cap)
        layer, path = stage(layer, "layer")
        if layer.isEmpty():
            return seen
        paths.append(path)
