"""Sitemaps: discovery, bounded expansion of indexes, inventory and its features."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.config import DEFAULT_SITEMAPS, EXPECTED_SECTIONS, FeatureConfig
from lodestead.functions import patterns as R
from lodestead.functions import urls as U
from lodestead.session import ship, stage


GZIP = b"\x1f\x8b"


def decode(content: bytes | None, url: str) -> str | None:
    """Text of a fetched sitemap, None if it cannot be unpacked."""
    if content is None:
        return None
    try:
        if url.lower().endswith(".gz") or content[:2] == GZIP:
            content = gzip.decompress(content)
        return content.decode("utf-8", "ignore")
    except (OSError, EOFError):
        return None


def parse_documents(docs: DataFrame) -> DataFrame:
    """sitemap_docs -> site_key, url, locs, lastmods, is_index; one row per document with status 200."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"site_key": f["site_key"], "url": f["url"], "body": [decode(None if c is None else bytes(c), u) for c, u in zip(f["content"], f["url"])]})

    text = docs.where("status = 200").select("site_key", "url", "content").mapInPandas(run, "site_key string, url string, body string").where("body is not null")
    return text.select("site_key", "url", R.found_all(F.col("body"), R.SITEMAP_LOC, 1).alias("locs"), R.found_all(F.col("body"), R.SITEMAP_LASTMOD, 1).alias("lastmods"), F.lower("body").contains("<sitemapindex").alias("is_index"))


def candidates(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """site_key, queue, source: the sitemaps that robots.txt names, else the usual places."""
    named = F.coalesce(R.found_all(F.col("robots_text"), R.SITEMAP_DIRECTIVE, 1), F.array().cast("array<string>"))
    base = F.regexp_extract("base_url", r"^([^:/?#]+://[^/?#]*)", 1)
    usual = F.array(*[F.concat(base, F.lit(p)) for p in DEFAULT_SITEMAPS])
    df = sites.join(robots, "site_key", "left").withColumn("named", named)
    return df.select("site_key", F.when(F.size("named") > 0, F.col("named")).otherwise(usual).alias("queue"), F.when(F.size("named") > 0, "robots").otherwise("default_path").alias("source"))


def collect_inventory(sites: DataFrame, robots: DataFrame, docs: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """sites(site_key, base_url) -> one row per site with urls, lastmods and what was fetched.

    The walk takes at most ``max_sitemap_files`` steps and is the same for every site, so it is a loop of as many joins
    on (site_key, next url); each takes the head of every site's queue.  Documents are parsed once and staged; the loop
    carries queues, what was seen and a count, and the URLs are fetched after it.
    """
    parsed, _ = stage(parse_documents(docs).withColumnRenamed("url", "head"), "sitemaps")
    # a missing document counts as fetched and is skipped, like an error of the reference's fetch
    there = parsed.select("site_key", "head", "is_index", F.size("locs").alias("n_locs"), F.when(F.col("is_index"), F.col("locs")).alias("more"))
    state = candidates(sites, robots).select("site_key", "source", "queue", F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n_urls"), F.lit(False).alias("found"))
    for _ in range(config.max_sitemap_files):
        # heads that were seen before cost nothing: they go before one is taken
        state = state.withColumn("queue", F.filter("queue", lambda u: ~F.array_contains(F.col("seen"), u)))
        head = F.when((F.size("queue") > 0) & (F.col("n_urls") < config.max_sitemap_urls), F.get("queue", F.lit(0)))
        state = state.withColumn("head", head).join(there, ["site_key", "head"], "left")
        good, stays = F.coalesce(F.col("n_locs") > 0, F.lit(False)), F.col("head").isNull()
        rest = F.slice("queue", F.lit(2), F.greatest(F.size("queue") - 1, F.lit(0)))
        state = state.select(
            "site_key", "source", F.when(stays, F.col("queue")).when(good & F.col("is_index"), F.concat(rest, "more")).otherwise(rest).alias("queue"),
            F.when(stays, F.col("seen")).otherwise(F.concat("seen", F.array("head"))).alias("seen"),
            (F.col("n_urls") + F.when(good & ~F.col("is_index"), F.col("n_locs")).otherwise(0)).alias("n_urls"), (F.col("found") | good).alias("found"))
        state, _ = stage(state, "walk")
    visited = state.select("site_key", F.posexplode("seen").alias("pos", "head")).join(parsed.where("not is_index"), ["site_key", "head"])
    lists = visited.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("pos", "locs", "lastmods"))).alias("x"))
    lists = lists.select("site_key", F.flatten(F.transform("x", lambda d: d["locs"])).alias("urls"), F.flatten(F.transform("x", lambda d: d["lastmods"])).alias("lastmods"))
    none, fetched = F.array().cast("array<string>"), F.size("seen")
    many, files = F.col("n_urls") > config.max_sitemap_urls, (F.size("queue") > 0) & (fetched >= config.max_sitemap_files)
    return state.join(lists, "site_key", "left").select(
        "site_key", F.slice(F.coalesce("urls", none), 1, config.max_sitemap_urls).alias("urls"), F.coalesce("lastmods", none).alias("lastmods"), F.col("found").alias("sitemap_found"),
        F.when(F.col("found"), F.col("source")).alias("sitemap_source"), fetched.cast("bigint").alias("sitemap_files_fetched"), (many | files).alias("sitemap_truncated"))


def lastmod_date(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-M-d")


def inventory_urls(urls: DataFrame, key: str = "site_key", expected: tuple[str, ...] = EXPECTED_SECTIONS) -> DataFrame:
    """(key, url) of same-domain URLs -> features of the list; sites without any are absent."""
    u = F.col("url")
    sections = [F.when(F.bool_or(F.lower(u).contains(s)), F.lit(s)) for s in expected]
    out = urls.groupBy(key).agg(
        F.count("*").alias("sitemap_url_count"), F.max(U.path_depth(u)).alias("sitemap_max_depth"), F.avg(U.path_depth(u)).alias("sitemap_avg_depth"),
        F.count_distinct(U.top_directory(u)).alias("sitemap_n_top_dirs"), F.avg(U.has_query(u).cast("double")).alias("sitemap_pct_query_urls"),
        F.count_if(U.is_pdf(u)).alias("sitemap_pdf_count"), F.array_sort(F.array_compact(F.array(*sections))).alias("sitemap_expected_sections"))
    return out.withColumn("sitemap_expected_section_count", F.size("sitemap_expected_sections").cast("bigint"))


def lastmod_features(dates: DataFrame, as_of: Column, key: str = "site_key") -> DataFrame:
    """(key, lastmod text) -> key, n_dates, days since the last one, span in days."""
    d = lastmod_date(F.col("lastmod"))
    return dates.groupBy(key).agg(F.count(d).alias("n_dates"), F.datediff(as_of, F.max(d)).alias("sitemap_days_since_last_update"), F.datediff(F.max(d), F.min(d)).alias("sitemap_lastmod_span_days"))


def sitemap_features(inventory: DataFrame, domains: DataFrame, as_of: Column, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """inventory(site_key, urls, lastmods, ...) and domains(site_key, registered_domain) -> the sitemap columns.

    A site without same-domain URLs has count 0 and nulls.  Lastmods of all URLs count, whatever their domain.
    """
    base = inventory.join(domains, "site_key")
    same = base.select("site_key", "registered_domain", F.explode("urls").alias("url")).where(U.registered_domain(F.col("url"), suffixes) == F.col("registered_domain"))
    lists, mods = inventory_urls(same), lastmod_features(inventory.select("site_key", F.explode("lastmods").alias("lastmod")), as_of)
    out = inventory.drop("urls", "lastmods").join(lists, "site_key", "left").join(mods, "site_key", "left")
    some = F.col("sitemap_url_count").isNotNull()
    return out.withColumns({
        "sitemap_pct_urls_with_lastmod": F.when(some, F.coalesce("n_dates", F.lit(0)) / F.col("sitemap_url_count")),
        "sitemap_days_since_last_update": F.when(some, F.col("sitemap_days_since_last_update")), "sitemap_lastmod_span_days": F.when(some, F.col("sitemap_lastmod_span_days")),
        "sitemap_url_count": F.coalesce("sitemap_url_count", F.lit(0)).cast("bigint"),
    }).drop("n_dates")
