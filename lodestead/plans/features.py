"""Tables of responses -> raw site features: the whole plan, one join per block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.config import FeatureConfig
from lodestead.functions import urls as U
from lodestead.operators import crawl, cross_site, domain, pages, sitemap, sites
from lodestead.schemas import RAW_COLUMNS
from lodestead.session import stage
from lodestead.sinks import append_results, sanitised, todo, write_inventory
from lodestead.sources.institutions import join_back


@dataclass(frozen=True)
class Responses:
    """What the fetch layer left; tables that are None were not collected."""

    fetch_log: DataFrame
    robots: DataFrame | None = None
    sitemap_docs: DataFrame | None = None
    link_checks: DataFrame | None = None
    css_files: DataFrame | None = None
    tls_certs: DataFrame | None = None
    whois: DataFrame | None = None


def site_features(urls: DataFrame, got: Responses, as_of: Column, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """urls(input_url) -> one row per URL with RAW_COLUMNS but the cross-site ones; fetch_log.site_key is the input URL."""
    u, suffixes = F.col("input_url"), config.public_suffixes
    base = urls.select(u.alias("site_key"), u.alias("input_url"), U.registered_domain(u, suffixes).alias("registered_domain"), U.tld(u, suffixes).alias("tld"), U.host(u).alias("hostname"))
    log = got.fetch_log
    if got.robots is not None:  # what robots.txt forbids is no page, even if the log holds it
        log = log.join(crawl.refused(log.select("site_key", "url", "seq"), got.robots, config.user_agent).select("site_key", "seq"), ["site_key", "seq"], "left_anti")
    html = pages.html_pages(log.join(base.select("site_key", F.col("registered_domain").alias("site_domain")), "site_key"))
    # pages are capped after extraction: those that cannot be parsed take no place, and the first that can is the landing page
    every, _ = stage(pages.page_features(html.select("site_key", F.col("seq").alias("page_seq"), F.col("final_url").alias("url"), "site_domain", "html"), config), "pages")
    page, _ = stage(crawl.page_cap(every, config).join(base.select("site_key", F.col("registered_domain").alias("site_domain")), "site_key"), "pages")
    out = base.join(sites.landing_features(log), "site_key", "left").join(sites.aggregate_sites(page, suffixes), "site_key", "left").join(sites.header_features(log), "site_key", "left")
    failed = log.where("error is not null").groupBy("site_key").agg(F.min_by("error", "seq").alias("error"))
    out = out.join(failed, "site_key", "left").withColumn("crawl_error", F.when(F.col("pages_crawled").isNull(), F.coalesce("error", F.lit("no HTML pages retrieved")))).drop("error")
    bypassed = log.where("ssl_bypass").select("site_key").distinct().withColumn("ssl_bypass_used", F.lit(True)) if "ssl_bypass" in log.columns else None
    out = out.join(bypassed, "site_key", "left") if bypassed is not None else out.withColumn("ssl_bypass_used", F.lit(False))
    out = out.withColumns({"crawl_timestamp": as_of.cast("timestamp"), "ssl_bypass_used": F.coalesce("ssl_bypass_used", F.lit(False)), "pages_crawled": F.coalesce("pages_crawled", F.lit(0))})
    live = out.where("crawl_error is null").select("site_key", "hostname", "registered_domain", "input_url")
    met = got.fetch_log.select("site_key", "url")
    if got.robots is not None:
        requested = every.select("site_key", F.col("page_seq").alias("seq"), "internal_links").join(log.select("site_key", "seq", F.col("url").alias("request")), ["site_key", "seq"])
        links = requested.select("site_key", F.col("request").alias("url"), F.posexplode("internal_links").alias("pos", "target"))
        order, _ = stage(crawl.crawl_order(base.select("site_key", u.alias("url")), links, config), "order")
        # what was refused has been met, too
        met = met.unionByName(crawl.refused(order.select("site_key", F.col("canon").alias("url")), got.robots, config.user_agent).select("site_key", "url"))
        out = out.join(crawl.frontier_blocked(order, got.robots, requested.select("site_key", U.canonical_url(F.col("request")).alias("canon")), config), "site_key", "left")
    if got.link_checks is not None:
        out = out.join(sites.broken_links(sites.unvisited_links(page, met, config), got.link_checks), "site_key", "left")
    if got.css_files is not None:
        out = out.join(sites.css_hashes(page, got.css_files, config), "site_key", "left")
    if got.sitemap_docs is not None and got.robots is not None and config.collect_sitemap:
        inventory, _ = stage(sitemap.collect_inventory(live.select("site_key", F.col("input_url").alias("base_url")), got.robots, got.sitemap_docs, config), "inventory")
        if config.save_url_inventory_dir:
            write_inventory(inventory, live.select("site_key", "registered_domain"), config.save_url_inventory_dir)
        out = out.join(sitemap.sitemap_features(inventory, live.select("site_key", "registered_domain"), as_of, suffixes), "site_key", "left")
        out = out.withColumn("crawl_censored", F.when(F.col("crawl_error").isNull(), sites.crawl_censored(F.col("pages_crawled"), F.col("sitemap_url_count"), config.max_pages_per_site)))
    if got.tls_certs is not None:
        out = out.join(domain.tls_features(live.select("site_key", "hostname"), got.tls_certs, as_of), "site_key", "left")
    if got.whois is not None:
        out = out.join(domain.whois_features(live.select("site_key", "registered_domain"), got.whois, as_of), "site_key", "left")
    own = {c: t for c, t in RAW_COLUMNS.items() if c not in ("max_structure_similarity_other_site", "n_sites_sharing_css_file", "n_sites_sharing_tracker_id")}
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in own.items()])


def build_feature_dataframe(inputs: DataFrame, got: Responses, as_of: Column, config: FeatureConfig = FeatureConfig(), done: DataFrame | None = None, limit: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """inputs (of read_institutions) -> features on every institution, cross-site features over all known sites.

    ``done`` holds results of earlier runs: their URLs are not computed again and count as known sites.  New results are
    appended to the table ``checkpoint`` as one batch, there whole or not at all.
    """
    from lodestead.sources.institutions import unique_urls

    new, _ = stage(site_features(todo(unique_urls(inputs, limit), done), got, as_of, config), "sites")
    if checkpoint:
        append_results(sanitised(new, ("structure_hashes", "css_content_hashes")), checkpoint)
    # results of an earlier version may lack columns
    known = new if done is None else new.unionByName(done.select(*[c for c in new.columns if c in done.columns]), allowMissingColumns=True)
    full = cross_site.add_cross_site_features(known)
    return join_back(inputs, full, only_found=limit is not None)
