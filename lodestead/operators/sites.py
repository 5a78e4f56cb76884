"""Pages -> one row per site: a single map-side combined aggregation and two narrow side branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.config import FeatureConfig
from lodestead.functions import urls as U


def union_of(name: str) -> Column:
    """Sorted set union of an array column over a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0))


def boilerplate(pages: DataFrame) -> DataFrame:
    """site_key, boilerplate_ratio: share of the landing page's shingles that stand on max(2, n div 2) pages or more;
    null below 3 pages or if the landing page has none."""
    n = pages.groupBy("site_key").agg(F.count("*").alias("n"))
    first = pages.where("page_seq = 0").select("site_key", F.col("shingles").alias("landing"))
    # only the landing page's shingles are counted, so nothing else is exploded
    each = pages.select("site_key", "shingles").join(first, "site_key").select("site_key", F.explode(F.array_intersect("shingles", "landing")).alias("shingle"))
    counts = each.groupBy("site_key", "shingle").agg(F.count("*").alias("on")).join(n, "site_key")
    out = counts.groupBy("site_key").agg(F.avg((F.col("on") >= F.greatest(F.lit(2), F.expr("n div 2"))).cast("double")).alias("boilerplate_ratio"), F.first("n").alias("n"))
    return out.select("site_key", F.when(F.col("n") >= 3, F.col("boilerplate_ratio")).alias("boilerplate_ratio"))


def aggregate_sites(pages: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """site_key and all aggregates that need pages only; ``site_domain`` must be among the columns of ``pages``, which are
    read more than once and so should be staged, and at most a site's page cap of them, as their hashes are listed."""
    n = F.count("*")

    def total(c: str) -> Column:
        return F.sum(c)

    def length(c: str) -> Column:
        return F.sum(F.size(c)).cast("bigint")

    def any_of(c: str) -> Column:
        return F.coalesce(F.bool_or(c), F.lit(False))

    on_domain = F.size(F.filter("mailto_domains", lambda d: U.registered_domain(F.concat(F.lit("http://"), d), suffixes) == F.col("site_domain")))
    years = F.filter("copyright_years", lambda y: y.between(1990, 2100))
    site = pages.withColumns({"_on": on_domain, "_hi": F.array_max(years), "_lo": F.array_min(years)}).groupBy("site_key").agg(
        n.alias("pages_crawled"), total("a_tag_count").alias("total_a_tags"), length("internal_links").alias("total_internal_links"), total("external_link_count").alias("total_external_links"),
        total("word_count").alias("total_words"), F.avg("word_count").alias("avg_words_per_page"), total("img_count").alias("total_images"), F.avg("img_count").alias("avg_images_per_page"),
        ratio(F.sum("img_alt_count"), F.sum("img_count")).alias("img_alt_coverage"), total("html_bytes").alias("total_html_bytes"), ratio(F.sum("text_bytes"), F.sum("html_bytes")).alias("text_to_html_ratio"),
        F.count_distinct("structure_hash").alias("unique_dom_structures"), (F.count_distinct("structure_hash") / n).alias("dom_structure_diversity"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "structure_hash"))), lambda x: x["structure_hash"]).alias("structure_hashes"),
        F.avg("inline_style_count").alias("avg_inline_styles_per_page"), F.min_by(F.size("stylesheet_hrefs"), "page_seq").cast("bigint").alias("num_stylesheets_landing"),
        union_of("css_frameworks").alias("css_frameworks"), union_of("site_builders").alias("site_builders_detected"),
        F.array_sort(F.collect_set(F.nullif("meta_generator", F.lit("")))).alias("meta_generators"),
        *[F.avg(F.col(c).cast("double")).alias(a) for c, a in (("has_meta_description", "pct_pages_meta_description"), ("has_og_tags", "pct_pages_og_tags"), ("has_canonical", "pct_pages_canonical"))],
        any_of("has_favicon").alias("has_favicon"), any_of("has_edu_schema").alias("has_edu_schema_markup"),
        *[union_of(c).alias(c) for c in ("ga_ua_ids", "ga4_ids", "gtm_ids", "fb_pixel_ids")],
        total("pdf_link_count").alias("pdf_link_count"), total("trusted_link_count").alias("trusted_outbound_links"), F.size(union_of("subdomains")).cast("bigint").alias("num_subdomains_seen"),
        length("mailto_domains").alias("mailto_count"), ratio(F.sum("_on"), F.sum(F.size("mailto_domains"))).alias("mailto_on_domain_ratio"),
        total("free_email_hits").alias("free_email_hits"), total("phone_count").alias("phone_number_hits"), any_of("has_street_address").alias("has_street_address"),
        F.max("_hi").alias("max_copyright_year"), F.min("_lo").alias("min_copyright_year"),
    )
    site = site.withColumns({"uses_css_framework": F.size("css_frameworks") > 0, "uses_site_builder": F.size(F.array_except("site_builders_detected", F.array(F.lit("wordpress")))) > 0})
    return site.join(boilerplate(pages), "site_key", "left")


def header_features(fetch_log: DataFrame) -> DataFrame:
    """site_key, server_headers, has_last_modified_header over all HTML responses; header names are matched as written."""
    ok = fetch_log.where((F.col("status") == 200) & F.col("content_type").contains("text/html"))
    server, modified = F.try_element_at("headers", F.lit("Server")), F.try_element_at("headers", F.lit("Last-Modified"))
    return ok.groupBy("site_key").agg(F.array_sort(F.collect_set(F.nullif(server, F.lit("")))).alias("server_headers"), F.bool_or(F.coalesce(modified, F.lit("")) != "").alias("has_last_modified_header"))


def landing_features(fetch_log: DataFrame) -> DataFrame:
    """site_key, https_redirect, landing_status_code of the first response."""
    answered = fetch_log.where("status is not null")
    first = answered.groupBy("site_key").agg(F.min_by(F.struct("final_url", "status"), "seq").alias("f"))
    return first.select("site_key", F.col("f.final_url").startswith("https://").alias("https_redirect"), F.col("f.status").alias("landing_status_code"))


def unvisited_links(pages: DataFrame, fetch_log: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """site_key, url: up to broken_link_sample_size internal links that were never fetched, in a fixed hash order."""
    links = pages.select("site_key", F.explode("internal_links").alias("u")).select("site_key", U.canonical_url(F.col("u")).alias("url")).distinct()
    new = links.join(fetch_log.select("site_key", U.canonical_url(F.col("url")).alias("url")).distinct(), ["site_key", "url"], "left_anti")
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("url").alias("h"), "url"))), 1, config.broken_link_sample_size)
    return new.groupBy("site_key").agg(first.alias("s")).select("site_key", F.explode(F.transform("s", lambda x: x["url"])).alias("url"))


def broken_links(sample: DataFrame, checks: DataFrame) -> DataFrame:
    """site_key, broken_link_sample_n, broken_link_rate_sampled; HEAD, then GET where HEAD is not allowed; errors are broken."""
    status = F.when(F.col("head_status") == 405, F.col("get_status")).otherwise(F.col("head_status"))
    broken = F.col("error").isNotNull() | status.isNull() | (status >= 400)
    return sample.join(checks, ["site_key", "url"], "left").groupBy("site_key").agg(F.count("*").alias("broken_link_sample_n"), F.avg(broken.cast("double")).alias("broken_link_rate_sampled"))


def css_hashes(pages: DataFrame, css_files: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """site_key, css_content_hashes: SHA-1 of the first distinct stylesheets, in order; equal contents are kept."""
    hrefs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "stylesheet_hrefs"))), lambda x: x["stylesheet_hrefs"]))
    first = pages.groupBy("site_key").agg(F.slice(F.array_distinct(hrefs), 1, config.max_css_files_per_site).alias("h")).select("site_key", F.posexplode("h").alias("pos", "href"))
    got = first.join(css_files.where("status = 200"), ["site_key", "href"]).groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("pos", F.sha1("content").alias("hash")))).alias("x"))
    return got.select("site_key", F.transform("x", lambda x: x["hash"]).alias("css_content_hashes"))


def crawl_censored(pages_crawled: Column, sitemap_url_count: Column, cap: int) -> Column:
    return (pages_crawled >= cap) & (F.coalesce(sitemap_url_count, F.lit(0)) > cap)
