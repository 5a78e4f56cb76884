"""Fetch log -> one row for each HTML page with its 33 structural fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.config import TRUSTED_DOMAINS, FeatureConfig
from lodestead.functions import patterns as R
from lodestead.functions import text as T
from lodestead.functions import urls as U
from lodestead.operators.html import html_facts
from lodestead.schemas import PAGE_COLUMNS


def html_pages(fetch_log: DataFrame) -> DataFrame:
    """Responses with status 200 and an HTML content type."""
    return fetch_log.where((F.col("status") == 200) & F.col("content_type").contains("text/html"))


def link_kinds(anchors: Column, site_domain: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """Anchors that lead to the web: ARRAY<STRUCT<url, host, internal, trusted, pdf>>."""
    kept = F.filter(anchors, lambda a: ~(a["href"].startswith("mailto:") | a["href"].startswith("javascript:") | a["href"].startswith("#") | a["href"].startswith("tel:")) & a["abs"].rlike("^(?i)https?://"))

    def kind(a: Column) -> Column:
        domain = U.registered_domain(a["abs"], suffixes)
        inside = domain == site_domain
        return F.struct(a["abs"].alias("url"), U.host(a["abs"]).alias("host"), inside.alias("internal"), (~inside & (domain.isin(*TRUSTED_DOMAINS) | F.endswith(domain, F.lit(".gov")))).alias("trusted"), U.is_pdf(a["abs"]).alias("pdf"))

    return F.transform(kept, kind)


def page_features(pages: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """pages(site_key, page_seq, url, site_domain, html) -> PAGE_COLUMNS; pages that cannot be parsed are left out."""
    html = F.col("html")
    # what regular expressions find is computed before the page goes to the parser, which does not send it back
    before = {
        "css_head": R.css_in_head(html, config.prefix_chars), "site_builders": R.site_builders(html, config.prefix_chars), "ga_ua_ids": R.found_set(html, R.GA_UA), "ga4_ids": R.found_set(html, R.GA4),
        "gtm_ids": R.found_set(html, R.GTM), "fb_pixel_ids": R.found_set(html, R.FB_PIXEL, 1), "free_email_hits": R.count(html, R.FREE_EMAIL), "html_bytes": T.byte_length(html),
    }
    df = html_facts(pages.select("site_key", "page_seq", "url", "site_domain", "html", *[c.alias(n) for n, c in before.items()])).where(F.col("facts").isNotNull())
    df = df.select("site_key", "page_seq", "url", "site_domain", *before, "facts.*")
    df = df.withColumn("links", link_kinds(F.col("anchors"), F.col("site_domain"), config.public_suffixes))
    mailto = F.transform(F.filter("anchors", lambda a: a["href"].startswith("mailto:")), lambda a: U.mailto_domain(a["href"]))
    inside = F.filter("links", lambda x: x["internal"])
    text = F.col("visible_text")

    def big(c: Column) -> Column:
        return F.size(c).cast("bigint")

    df = df.withColumns({
        "structure_hash": F.sha1(F.array_join("tags", "|").cast("binary")), "shingles": T.shingles(text, config.shingle_words), "word_count": T.word_count(text),
        "a_tag_count": big(F.col("anchors")), "internal_links": F.transform(inside, lambda x: x["url"]), "external_link_count": big(F.filter("links", lambda x: ~x["internal"])),
        "trusted_link_count": big(F.filter("links", lambda x: x["trusted"])), "pdf_link_count": big(F.filter("links", lambda x: x["pdf"])),
        "mailto_domains": F.array_compact(mailto), "subdomains": F.array_distinct(F.transform(inside, lambda x: x["host"])),
        "css_frameworks": R.css_frameworks(F.col("css_head"), F.col("css_hrefs")), "phone_count": R.count(text, R.PHONE), "has_street_address": R.has_street_address(text),
        "copyright_years": R.copyright_years(text), "text_bytes": T.byte_length(text),
    })
    return df.select(*PAGE_COLUMNS)
