"""Declared schemas of inputs and intermediate tables; nothing is inferred from data."""

from __future__ import annotations

INSTITUTIONS = "UNITID string, `school.school_url` string"
FETCH_LOG = "site_key string, seq int, url string, final_url string, status int, headers map<string,string>, content_type string, html string, error string"
#: The log of a crawl says, too, whether a certificate was not verified.
CRAWL_LOG = FETCH_LOG + ", ssl_bypass boolean"
ROBOTS = "site_key string, robots_text string"
SITEMAP_DOCS = "site_key string, url string, status int, content binary"
LINK_CHECKS = "site_key string, url string, head_status int, get_status int, error string"
CSS_FILES = "site_key string, href string, status int, content binary"
TLS_CERTS = "hostname string, issuer_org string, subject_org string, not_after timestamp, handshake_ok boolean, error string"
#: Everything a crawl was answered, by kind: page, robots, sitemap, check, css, tls, whois.
ANSWERS = (
    "kind string, site_key string, seq int, url string, final_url string, status int, headers map<string,string>, content_type string, text string, content binary, "
    "get_status int, error string, ssl_bypass boolean"
)
WHOIS = "domain string, creation_dates array<timestamp>, org string, raw_text string"

#: Facts of one page that need its tree.
HTML_FACTS = (
    "visible_text string, tags array<string>, anchors array<struct<href:string,abs:string>>, img_count bigint, img_alt_count bigint, "
    "css_hrefs array<string>, stylesheet_hrefs array<string>, inline_style_count bigint, meta_generator string, has_meta_description boolean, "
    "has_og_tags boolean, has_canonical boolean, has_favicon boolean, has_edu_schema boolean"
)
#: The 33 fields of a page and its two keys.
PAGE_COLUMNS = (
    "site_key", "page_seq", "url", "structure_hash", "shingles", "word_count", "a_tag_count", "internal_links", "external_link_count",
    "trusted_link_count", "pdf_link_count", "mailto_domains", "subdomains", "img_count", "img_alt_count", "stylesheet_hrefs",
    "inline_style_count", "css_frameworks", "site_builders", "meta_generator", "has_meta_description", "has_og_tags", "has_canonical",
    "has_favicon", "has_edu_schema", "ga_ua_ids", "ga4_ids", "gtm_ids", "fb_pixel_ids", "phone_count", "has_street_address",
    "free_email_hits", "copyright_years", "html_bytes", "text_bytes",
)
_STRINGS = "array<string>"
#: Site-level columns in the order of the raw table, with types.
RAW_COLUMNS = {
    "input_url": "string", "registered_domain": "string", "tld": "string", "crawl_timestamp": "timestamp", "crawl_error": "string", "ssl_bypass_used": "boolean",
    "https_redirect": "boolean", "landing_status_code": "int", "pages_crawled": "bigint", "robots_blocked_count": "bigint",
    "total_a_tags": "bigint", "total_internal_links": "bigint", "total_external_links": "bigint", "total_words": "bigint", "avg_words_per_page": "double",
    "total_images": "bigint", "avg_images_per_page": "double", "img_alt_coverage": "double", "total_html_bytes": "bigint", "text_to_html_ratio": "double",
    "unique_dom_structures": "bigint", "dom_structure_diversity": "double", "structure_hashes": _STRINGS, "boilerplate_ratio": "double",
    "avg_inline_styles_per_page": "double", "num_stylesheets_landing": "bigint", "css_frameworks": _STRINGS, "uses_css_framework": "boolean",
    "site_builders_detected": _STRINGS, "uses_site_builder": "boolean", "meta_generators": _STRINGS, "pct_pages_meta_description": "double",
    "pct_pages_og_tags": "double", "pct_pages_canonical": "double", "has_favicon": "boolean", "has_edu_schema_markup": "boolean",
    "server_headers": _STRINGS, "has_last_modified_header": "boolean", "ga_ua_ids": _STRINGS, "ga4_ids": _STRINGS, "gtm_ids": _STRINGS, "fb_pixel_ids": _STRINGS,
    "pdf_link_count": "bigint", "trusted_outbound_links": "bigint", "num_subdomains_seen": "bigint", "mailto_count": "bigint",
    "mailto_on_domain_ratio": "double", "free_email_hits": "bigint", "phone_number_hits": "bigint", "has_street_address": "boolean",
    "max_copyright_year": "int", "min_copyright_year": "int", "broken_link_sample_n": "bigint", "broken_link_rate_sampled": "double",
    "css_content_hashes": _STRINGS, "sitemap_found": "boolean", "sitemap_source": "string", "sitemap_files_fetched": "bigint", "sitemap_truncated": "boolean",
    "sitemap_url_count": "bigint", "sitemap_max_depth": "int", "sitemap_avg_depth": "double", "sitemap_n_top_dirs": "bigint", "sitemap_pct_query_urls": "double",
    "sitemap_pdf_count": "bigint", "sitemap_expected_sections": _STRINGS, "sitemap_expected_section_count": "bigint", "sitemap_pct_urls_with_lastmod": "double",
    "sitemap_days_since_last_update": "int", "sitemap_lastmod_span_days": "int", "crawl_censored": "boolean", "ssl_ok": "boolean", "ssl_issuer_org": "string",
    "ssl_org_validated": "boolean", "ssl_days_to_expiry": "int", "ssl_cert_error": "string", "domain_age_days": "int", "whois_privacy_protected": "boolean",
    "whois_registrant_org": "string", "max_structure_similarity_other_site": "double", "n_sites_sharing_css_file": "bigint", "n_sites_sharing_tracker_id": "bigint",
}
