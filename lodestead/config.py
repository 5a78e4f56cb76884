"""Settings and fixed values of the site feature engine.  Settings are passed explicitly and end up as literals."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the reference's for equal results.
TRUSTED_DOMAINS = (
    "ed.gov", "studentaid.gov", "chea.org", "nces.ed.gov", "msche.org", "hlcommission.org", "sacscoc.org", "neche.org",
    "nwccu.org", "wscuc.org", "accjc.org", "accsc.org", "deac.org", "abet.org", "aacsb.edu", "lcme.org",
    "abaannualreport.com", "ncaa.org", "naia.org", "commonapp.org", "fafsa.gov",
)
EXPECTED_SECTIONS = ("admission", "registrar", "faculty", "catalog", "financial", "library", "research", "athletic", "alumni", "tuition")
EDU_TYPES = ("CollegeOrUniversity", "EducationalOrganization")
PRIVACY_WORDS = ("privacy", "redacted", "proxy", "whoisguard")
DEFAULT_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")

# Names of the columns that the matrix is made of.
LIST_COLUMNS = (
    "structure_hashes", "css_content_hashes", "css_frameworks", "site_builders_detected", "meta_generators", "server_headers",
    "ga_ua_ids", "ga4_ids", "gtm_ids", "fb_pixel_ids", "sitemap_expected_sections",
)
ID_COLUMNS = ("UNITID", "school.school_url", "input_url", "registered_domain")
PASSTHROUGH_COLUMNS = (
    "pages_crawled", "avg_words_per_page", "avg_images_per_page", "img_alt_coverage", "text_to_html_ratio", "dom_structure_diversity",
    "boilerplate_ratio", "avg_inline_styles_per_page", "num_stylesheets_landing", "pct_pages_meta_description", "pct_pages_og_tags",
    "pct_pages_canonical", "mailto_on_domain_ratio", "broken_link_rate_sampled", "num_subdomains_seen", "robots_blocked_count",
    "ssl_days_to_expiry", "landing_status_code", "max_structure_similarity_other_site", "n_sites_sharing_css_file",
    "n_sites_sharing_tracker_id", "sitemap_max_depth", "sitemap_avg_depth", "sitemap_n_top_dirs", "sitemap_pct_query_urls",
    "sitemap_expected_section_count", "sitemap_pct_urls_with_lastmod", "sitemap_days_since_last_update", "sitemap_lastmod_span_days",
    "sitemap_files_fetched",
)
LOG_COLUMNS = (
    "total_a_tags", "total_internal_links", "total_external_links", "total_words", "total_images", "total_html_bytes", "pdf_link_count",
    "trusted_outbound_links", "mailto_count", "free_email_hits", "phone_number_hits", "sitemap_url_count", "sitemap_pdf_count",
)
BOOL_COLUMNS = (
    "https_redirect", "has_favicon", "has_edu_schema_markup", "has_last_modified_header", "has_street_address", "uses_css_framework",
    "uses_site_builder", "ssl_ok", "ssl_org_validated", "whois_privacy_protected", "sitemap_found", "sitemap_truncated", "crawl_censored",
)
RATE_COLUMNS = (
    ("pdf_link_count", "pdf_links_per_page"), ("trusted_outbound_links", "trusted_links_per_page"), ("total_external_links", "external_links_per_page"),
    ("total_internal_links", "internal_links_per_page"), ("phone_number_hits", "phone_hits_per_page"),
)


@dataclass(frozen=True)
class FeatureConfig:
    """Everything that can be set; defaults are the reference's."""

    max_pages_per_site: int = 25
    request_delay_sec: float = 1.5
    request_timeout_sec: float = 15.0
    max_css_files_per_site: int = 5
    broken_link_sample_size: int = 10
    collect_sitemap: bool = True
    max_sitemap_files: int = 10
    max_sitemap_urls: int = 50_000
    save_url_inventory_dir: str | None = None
    verify_ssl: bool = True
    retry_unverified: bool = False
    lookup_whois: bool = False
    mid_run_pause_sec: float = 5.0
    user_agent: str = "lodestead-crawler"
    checkpoint_path: str = "site_features_checkpoint"
    output_path: str = "site_features"
    prefix_chars: int = 200_000
    shingle_words: int = 5
    public_suffixes: tuple[str, ...] = ()
