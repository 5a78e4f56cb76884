"""Crawl inputs that vary, derived from the supplied tables by SQL that Spark and DuckDB read alike, and the oracles' side:
facts of a page and of a site in DuckDB's functions alone.

The supplied pages have one shape; here some get what a site's pages have elsewhere: descriptions, generators, trackers,
stylesheets, images, mail addresses, links to other sites, telephone numbers, streets, years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.config import EXPECTED_SECTIONS, TRUSTED_DOMAINS
from lodestead.functions import patterns as R


def _some(cases: str, otherwise: str = "''") -> str:
    return f"CASE {cases} ELSE {otherwise} END"


def _n(x: str) -> str:
    return f"CAST({x} AS STRING)"


_HOSTS = "url"
for _old, _new in (("spam-farm.example.org", "spam-farm.org"), ("free-bets.example.com", "free-bets.ac.uk"), ("cheap-pills.example.com", "cheap-pills.net"), (".example.org", ".edu"), (".example.net", ".state.us"), (".example.com", ".com")):
    _HOSTS = f"replace({_HOSTS}, '{_old}', '{_new}')"
_PATHS = _some("page_id % 5 WHEN 0 THEN '/Admissions/en/' WHEN 1 THEN '/library/research/2024/' WHEN 2 THEN '/'", "'/en/'")
URL = f"replace(replace({_HOSTS}, '/en/', {_PATHS}), '.html', {_some('page_id % 2 WHEN 0 THEN ' + chr(39) + '.PDF?dl=1' + chr(39), chr(39) + '.html' + chr(39))})"
_HEAD = " || ".join((
    _some("WHEN page_id % 3 = 0 THEN '<meta name=\"description\" content=\"x\">'"),
    _some("WHEN page_id % 4 = 1 THEN '<meta property=\"og:title\" content=\"t\">'"),
    _some(f"page_id % 5 WHEN 0 THEN '<meta name=\"Generator\" content=\"WordPress 6.' || {_n('page_id % 3')} || '\">' WHEN 1 THEN '<meta name=\"generator\" content=\"\">'"),
    _some("WHEN page_id % 6 = 2 THEN '<link rel=\"canonical\" href=\"/c\">'"),
    _some("WHEN page_id % 50 = 7 THEN '<link rel=\"shortcut icon\" href=\"/f.ico\">'"),
    _some(f"page_id % 8 WHEN 0 THEN '<link rel=\"stylesheet\" href=\"https://cdn.lib.net/bootstrap.min.css?v=' || {_n('page_id % 3')} || '\">' WHEN 1 THEN '<link rel=\"stylesheet\" href=\"/css/Tailwind.css\"><link rel=\"stylesheet\" href=\"/css/foundation.min.css\">' WHEN 2 THEN '<link rel=\"stylesheet\" href=\"/wp-content/a.css\">' WHEN 3 THEN '<script src=\"https://static.wixstatic.com/a.js\"></script>'"),
    _some(f"page_id % 9 WHEN 4 THEN '<script>ga(\"create\", \"UA-' || {_n('10000 + page_id % 4')} || '-1\"); gtag(\"G-ABC' || {_n('1000 + page_id % 6')} || '\");</script>' WHEN 5 THEN '<script>w(\"GTM-X' || {_n('1000 + page_id % 2')} || '\"); fbq(\"init\", \"' || {_n('12345 + page_id % 3')} || '\");</script>'"),
    _some("WHEN page_id % 11 = 3 THEN '<script type=\"application/ld+json\">{\"@type\": \"CollegeOrUniversity\"}</script>'"),
))
_BODY = " || ".join((
    _some(f"WHEN page_id % 5 = 2 THEN '<p>Call (555) 010-' || lpad({_n('page_id % 7')}, 4, '0') || ' or 555.123.4567 today.</p>'"),
    _some("page_id % 7 WHEN 3 THEN '<p>12 Main Street, Springfield 12345</p>' WHEN 4 THEN '<p>12 Main Street</p>' WHEN 5 THEN '<p>Box 54321-1234</p>'"),
    _some(f"WHEN page_id % 3 = 1 THEN '<p>Copyright 1999-20' || lpad({_n('page_id % 27')}, 2, '0') || ' us</p>' WHEN page_id % 13 = 5 THEN '<p>&copy; 1850 and &copy; 2031</p>'"),
    _some("page_id % 6 WHEN 1 THEN '<a href=\"mailto:Office@Mail.EDU?subject=x\">m</a><a href=\"mailto:nobody\">n</a>' WHEN 4 THEN '<a href=\"mailto:me@Gmail.com\">write to me@gmail.com</a>' WHEN 5 THEN '<a href=\"mailto:a@blog.' || split_part(split_part(url, '.', 2), '/', 1) || '.com\">o</a>'"),
    _some(f"WHEN page_id % 4 = 0 THEN '<a href=\"https://other' || {_n('page_id % 3')} || '.org/File.PDF?x=1\">p</a><a href=\"/own.pdf\">q</a>'"),
    _some("WHEN page_id % 5 = 0 THEN '<a href=\"https://nces.ed.gov/x\">g</a><a href=\"http://www.abet.org\">t</a><a href=\"//x.dep.gov/y\">z</a>'"),
    "'<a href=\"javascript:void(0)\">j</a><a href=\"#top\">t</a><a href=\"tel:1\">c</a>'",
    _some("page_id % 6 WHEN 2 THEN '<img src=\"a.png\" alt=\"a\"><img src=\"b.png\"><img src=\"c.png\" alt=\"  \">' WHEN 5 THEN '<img src=\"d.png\" alt=\"d\">'"),
    _some("WHEN page_id % 4 = 2 THEN '<a href=\"https://library.state.us/a\">l</a>'"),
    _some("WHEN page_id % 4 = 3 THEN '<p style=\"color:red\">styled</p>'"),
    _some("WHEN page_id % 17 = 2 THEN '<div itemtype=\"http://schema.org/EducationalOrganization\">school</div>'"),
    _some("WHEN page_id % 3 < 2 THEN '<p>Office hours are nine to five on all weekdays but Friday</p>'"),
))
_NOTICE = "'<html><head><title>Closed</title></head><body><h1>Notice</h1><p>This page is closed for now, come back later</p></body></html>'"
HTML = f"CASE WHEN page_id % 10 = 9 THEN {_NOTICE} ELSE replace(replace(html, '</head>', {_HEAD} || '</head>'), '</article>', {_BODY} || '</article>') END"


def pages(table: DataFrame) -> DataFrame:
    """page_id, url, html."""
    return table.selectExpr("page_id", f"{URL} AS url", f"{HTML} AS html")


# DuckDB's side


def host(url: str) -> str:
    return f"lower(split_part(regexp_extract({url}, '^[^:/?#]+://([^/?#]*)', 1), ':', 1))"


def domain(url: str) -> str:
    h = f"string_split({host(url)}, '.')"
    return f"array_to_string(CASE WHEN len({h}) > 2 THEN {h}[-2:] ELSE {h} END, '.')"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


def canonical(url: str) -> str:
    return f"rtrim(split_part({url}, '#', 1), '/')"


def all_of(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


def set_of(text: str, pattern: str, group: int = 0) -> str:
    return f"list_distinct({all_of(text, pattern, group)})"


def named(patterns: dict[str, str]) -> str:
    """The names whose pattern the page has, as a list."""
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(substr(html, 1, 200000), '(?i){p}') THEN '{n}' END" for n, p in patterns.items()) + "], lambda n: n IS NOT NULL)"


PAGES = f"(SELECT page_id, {URL} AS url, {HTML} AS html FROM pages)"
_TAG = lambda name, more: f"<{name}[^>]*{more}"
_STREET = R.STREET.replace("(?iu)(?U)", "(?i)")
_PHONE, _ZIP = R.PHONE.replace("(?U)", ""), R.ZIP.replace("(?U)", "")
YEARS = R.COPYRIGHT_YEAR.replace("(?iu)(?U)", "(?i)")
FREE = R.FREE_EMAIL.replace("(?iu)", "(?i)")
PIXEL = 'fbq\\(\\s*"init"\\s*,\\s*"(\\d{5,20})"'
IDS = {"ga_ua_ids": (R.GA_UA.replace("(?U)", ""), 0), "ga4_ids": (R.GA4.replace("(?U)", ""), 0), "gtm_ids": (R.GTM.replace("(?U)", ""), 0), "fb_pixel_ids": (PIXEL, 1)}
_SAID = "replace(replace(replace(replace(x, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_ABS = "CASE WHEN regexp_matches(x, '^https?://') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x ELSE base || x END"
_KEPT = "list_filter(hrefs, lambda x: NOT (starts_with(x, 'mailto:') OR starts_with(x, 'javascript:') OR starts_with(x, '#') OR starts_with(x, 'tel:')))"
_TRUSTED = ", ".join(f"'{d}'" for d in TRUSTED_DOMAINS)

#: One row a page: p(page_id, url, html, site, ...) with the facts that the parser finds.
FACTS = f"""(
SELECT *, len(internal)::BIGINT AS n_internal, len(links) - len(internal) AS n_external,
  len(list_filter(links, lambda x: {domain('x')} <> site_domain AND ({domain('x')} IN ({_TRUSTED}) OR ends_with({domain('x')}, '.gov')))) AS n_trusted,
  len(list_filter(links, lambda x: ends_with(split_part(lower(x), '?', 1), '.pdf'))) AS n_pdf, list_distinct(list_transform(internal, lambda x: {host('x')})) AS subdomains,
  list_distinct(list_transform(range(1, len(words) - 3), lambda i: substr(md5(array_to_string(words[i:i+4], ' ')), 1, 12))) AS shingles
FROM (SELECT *, list_filter(links, lambda x: {domain('x')} = site_domain) AS internal, regexp_extract_all(text, '\\S+') AS words
FROM (SELECT *, list_transform({_KEPT}, lambda x: {_ABS}) AS links, sha1(array_to_string(tags, '|')) AS structure_hash,
  list_transform(list_filter(hrefs, lambda x: starts_with(x, 'mailto:') AND contains(split_part(x, '?', 1), '@')), lambda x: lower(regexp_extract(split_part(x, '?', 1), '@(.*)$', 1))) AS mail
FROM (SELECT *, list_transform(regexp_extract_all(body, '<([a-zA-Z][^\\s/>]*)', 1), lambda x: lower(x)) AS tags, regexp_extract_all(body, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs,
  array_to_string(list_filter(list_transform(string_split_regex(body, '<[^>]*>'), lambda x: trim({_SAID}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') AS text
FROM (SELECT page_id, url, html, {host('url')} AS site, {domain('url')} AS site_domain, regexp_extract(url, '^([^:]+)', 1) AS scheme, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS base,
  regexp_replace(regexp_replace(html, '<!--.*?-->', '</x>', 'gs'), '<(script|style)([^>]*)>.*?</(script|style)>', '<\\1\\2>', 'gs') AS body FROM {PAGES})))))"""


def site_sql(cap: int) -> str:
    """One row a site, of its first ``cap`` pages, with the columns of the raw table that come from pages."""
    union = lambda x: f"list_sort(list_distinct(flatten(list({x}))))"
    share = lambda x: f"avg(({x})::INT)"
    years = f"list_filter(list_transform({all_of('text', YEARS, 1)}, lambda y: y::INT), lambda y: y BETWEEN 1990 AND 2100)"
    ids = ", ".join(f"{union(set_of('html', p, g))} AS {n}" for n, (p, g) in IDS.items())
    return f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS seq FROM {FACTS}) WHERE seq < {cap}),
n AS (SELECT site, count(*) AS n FROM f GROUP BY site),
e AS (SELECT site, seq, unnest(shingles) AS x FROM f), c AS (SELECT site, x, count(*) AS k, bool_or(seq = 0) AS landing FROM e GROUP BY site, x),
b AS (SELECT c.site, avg((k >= greatest(2, n // 2))::INT) AS ratio FROM c JOIN n USING (site) WHERE landing AND n >= 3 GROUP BY c.site),
s AS (SELECT site, count(*) AS pages_crawled, sum(len(hrefs))::BIGINT AS total_a_tags, sum(n_internal)::BIGINT AS total_internal_links, sum(n_external)::BIGINT AS total_external_links,
  sum(len(words))::BIGINT AS total_words, avg(len(words)) AS avg_words_per_page, sum(len({all_of('body', '<img')}))::BIGINT AS total_images, avg(len({all_of('body', '<img')})) AS avg_images_per_page,
  sum(len({all_of('body', '<img[^>]*alt="[^"]*[^" ]')}))::DOUBLE / nullif(sum(len({all_of('body', '<img')})), 0) AS img_alt_coverage, sum(octet_length(encode(html)))::BIGINT AS total_html_bytes,
  sum(octet_length(encode(text)))::DOUBLE / nullif(sum(octet_length(encode(html))), 0) AS text_to_html_ratio, count(DISTINCT structure_hash) AS unique_dom_structures, count(DISTINCT structure_hash)::DOUBLE / count(*) AS dom_structure_diversity,
  list(structure_hash ORDER BY seq) AS structure_hashes, avg(len({all_of('body', ' style="')})) AS avg_inline_styles_per_page, arg_min(len({all_of('body', 'rel="stylesheet" href="[^"]')}), seq)::BIGINT AS num_stylesheets_landing,
  {union(named(R.CSS_FRAMEWORKS))} AS css_frameworks, {union(named(R.SITE_BUILDERS))} AS site_builders_detected,
  coalesce(list_sort(list_distinct(list(nullif(regexp_extract(html, 'name="[Gg]enerator" content="([^"]*)"', 1), '')) FILTER (regexp_matches(html, 'name="[Gg]enerator" content="[^"]')))), []) AS meta_generators,
  {share("contains(html, 'name=\"description\"')")} AS pct_pages_meta_description, {share("contains(html, 'property=\"og:')")} AS pct_pages_og_tags, {share("contains(html, 'rel=\"canonical\"')")} AS pct_pages_canonical,
  bool_or(contains(html, ' icon"')) AS has_favicon, bool_or(contains(html, 'CollegeOrUniversity') OR contains(html, 'EducationalOrganization')) AS has_edu_schema_markup, {ids},
  sum(n_pdf)::BIGINT AS pdf_link_count, sum(n_trusted)::BIGINT AS trusted_outbound_links, len({union('subdomains')})::BIGINT AS num_subdomains_seen, sum(len(mail))::BIGINT AS mailto_count,
  sum(len(list_filter(mail, lambda m: {domain("('http://' || m)")} = site_domain)))::DOUBLE / nullif(sum(len(mail)), 0) AS mailto_on_domain_ratio,
  sum(len({all_of('html', FREE)}))::BIGINT AS free_email_hits, sum(len({all_of('text', _PHONE)}))::BIGINT AS phone_number_hits, bool_or(regexp_matches(text, '{_STREET}') AND regexp_matches(text, '{_ZIP}')) AS has_street_address,
  max(list_max({years})) AS max_copyright_year, min(list_min({years})) AS min_copyright_year, max({_tld('url')}) AS tld
  FROM f GROUP BY site)
SELECT s.*, b.ratio AS boilerplate_ratio, len(css_frameworks) > 0 AS uses_css_framework, len(list_filter(site_builders_detected, lambda x: x <> 'wordpress')) > 0 AS uses_site_builder FROM s LEFT JOIN b USING (site)"""


def _tld(url: str) -> str:
    return f"CASE WHEN contains({host(url)}, '.') THEN string_split({host(url)}, '.')[-1] ELSE '' END"


tld = _tld
#: Columns of a site by kind, as the queries show them.
LISTS = ("structure_hashes", "css_frameworks", "site_builders_detected", "meta_generators", *IDS)
RATIOS = ("avg_words_per_page", "avg_images_per_page", "img_alt_coverage", "text_to_html_ratio", "dom_structure_diversity", "avg_inline_styles_per_page", "pct_pages_meta_description", "pct_pages_og_tags", "pct_pages_canonical", "mailto_on_domain_ratio", "boilerplate_ratio")
PLAIN = (
    "pages_crawled", "total_a_tags", "total_internal_links", "total_external_links", "total_words", "total_images", "total_html_bytes", "unique_dom_structures", "num_stylesheets_landing", "has_favicon", "has_edu_schema_markup",
    "pdf_link_count", "trusted_outbound_links", "num_subdomains_seen", "mailto_count", "free_email_hits", "phone_number_hits", "has_street_address", "max_copyright_year", "min_copyright_year", "uses_css_framework", "uses_site_builder",
)


def shown(site: DataFrame, *columns: str) -> DataFrame:
    """Columns as they are compared: lists joined, ratios rounded."""
    return site.select(F.col("site_key").alias("site"), *[F.array_join(c, ",").alias(c) if c in LISTS else F.round(c, 6).alias(c) if c in RATIOS else F.col(c) for c in columns])


def shown_sql(*columns: str, cap: int = 25) -> str:
    return f"SELECT site, {', '.join(f'''array_to_string({c}, ',') AS {c}''' if c in LISTS else f'round({c}, 6) AS {c}' if c in RATIOS else c for c in columns)} FROM ({site_sql(cap)})"


SECTIONS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN bool_or(contains(lower(url), '{s}')) THEN '{s}' END" for s in sorted(EXPECTED_SECTIONS)) + ")"
