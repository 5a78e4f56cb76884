"""Regex scans of a page, as Column expressions.  (?U) makes character classes Unicode-aware as the reference's are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the reference's for equal results.
CSS_FRAMEWORKS = {"bootstrap": "bootstrap", "tailwind": "tailwind", "foundation": r"foundation(\.min)?\.css", "bulma": "bulma", "materialize": "materialize"}
SITE_BUILDERS = {"wix": r"wix\.com|wixstatic", "squarespace": "squarespace", "weebly": "weebly", "godaddy": "godaddy|websitebuilder", "wordpress": "wp-content|wordpress"}
GA_UA = r"(?U)\bUA-\d{4,10}-\d{1,4}\b"
GA4 = r"(?U)\bG-[A-Z0-9]{6,14}\b"
GTM = r"(?U)\bGTM-[A-Z0-9]{4,10}\b"
FB_PIXEL = r"(?U)fbq\(\s*['\"]init['\"]\s*,\s*['\"](\d{5,20})['\"]"
PHONE = r"(?U)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"
ZIP = r"(?U)\b\d{5}(?:-\d{4})?\b"
STREET = (
    r"(?iu)(?U)\b\d{1,6}\s+\w[\w\s.]{0,40}?"
    r"(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Way|Court|Ct\.?|Place|Pl\.?|Circle|Parkway|Pkwy\.?)\b"
)
COPYRIGHT_YEAR = r"(?iu)(?U)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"
FREE_EMAIL = r"(?iu)@(gmail|yahoo|hotmail|outlook|aol|protonmail|icloud|mail)\.(com|ru|net)"
SITEMAP_DIRECTIVE = r"(?imu)(?U)^\s*sitemap:\s*(\S+)"
SITEMAP_LOC = r"(?isu)(?U)<loc>\s*(.*?)\s*</loc>"
SITEMAP_LASTMOD = r"(?isu)(?U)<lastmod>\s*(.*?)\s*</lastmod>"


def found_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def found_set(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(found_all(text, pattern, group))


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def has_street_address(text: Column) -> Column:
    """A street and a ZIP code on the same page; the same digits may serve for both."""
    return F.coalesce(text.rlike(STREET) & text.rlike(ZIP), F.lit(False))


def copyright_years(text: Column) -> Column:
    return F.transform(found_all(text, COPYRIGHT_YEAR, 1), lambda y: y.cast("int"))


def named(patterns: dict[str, str], test) -> Column:
    """Names of the patterns for which ``test(pattern)`` holds."""
    return F.array_compact(F.array(*[F.when(test(p), F.lit(name)) for name, p in patterns.items()]))


def css_in_head(html: Column, prefix: int) -> Column:
    """Frameworks named in the first ``prefix`` characters."""
    head = F.substring(html, 1, prefix)
    return named(CSS_FRAMEWORKS, lambda p: F.coalesce(head.rlike("(?iu)" + p), F.lit(False)))


def css_frameworks(in_head: Column, hrefs: Column) -> Column:
    """Frameworks named there or in a stylesheet's address."""
    names = {p: name for name, p in CSS_FRAMEWORKS.items()}
    return named(CSS_FRAMEWORKS, lambda p: F.array_contains(in_head, names[p]) | F.exists(hrefs, lambda h: h.rlike("(?iu)" + p)))


def site_builders(html: Column, prefix: int) -> Column:
    head = F.substring(html, 1, prefix)
    return named(SITE_BUILDERS, lambda p: F.coalesce(head.rlike("(?iu)" + p), F.lit(False)))
