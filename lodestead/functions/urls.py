"""URL scalars as Column expressions; none raises on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host up to the first colon; what precedes a colon in user info counts, as it does in the reference."""
    return F.lower(F.substring_index(netloc(url), ":", 1))


def registered_domain(url: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The last two labels of the host; one more under the given two-label public suffixes."""
    h = host(url)
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(h, ".", -3)).otherwise(two) if suffixes else two


def tld(url: Column, suffixes: tuple[str, ...] = ()) -> Column:
    h = host(url)
    last = F.when(h.contains("."), F.substring_index(h, ".", -1)).otherwise("")
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(last) if suffixes else last


def normalize_url(url: Column) -> Column:
    """Trimmed of white space, with https:// put in front unless a web scheme is there."""
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def canonical_url(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.rtrim(F.substring_index(url, "#", 1), F.lit("/"))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def is_pdf(url: Column) -> Column:
    return F.endswith(strip_query(F.lower(url)), F.lit(".pdf"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def top_directory(url: Column) -> Column:
    """First path segment in lower case, null if there is none; a file at the root counts."""
    return F.nullif(F.lower(F.get(F.split(path(url), "/"), F.lit(1))), F.lit(""))


def has_query(url: Column) -> Column:
    return url.contains("?")


def mailto_domain(href: Column) -> Column:
    """Domain of a mailto: link, null if it has no @."""
    address = F.substring_index(F.substr(href, F.lit(8)), "?", 1)
    return F.when(address.contains("@"), F.lower(F.substr(address, F.instr(address, "@") + 1)))


def file_name(domain: Column) -> Column:
    return F.translate(domain, ".", "_")
