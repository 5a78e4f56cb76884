"""Scalars against hand-derived values (cases C1-C6, C9, C24, C27 of FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from lodestead.functions import patterns as R
from lodestead.functions import text as T
from lodestead.functions import urls as U
from lodestead.operators import matrix


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("v")).first()[0]


@pytest.mark.parametrize(("f", "text", "want"), [
    (U.normalize_url, "  EX.edu ", "https://EX.edu"), (U.normalize_url, "HTTP://a.b", "HTTP://a.b"), (U.host, "https://u:p@A.edu:8/x", "u"), (U.host, "https://WWW.A.edu:8/x", "www.a.edu"),
    (U.host, "not a url", ""), (U.registered_domain, "https://x.y.ac.uk/", "ac.uk"), (U.registered_domain, "http://localhost/", "localhost"), (U.tld, "http://localhost/", ""),
    (U.tld, "http://a.b.org/x", "org"), (U.canonical_url, "http://a/b//#c#d", "http://a/b"), (U.path_depth, "https://a.edu/library/x.pdf?v=1", 2), (U.path_depth, "https://a.edu", 0),
    (U.top_directory, "https://a.edu/News/2024/", "news"), (U.top_directory, "https://a.edu/", None), (U.top_directory, "https://a.edu/index.html", "index.html"),
    (U.is_pdf, "https://a/x.PDF?y=.html", True), (U.is_pdf, "https://a/x.pdf#page=2", False), (U.mailto_domain, "mailto:X@Example.EDU?subject=s", "example.edu"),
    (U.mailto_domain, "mailto:a@b@c", "b@c"), (U.mailto_domain, "mailto:nobody", None), (U.host, None, None),
])
def test_urls(spark, f, text, want):
    assert value(spark, f, text) == want


def test_public_suffixes(spark):
    assert value(spark, lambda c: U.registered_domain(c, ("ac.uk",)), "https://x.y.ac.uk/") == "y.ac.uk"
    assert value(spark, lambda c: U.tld(c, ("ac.uk",)), "https://x.y.ac.uk/") == "ac.uk"


TRACKED = "<script>ga('UA-12345-1'); gtag('G-ABC123'); GTM-AB12; fbq('init', '1234567890');</script>"


@pytest.mark.parametrize(("pattern", "group", "want"), [(R.GA_UA, 0, ["UA-12345-1"]), (R.GA4, 0, ["G-ABC123"]), (R.GTM, 0, ["GTM-AB12"]), (R.FB_PIXEL, 1, ["1234567890"])])
def test_trackers(spark, pattern, group, want):
    assert value(spark, lambda c: R.found_set(c, pattern, group), TRACKED) == want


@pytest.mark.parametrize(("f", "text", "want"), [
    (lambda c: R.count(c, R.FREE_EMAIL), "a@gmail.com b@Yahoo.com c@corp.com d@mail.ru", 3), (lambda c: R.count(c, R.PHONE), "Call 415-555-1212 or (212) 555.1212", 2),
    (R.has_street_address, "12345 Main Street", True), (R.has_street_address, "Main Street", False), (R.has_street_address, None, False),
    (R.copyright_years, "© 1999-2024", [2024]), (R.copyright_years, "Copyright © 2020", [2020]), (R.copyright_years, "Copyright (c) 2021", []), (R.copyright_years, "© 1999, 2005", [1999]),
    (lambda c: F.size(T.shingles(c)), "a b c d", 0), (lambda c: F.size(T.shingles(c)), "a b c d e", 1), (lambda c: F.size(T.shingles(c)), "a b c d e a b c d e", 5), (lambda c: F.size(T.shingles(c)), None, 0),
    (T.word_count, " a b\n", 2), (T.word_count, None, 0), (T.byte_length, "é", 2), (lambda c: R.found_all(c, R.SITEMAP_DIRECTIVE, 1), "User-agent: *\n  SITEMAP: https://a/s.xml", ["https://a/s.xml"]),
    (matrix.parse_list, "['a', 'b']", ["a", "b"]), (matrix.parse_list, '["a"]', ["a"]), (matrix.parse_list, "[]", []), (matrix.parse_list, "abc", []), (matrix.parse_list, None, []),
])
def test_patterns(spark, f, text, want):
    assert value(spark, f, text) == want


def test_bool_mapping(spark):
    got = [value(spark, matrix.to_bool, x) for x in ("True", "true", "1", "False", "FALSE", "yes", "2", None)]
    assert got == [1.0, 1.0, 1.0, 0.0, None, None, None, None]
