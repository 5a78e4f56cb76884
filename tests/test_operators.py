"""Operators against hand-derived values and brute force."""

import datetime
import gzip
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestead import schemas, sinks
from lodestead.config import FeatureConfig
from lodestead.operators import crawl, cross_site, domain, matrix, pages, sitemap, sites
from lodestead.operators.html import parse_page
from lodestead.plans.features import Responses, build_feature_dataframe
from lodestead.sources import institutions
from lodestead.streaming.pages import stream_pages



def as_of():
    return F.lit("2024-01-25").cast("timestamp")


LINKS = """<html><body><a href="b.pdf">x</a><a href="c.pdf#page=2">x</a><a href="https://lib.example.edu/">x</a><a href="https://ed.gov/x.pdf">x</a>
<a href="mailto:X@Example.EDU?subject=s">m</a><a href="#top">t</a><a href="tel:1">p</a><a href="javascript:0">j</a><a name=z>n</a>
<img alt="x"><img alt=" "><img><link rel="stylesheet" href="/s.css"><link rel="shortcut icon" href="/i.ico"><meta name="Generator" content="WordPress 6"><meta property="og:title">
<script type="application/ld+json">{"@type": "CollegeOrUniversity"}</script><noscript><img alt="no"></noscript><p style="x">one &amp; two</p></body></html>"""


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def page(spark):
    df = rows(spark, "site_key string, page_seq int, url string, site_domain string, html string", ("s", 0, "https://www.example.edu/a/", "example.edu", LINKS), ("s", 1, "https://www.example.edu/b", "example.edu", None))
    return pages.page_features(df).collect()


def test_links(page):
    assert len(page) == 1  # a page that cannot be parsed goes
    p = page[0]
    assert list(p.asDict()) == list(schemas.PAGE_COLUMNS)
    assert (p.a_tag_count, len(p.internal_links), p.external_link_count, p.trusted_link_count, p.pdf_link_count) == (8, 3, 1, 1, 2)
    assert p.mailto_domains == ["example.edu"] and set(p.subdomains) == {"www.example.edu", "lib.example.edu"}


def test_page_flags(page):
    p = page[0]
    assert (p.img_count, p.img_alt_count, p.inline_style_count) == (3, 1, 1)
    assert p.stylesheet_hrefs == ["https://www.example.edu/s.css"] and p.has_favicon and p.has_og_tags and p.has_edu_schema and not p.has_canonical
    assert p.meta_generator == "WordPress 6" and p.site_builders == ["wordpress"] and not p.has_meta_description


def test_visible_text():
    facts = parse_page("<title>T</title><script>x</script><p> a <b>b</b></p><style>y</style>c&lt;", "http://x/")
    assert facts["visible_text"] == "T a b c<"
    assert parse_page(None, "http://x/") is None


def test_references_without_semicolon_stay():
    facts = parse_page("<title>ver&amp</title><p>a &copy 1 &amp; &copy; &notit; &#38; &eacute; & b &am</p>", "http://x/")
    assert facts["visible_text"] == "ver&amp a &copy 1 & \u00a9 &notit; & \u00e9 & b &am"


def test_boilerplate(spark):
    make = lambda n: rows(spark, "site_key string, page_seq int, shingles array<string>", *[("s", i, ["x", "y"] if i == 0 else ["x"] if i == 3 else ["z"]) for i in range(n)])
    assert sites.boilerplate(make(5)).first().boilerplate_ratio == 0.5
    assert sites.boilerplate(make(2)).first().boilerplate_ratio is None


def test_headers(spark):
    log = rows(spark, schemas.FETCH_LOG, ("s", 0, "u", "u", 200, {"server": "nginx"}, "text/html", "x", None), ("t", 0, "u", "https://u", 200, {"Server": "a", "Last-Modified": "x"}, "text/html", "x", None))
    got = {r.site_key: r for r in sites.header_features(log).collect()}
    assert got["s"].server_headers == [] and not got["s"].has_last_modified_header
    assert got["t"].server_headers == ["a"] and got["t"].has_last_modified_header
    assert {r.site_key: r.https_redirect for r in sites.landing_features(log).collect()} == {"s": False, "t": True}


def test_similarity_and_sharing(spark):
    s = rows(spark, "site string, t array<string>", ("A", ["h1", "h2"]), ("B", ["h2", "h3"]), ("C", []), ("D", ["h9"]))
    assert {r[0]: round(r[1], 6) for r in cross_site.max_similarity(s, "site", "t").collect()} == {"A": 0.333333, "B": 0.333333, "C": 0.0, "D": 0.0}
    s = rows(spark, "site string, t array<string>", ("A", ["x", "y"]), ("B", ["x", "y"]), ("C", ["y"]), ("D", []))
    assert {r[0]: r[1] for r in cross_site.sharing_sites(s, "site", "t", "n").collect()} == {"A": 2, "B": 2, "C": 2, "D": 0}


def test_cross_site_equals_all_pairs(spark):
    rng = random.Random(5)
    sets = {f"s{i}": sorted({rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))}) for i in range(40)}
    df = rows(spark, "site string, t array<string>", *sets.items())
    jac, share = dict.fromkeys(sets, 0.0), dict.fromkeys(sets, 0)
    for a, b in itertools.permutations(sets, 2):
        x, y = set(sets[a]), set(sets[b])
        if x & y:
            jac[a], share[a] = max(jac[a], len(x & y) / len(x | y)), share[a] + 1
    assert {r[0]: r[1] for r in cross_site.max_similarity(df, "site", "t").collect()} == pytest.approx(jac)
    assert {r[0]: r[1] for r in cross_site.sharing_sites(df, "site", "t", "n").collect()} == share


def test_sitemap_features(spark):
    urls = ["https://a.edu/", "https://a.edu/library/x.pdf?v=1", "https://a.edu/News/2024/", "https://b.edu/q"]
    inventory = rows(spark, "site_key string, urls array<string>, lastmods array<string>", ("a", urls, ["2024-1-5", "2024-01-15T08:00", "bad"]), ("b", ["https://x.org/"], []), ("c", ["https://c.edu/"], ["2024-01-01"] * 3))
    domains = rows(spark, "site_key string, registered_domain string", ("a", "a.edu"), ("b", "b.edu"), ("c", "c.edu"))
    got = {r.site_key: r for r in sitemap.sitemap_features(inventory, domains, as_of()).collect()}
    a = got["a"]
    assert (a.sitemap_url_count, a.sitemap_max_depth, a.sitemap_n_top_dirs, a.sitemap_pdf_count, a.sitemap_expected_sections) == (3, 2, 2, 1, ["library"])
    assert a.sitemap_avg_depth == pytest.approx(4 / 3) and a.sitemap_pct_query_urls == pytest.approx(1 / 3) and a.sitemap_pct_urls_with_lastmod == pytest.approx(2 / 3)
    assert (a.sitemap_days_since_last_update, a.sitemap_lastmod_span_days) == (10, 10)
    assert got["b"].sitemap_url_count == 0 and got["b"].sitemap_max_depth is None and got["b"].sitemap_pct_urls_with_lastmod is None
    assert got["c"].sitemap_pct_urls_with_lastmod == 3.0


def test_sitemap_walk(spark):
    index = b"<sitemapindex><sitemap><loc> https://a/1.xml.gz </loc></sitemap><loc>https://a/2.xml</loc></sitemapindex>"
    docs = rows(spark, schemas.SITEMAP_DOCS, ("s", "https://a/i.xml", 200, bytearray(index)), ("s", "https://a/1.xml.gz", 200, bytearray(gzip.compress(b"<urlset><loc>https://a/p</loc><lastmod>2024-01-01</lastmod></urlset>"))),
                ("s", "https://a/2.xml", 404, None), ("t", "https://t/sitemap.xml", 200, bytearray(b"<urlset><loc>https://t/x</loc></urlset>")))
    robots = rows(spark, schemas.ROBOTS, ("s", "Sitemap: https://a/i.xml\nSitemap: https://a/i.xml"), ("t", ""))
    base = rows(spark, "site_key string, base_url string", ("s", "https://a/x"), ("t", "https://t"))
    got = {r.site_key: r for r in sitemap.collect_inventory(base, robots, docs).collect()}
    assert got["s"].urls == ["https://a/p"] and got["s"].lastmods == ["2024-01-01"] and (got["s"].sitemap_source, got["s"].sitemap_files_fetched, got["s"].sitemap_truncated) == ("robots", 3, False)
    assert got["t"].urls == ["https://t/x"] and (got["t"].sitemap_source, got["t"].sitemap_files_fetched) == ("default_path", 2)
    capped = sitemap.collect_inventory(base, robots, docs, FeatureConfig(max_sitemap_files=1)).where("site_key = 's'").first()
    assert capped.sitemap_truncated and capped.urls == []


def test_domain(spark):
    t = datetime.datetime(2024, 3, 1)
    hosts = rows(spark, "site_key string, hostname string, registered_domain string", ("s", "www.a.edu", "a.edu"), ("t", "b.edu", "b.edu"))
    certs = rows(spark, schemas.TLS_CERTS, ("www.a.edu", "CA", None, t, True, None), ("b.edu", None, None, None, False, "expired"))
    got = {r.site_key: r for r in domain.tls_features(hosts.drop("registered_domain"), certs, as_of()).collect()}
    assert (got["s"].ssl_ok, got["s"].ssl_org_validated, got["s"].ssl_days_to_expiry, got["t"].ssl_ok, got["t"].ssl_cert_error, got["t"].ssl_org_validated) == (True, False, 36, False, "expired", None)
    whois = rows(spark, schemas.WHOIS, ("a.edu", [datetime.datetime(2024, 1, 20), None, datetime.datetime(2024, 1, 15)], "Org", "Redacted for ..."))
    got = {r.site_key: r for r in domain.whois_features(hosts.drop("hostname"), whois, as_of()).collect()}
    assert (got["s"].domain_age_days, got["s"].whois_privacy_protected, got["t"].domain_age_days, got["t"].whois_privacy_protected) == (10, True, None, None)


def test_robots_and_order(spark):
    urls = rows(spark, "site_key string, url string", ("s", "https://a/x"), ("s", "https://a/private/y"), ("t", "https://t/private"))
    assert {r.site_key: r.robots_blocked_count for r in crawl.robots_blocked(urls, rows(spark, schemas.ROBOTS, ("s", "User-agent: *\nDisallow: /private")), "bot").collect()} == {"s": 1, "t": 0}
    links = rows(spark, "site_key string, url string, pos int, target string", ("s", "u0", 0, "u1"), ("s", "u0", 1, "u2#x"), ("s", "u1", 0, "u3"), ("s", "u2/", 0, "u0"), ("s", "u2", 1, "u3"))
    assert [(r.canon, r.depth, r.seq) for r in crawl.crawl_order(rows(spark, "site_key string, url string", ("s", "u0")), links).orderBy("seq").collect()] == [("u0", 0, 1), ("u1", 1, 2), ("u2", 1, 3), ("u3", 2, 4)]


def test_matrix_steps(spark):
    df = rows(spark, "UNITID string, pages_crawled bigint, tld string, boilerplate_ratio double, total_external_links bigint, total_internal_links bigint, sitemap_url_count bigint, crawl_error string, css_frameworks string, has_favicon boolean, max_copyright_year int",
              ("001", 25, "edu", 0.4, 0, 0, 10, None, "['a', 'b']", True, 2020), ("002", 25, "k12.ca.us", 0.4, 3, 1, 0, None, "[]", False, 2030), ("003", 2, "ac.uk", 0.4, 1, 1, 1000, None, None, None, None), ("004", None, None, 0.4, None, None, None, "x", "abc", None, None))
    most = df.agg(F.max("pages_crawled")).first()[0]
    got = {r.UNITID: r for r in matrix.features(df, most, 2024).collect()}
    assert [got[k].pages_hit_cap for k in sorted(got)] == [1, 1, 0, 0] and [got[k].crawl_failed for k in sorted(got)] == [0, 0, 0, 1]
    assert [got[k].boilerplate_ratio for k in sorted(got)] == [0.4, 0.4, None, 0.4]
    assert (got["001"].external_link_share, got["002"].external_link_share, got["001"].crawl_coverage_ratio, got["002"].crawl_coverage_ratio, got["003"].crawl_coverage_ratio) == (None, 0.75, 1.0, None, 0.002)
    assert [got[k].n_css_frameworks for k in sorted(got)] == [2, 0, 0, 0] and got["002"].copyright_staleness_years == 0.0
    flags = ("is_edu_tld", "is_gov_or_state_tld", "is_org_tld", "is_com_net_tld", "is_foreign_or_other_tld")
    assert [[got[k][f] for f in flags] for k in sorted(got)] == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0]]
    out, report = matrix.build_model_matrix(df, 2024)
    assert not any(v is None for r in out.collect() for v in r) and report["n_rows_in"] == 4 and report["n_failed_crawls"] == 1 and report["n_tiny_crawls"] == 1
    assert "rows in: 4" in matrix.summarize(report) and out.columns[0] == "UNITID" and report["n_features_out"] == len(out.columns) - 1
    assert matrix.report_table(spark, report).count() == 1
    with pytest.raises(KeyError):
        matrix.build_model_matrix(df.drop("pages_crawled"), 2024)


def test_impute_and_constants(spark):
    df = rows(spark, "id string, a double, b double, c double", ("1", 1.0, None, 2.0), ("2", None, None, 3.0), ("3", 3.0, None, 2.0), ("4", 10.0, None, 2.0))
    out, report = matrix.complete(df, ["a", "b", "c"], matrix.profile(df, ["a", "b", "c"]))
    assert out.columns == ["id", "a", "c", "a_missing"] and [r.a for r in out.orderBy("id").collect()] == [1.0, 3.0, 3.0, 10.0] and report["dropped_constant_columns"] == ["b", "b_missing"]
    assert report["imputation_medians"] == {"a": 3.0, "b": 0.0}
    one = df.limit(1)
    assert matrix.complete(one, ["a", "b", "c"], matrix.profile(one, ["a", "b", "c"]))[0].columns == ["id"]


def test_whole_plan(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text("UNITID,school.school_url,x\n001,https://example.edu,1\n002,https://example.edu,1\n003,,1\n004,  EX.edu ,1\n")
    inputs = institutions.read_institutions(spark, str(csv))
    log = rows(spark, schemas.FETCH_LOG, ("https://example.edu", 0, "https://example.edu", "https://www.example.edu/a/", 200, {"Server": "x"}, "text/html", LINKS, None), ("https://EX.edu", 0, "https://EX.edu", None, None, {}, None, None, "Timeout: t"))
    got = Responses(log, robots=rows(spark, schemas.ROBOTS, ("https://example.edu", "")), sitemap_docs=rows(spark, schemas.SITEMAP_DOCS, ("x", "y", 404, None)), link_checks=rows(spark, schemas.LINK_CHECKS, ("https://example.edu", "https://lib.example.edu", 405, 200, None)),
                    css_files=rows(spark, schemas.CSS_FILES, ("https://example.edu", "https://www.example.edu/s.css", 200, bytearray(b"a"))), tls_certs=rows(spark, schemas.TLS_CERTS, ("example.edu", "CA", "O", None, True, None)), whois=rows(spark, schemas.WHOIS, ("example.edu", None, None, None)))
    out = build_feature_dataframe(inputs, got, as_of()).orderBy("UNITID").collect()
    assert [r.UNITID for r in out] == ["001", "002", "004"] and out[0].asDict() | {"UNITID": ""} == out[1].asDict() | {"UNITID": ""}
    assert out[0].pages_crawled == 1 and out[0].crawl_error is None and out[0].broken_link_sample_n == 3 and out[0].broken_link_rate_sampled == pytest.approx(2 / 3)
    assert out[0].css_content_hashes == ["86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"] and out[0].ssl_ok and out[0].sitemap_url_count == 0
    assert out[2].crawl_error == "Timeout: t" and out[2].pages_crawled == 0 and out[2].ssl_ok is None
    assert [c for c in out[0].asDict() if c in schemas.RAW_COLUMNS] == list(schemas.RAW_COLUMNS)
    with pytest.raises(KeyError):
        institutions.institutions(inputs, "nope", "UNITID")


def test_sinks_and_resume(spark, tmp_path):
    path = str(tmp_path / "results")
    assert sinks.results(spark, path) is None
    urls = rows(spark, "input_url string", ("a",), ("b",))
    sinks.append_results(urls.where("input_url = 'a'"), path)
    left = sinks.todo(urls, sinks.results(spark, path))
    assert [r[0] for r in left.collect()] == ["b"]
    sinks.append_results(left, path)
    assert sinks.results(spark, path).count() == 2
    sinks.write_csv(rows(spark, "a string, b array<string>", ("x", ["q"])), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == '["q"]'
    assert sinks.sanitised(rows(spark, "b array<string>", (["q", "a", "q"],))).first().b == ["a", "q"]
    sinks.write_inventory(rows(spark, "site_key string, urls array<string>", ("s", ["u", "v"]), ("t", [])), rows(spark, "site_key string, registered_domain string", ("s", "a.edu"), ("t", "t.edu")), str(tmp_path / "inv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "inv/site=a_edu")).collect()) == ["u", "v"]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "log")
    schema = schemas.FETCH_LOG + ", site_domain string"
    rows(spark, schema, ("s", 0, "u", "https://www.example.edu/a/", 200, {}, "text/html", LINKS, None, "example.edu")).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for _ in range(2):  # a second run finds nothing new
        stream_pages(stream, str(tmp_path / "pages"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 1


def test_sharing_over_all_rows_and_common_tokens(spark):
    rng = random.Random(5)
    sites = {i: {"common"} | {f"t{rng.randrange(40)}" for _ in range(rng.randrange(4))} if i % 5 else set() for i in range(80)}
    df = spark.createDataFrame([(i, sorted(t)) for i, t in sites.items()], "site bigint, tokens array<string>")
    got = {r.site: r.sharing for r in cross_site.sharing_sites(df, "site", "tokens", "sharing").collect()}
    assert got == {i: sum(1 for j in sites if j != i and sites[i] & sites[j]) for i in sites}


def test_rates_keep_sites_without_a_denominator(spark, sf):
    from lodestead.plans import catalogue

    out = catalogue.QUERIES["per_page_rates"](spark, sf).collect()
    assert len(out) == catalogue.hosts(spark, sf).count() and any(r.external_link_share is None for r in out) and any(r.external_link_share for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_medians_are_exact(spark, seed):
    """Against sorting, over ties, nulls, few and many rows."""
    rng = random.Random(seed)
    n = (1, 2, 7, 60_000)[seed]
    data = [(rng.choice((None, 1.0, 2.0)), rng.gauss(0, 1), float(rng.randrange(50)) if rng.random() < 0.9 else None, 3.0, None) for _ in range(n)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    stats = matrix.profile(df, list("abcde"))
    assert stats[""]["rows"] == n
    for at, c in enumerate("abcde"):
        have = [r[at] for r in data if r[at] is not None]
        want = statistics.median(have) if have else None
        assert stats[c] == {"n": len(have), "lo": min(have, default=None), "hi": max(have, default=None), "median": want}


def test_numbers(spark):
    texts = ["1", " 2.5 ", "1d", "1f", "-3e2", "0x1", "1_000", "", "nan", "inf", ".5", "5.", None, "true"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(matrix.number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, None, None, -300.0, None, None, None, None, float("inf"), 0.5, 5.0, None, None]


def test_matrix_of_a_path(spark, tmp_path):
    raw = spark.createDataFrame([("u1", 5, "a"), ("u2", 2, None)], "input_url string, pages_crawled int, crawl_error string")
    sinks.write_csv(raw, str(tmp_path / "raw.csv"))
    out, report = matrix.build_model_matrix(str(tmp_path / "raw.csv"), output_csv=str(tmp_path / "out"), drop_constant_columns=False, spark=spark)
    assert (report["n_rows_in"], report["n_failed_crawls"], report["n_tiny_crawls"]) == (2, 1, 1) and report["output"] == str(tmp_path / "out")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == out.count() == 2


def test_crawl_order_follows_a_chain_to_the_cap(spark):
    links = spark.createDataFrame([(s, f"u{k}", 0, f"u{k + 1}") for s, n in (("a", 12), ("b", 30)) for k in range(n)], "site_key string, url string, pos int, target string")
    starts = spark.createDataFrame([("a", "u0"), ("b", "u0")], "site_key string, url string")
    got = sorted((r.site_key, r.depth, r.seq) for r in crawl.crawl_order(starts, links, FeatureConfig(max_pages_per_site=2)).collect())
    assert got == [("a", k, k + 1) for k in range(13)] + [("b", k, k + 1) for k in range(16)]


@pytest.mark.parametrize(("light", "block", "bits"), [(32, 1 << 20, 32 << 20), (1, 1 << 15, 1 << 13), (2, 1 << 15, 1 << 15)])
def test_common_tokens_make_no_pairs(spark, monkeypatch, light, block, bits):
    """One token on all sites and a few on many, against all pairs; and rows of the pair join in proportion to the sites."""
    monkeypatch.setattr(cross_site, "LIGHT", light)
    monkeypatch.setattr(cross_site, "BLOCK", block)
    monkeypatch.setattr(cross_site, "BLOCK_BYTES", bits)
    rng = random.Random(7)
    sets = {f"s{i}": {"everywhere"} | {f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))} | {f"rare{rng.randrange(150)}" for _ in range(rng.randrange(3))} for i in range(120)}
    sets |= {"alone": {"only"}, "none": set(), "twin": set(sets["s0"])}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "site string, t array<string>")
    share = {k: sum(bool(v & w) for j, w in sets.items() if j != k) for k, v in sets.items()}
    best = {k: max((len(v & w) / len(v | w) for j, w in sets.items() if j != k and v | w), default=0.0) for k, v in sets.items()}
    assert {r[0]: r[1] for r in cross_site.sharing_sites(df, "site", "t", "n").collect()} == share
    assert {r[0]: r[1] for r in cross_site.max_similarity(df, "site", "t").collect()} == pytest.approx(best)


@pytest.mark.parametrize(("light", "bits", "kept"), [(32, 1 << 13, 2), (1, 1 << 12, 3), (3, 1 << 15, 16)])
def test_sharing_shuffles_in_proportion_to_the_sites(spark, monkeypatch, light, bits, kept):
    """Many tokens, each on a fourth of the sites, in several blocks: right, and four times the sites shuffle about four times as much."""
    monkeypatch.setattr(cross_site, "LIGHT", light)
    monkeypatch.setattr(cross_site, "BLOCK_BYTES", bits)
    monkeypatch.setattr(cross_site, "KEPT", kept, raising=False)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    rng, took = random.Random(11), []
    for n in (300, 1200):
        sets = [set(rng.sample(range(40), 10)) for _ in range(n - 20)] + [{1000 + i} for i in range(10)] + [set(range(10))] * 10
        df = spark.createDataFrame([(i, sorted(f"t{x}" for x in v)) for i, v in enumerate(sets)], "site bigint, t array<string>")
        masks = [sum(1 << x for x in v) for v in sets]
        before = written()
        got = {r[0]: r[1] for r in cross_site.sharing_sites(df, "site", "t", "n").collect()}
        took.append(written() - before)
        assert got == {i: sum(bool(m & o) for o in masks) - 1 for i, m in enumerate(masks)}
    assert took[1] < 6 * took[0]
    best = {i: max((m & o).bit_count() / (m | o).bit_count() for j, o in enumerate(masks) if j != i) for i, m in enumerate(masks[:50])}
    alike = {r[0]: r[1] for r in cross_site.max_similarity(df, "site", "t").collect()}
    assert {i: alike[i] for i in best} == pytest.approx(best)


def test_wide_tables_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cross_site, "SMALL", 0, raising=False)
    df = rows(spark, "site string, t array<string>", ("A", ["x", "y"]), ("B", ["y", None]), ("C", ["x"]), ("D", ["x"]), ("E", []), ("F", None), (None, ["x"]))
    assert {r[0]: r[1] for r in cross_site.sharing_sites(df, "site", "t", "n").collect()} == {"A": 3, "B": 1, "C": 2, "D": 2, "E": 0, "F": 0, None: 0}
