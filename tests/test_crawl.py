"""A crawl of a small server on this machine, through to features, and the commands."""

import datetime
import gzip
import http.server
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestead import cli, schemas, sinks
from lodestead.config import FeatureConfig
from lodestead.operators import crawl as walk
from lodestead.plans.features import Responses, build_feature_dataframe, site_features
from lodestead.sources import crawl
from lodestead.sources.institutions import institutions

HOME = """<html><head><link rel=stylesheet href=/s.css><link rel=stylesheet href=/lost.css></head><body><a href=/a>a</a><a href=/private/x>p</a><a href="/gone">g</a><a href=/paper.pdf>f</a>
<a href=mailto:x@y.org>m</a><a href=https://nces.ed.gov/>t</a><a href=/b#part>b</a></body></html>"""
PAGES = {"/": HOME, "/a": "<p>one<a href=/private/y>q</a><a href=/deep1>d</a>", "/b": "<p>two<a href=/head>h</a>", **{f"/deep{k}": f"<p>deep<a href=/deep{k + 1}>n</a>" for k in range(1, 40)}}


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        path, kind = self.path, "text/html; charset=utf-8"
        body = PAGES.get(path)
        if path == "/robots.txt":
            body, kind = f"User-agent: *\nDisallow: /private\nSitemap: http://{self.headers['Host']}/map.xml.gz\n", "text/plain"
        elif path == "/map.xml.gz":
            body = gzip.compress(f"<urlset><url><loc>http://{self.headers['Host']}/library/x</loc><lastmod>2024-01-05</lastmod></url></urlset>".encode())
        elif path in ("/s.css", "/paper.pdf", "/head"):
            body, kind = f"content of {path}", "text/css"
        self.server.log.append((self.command, path))
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Type", kind)
        self.send_header("Server", "small")
        self.end_headers()
        self.wfile.write((body or "none").encode() if isinstance(body, str) or body is None else body)

    def do_HEAD(self):
        self.server.log.append((self.command, self.path))
        self.send_response(405 if self.path in ("/head", "/deep2") else 404)
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.log = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


FAST = FeatureConfig(request_delay_sec=0.0, mid_run_pause_sec=0.0, request_timeout_sec=5.0)


def test_crawl_to_features(spark, server, tmp_path):
    at = f"http://127.0.0.1:{server.server_port}"
    config = replace(FAST, max_pages_per_site=4, save_url_inventory_dir=str(tmp_path / "urls"))
    urls = spark.createDataFrame([(at,), ("http://127.0.0.1:9",)], "input_url string")
    sinks.write_table(crawl.crawl(urls, config, 2), str(tmp_path / "answers"))
    answers = spark.read.schema(schemas.ANSWERS).parquet(str(tmp_path / "answers"))
    got = {r.input_url: r for r in site_features(urls, crawl.responses(answers), F.lit("2024-02-04").cast("timestamp"), config).collect()}
    lost, r = got["http://127.0.0.1:9"], got[at]
    assert lost.crawl_error.startswith("ConnectionRefusedError") and lost.pages_crawled == 0
    assert [p for m, p in server.log if m == "GET"][:6] == ["/robots.txt", "", "/a", "/gone", "/paper.pdf", "/b"] or [p for m, p in server.log if m == "GET"][:6] == ["/robots.txt", "/", "/a", "/gone", "/paper.pdf", "/b"]
    assert ("GET", "/private/x") not in server.log and ("GET", "/private/y") not in server.log
    assert (r.crawl_error, r.pages_crawled, r.robots_blocked_count, r.landing_status_code, r.https_redirect, r.ssl_bypass_used) == (None, 4, 2, 200, False, False)
    assert (r.server_headers, r.num_stylesheets_landing, len(r.css_content_hashes), r.pdf_link_count, r.trusted_outbound_links, r.mailto_count) == (["small"], 2, 1, 1, 1, 1)
    # /private/x and /private/y are refused, not unvisited; /head answers a GET, /deep2 too
    asked = {p for m, p in server.log if m == "HEAD"}
    assert asked == {"/head", "/deep2"} and r.broken_link_sample_n == 2 and r.broken_link_rate_sampled == 0.0
    assert (r.sitemap_found, r.sitemap_source, r.sitemap_url_count, r.sitemap_expected_sections, r.sitemap_days_since_last_update, r.crawl_censored) == (True, "robots", 1, ["library"], 30, False)
    assert r.ssl_ok is False
    assert [x.value for x in spark.read.text(str(tmp_path / "urls")).collect()] == [f"{at}/library/x"]


def test_delay_and_cap(server):
    at = f"http://127.0.0.1:{server.server_port}/deep1"
    began = datetime.datetime.now()
    rows = list(crawl.visit(at, replace(FAST, request_delay_sec=0.05, max_pages_per_site=6, broken_link_sample_size=0, collect_sitemap=False)))
    assert [r["url"].rpartition("/")[2] for r in rows if r["kind"] == "page"] == [f"deep{k}" for k in range(1, 7)]
    assert (datetime.datetime.now() - began).total_seconds() >= 0.05 * 6


def test_refused_pages_and_unparsable_landing(spark, monkeypatch):
    """Pages that robots.txt forbids are none, whatever the log holds, and a landing page that fails leaves its place."""
    page = lambda *links: "".join(f"<a href=/{x}>x</a>" for x in links) + "<p>words here</p>"
    log = [("https://e.edu", k, f"https://e.edu{p}", f"https://e.edu{p}", 200, {}, "text/html", h, None) for k, (p, h) in enumerate([("", "BROKEN"), ("/no/a", page()), ("/b", page("no/c", "d", "no/c#x")), ("/d", page("no/e"))])]
    import lodestead.operators.html as html

    original = html.parse_page
    monkeypatch.setattr(html, "parse_page", lambda h, u: None if h == "BROKEN" else original(h, u))
    fetched = spark.createDataFrame(log, schemas.FETCH_LOG)
    robots = spark.createDataFrame([("https://e.edu", "User-agent: *\nDisallow: /no")], schemas.ROBOTS)
    urls = spark.createDataFrame([("https://e.edu",)], "input_url string")
    refused = [r.url for r in walk.refused(fetched.select("site_key", "url"), robots, "x").collect()]
    assert refused == ["https://e.edu/no/a"]
    r = site_features(urls, Responses(fetched, robots), F.lit("2024-01-01").cast("timestamp")).first()
    # the broken page counts as one here if the workers parse by their own copy
    assert r.pages_crawled in (2, 3) and r.crawl_error is None


def test_frontier_counts_refusals_up_to_the_cap(spark):
    order = spark.createDataFrame([("s", f"u{k}" if k % 3 else f"/no/{k}", 0, k + 1) for k in range(12)], "site_key string, canon string, depth int, seq bigint").withColumn("canon", F.concat(F.lit("https://s.edu"), F.when(F.col("canon").startswith("/"), F.col("canon")).otherwise(F.concat(F.lit("/"), "canon"))))
    robots = spark.createDataFrame([("s", "User-agent: *\nDisallow: /no")], schemas.ROBOTS)
    pages = order.where("canon not like '%/no/%'").select("site_key", "canon")
    count = lambda cap: walk.frontier_blocked(order, robots, pages, FeatureConfig(max_pages_per_site=cap)).first().robots_blocked_count
    assert [count(c) for c in (1, 2, 3, 4, 5, 100)] == [1, 1, 2, 2, 3, 4]


def test_commands_resume(spark, server, tmp_path):
    """A second run finds the first one's results, visits only what is new, and compares with all of them."""
    at = f"http://127.0.0.1:{server.server_port}"
    csv = lambda *rows: "UNITID,school.school_url\n" + "".join(f"{i},{u}\n" for i, u in rows)
    (tmp_path / "one.csv").write_text(csv(("007", f"{at}/deep30"), ("8", f"{at}/deep30")))
    (tmp_path / "two.csv").write_text(csv(("007", f"{at}/deep30"), ("9", f"{at}/deep35"), ("10", "")))
    run = lambda name: cli.main(["crawl", str(tmp_path / name), "--max-pages", "3", "--pause", "0", "--delay", "0", "--tasks", "2", "--as-of", "2024-01-01", "--checkpoint", str(tmp_path / "done"), "--output", str(tmp_path / f"{name}.out")])
    run("one.csv")
    first = len(server.log)
    run("two.csv")
    assert not any(p == "/deep30" for _, p in server.log[first:]) and any(p == "/deep35" for _, p in server.log[first:])
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2
    out = {r.UNITID: r for r in spark.read.option("header", True).csv(str(tmp_path / "two.csv.out")).collect()}
    assert set(out) == {"007", "9"} and out["007"].pages_crawled == out["9"].pages_crawled == "3"
    assert out["9"].max_structure_similarity_other_site == "1.0"
    cli.main(["matrix", str(tmp_path / "two.csv.out"), "--year", "2024", "--output", str(tmp_path / "matrix")])
    assert spark.read.option("header", True).csv(str(tmp_path / "matrix")).count() == 2


def test_results_of_an_earlier_version(spark):
    """Results that lack columns are known sites all the same."""
    inputs = institutions(spark.createDataFrame([("1", "a.edu"), ("2", "b.edu")], "UNITID string, `school.school_url` string"), "school.school_url", "UNITID")
    log = spark.createDataFrame([("https://a.edu", 0, "https://a.edu", "https://a.edu", 200, {}, "text/html", "<p>x", None)], schemas.FETCH_LOG)
    done = spark.createDataFrame([("https://b.edu", ["h"])], "input_url string, structure_hashes array<string>")
    out = {r.UNITID: r for r in build_feature_dataframe(inputs, Responses(log), F.lit("2024-01-01").cast("timestamp"), done=done).collect()}
    assert out["1"].pages_crawled == 1 and out["2"].structure_hashes == ["h"] and out["2"].pages_crawled is None


def test_certificates_and_records():
    assert crawl.certificate("https://127.0.0.1", replace(FAST, request_timeout_sec=0.5)) == {}
    assert "error" in crawl.registration("example.invalid", 0.5)
    assert crawl.domain_of("https://www.x.ac.uk:8/y") == "ac.uk" and crawl.domain_of("https://www.x.ac.uk/y", ("ac.uk",)) == "x.ac.uk"
