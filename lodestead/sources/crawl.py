"""A whole crawl as a Spark job: sites are dealt to tasks, each site is visited politely by one of them, and everything
that was answered becomes a row.  The tables that the feature plan reads are selections of that one table.

Needs a network; queries work on tables of responses.
"""

from __future__ import annotations

import random
import re
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.config import DEFAULT_SITEMAPS, FeatureConfig
from lodestead.functions import patterns as R
from lodestead.operators.html import parse_page
from lodestead.operators.sitemap import decode
from lodestead.plans.features import Responses
from lodestead.schemas import ANSWERS
from lodestead.session import ship


@dataclass
class Answer:
    """One answer, or why there is none."""

    url: str
    final_url: str | None = None
    status: int | None = None
    headers: dict = field(default_factory=dict)
    body: bytes | None = None
    error: str | None = None
    ssl_bypass: bool = False

    @property
    def content_type(self) -> str:
        return next((v for k, v in self.headers.items() if k.lower() == "content-type"), "")

    def text(self) -> str:
        named = re.search(r"charset=[\"']?([\w.-]+)", self.content_type)
        try:
            return (self.body or b"").decode(named[1] if named else "utf-8", "replace")
        except LookupError:
            return (self.body or b"").decode("utf-8", "replace")


class Visitor:
    """Requests to one site, never closer together than the delay."""

    def __init__(self, config: FeatureConfig):
        self.config, self.delay, self.last = config, config.request_delay_sec, 0.0

    def ask(self, url: str, method: str = "GET") -> Answer:
        wait = self.last + self.delay - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.last = time.monotonic()
        try:
            return self._send(url, method, self.config.verify_ssl)
        except urllib.error.URLError as e:
            refused = isinstance(e.reason, ssl.SSLError) and self.config.verify_ssl and self.config.retry_unverified
            if not refused:
                return Answer(url, error=f"{type(e.reason).__name__}: {e.reason}")
            try:
                return replace(self._send(url, method, False), ssl_bypass=True)
            except Exception as again:  # noqa: BLE001  every failure is a row
                return Answer(url, error=f"{type(again).__name__}: {again}")
        except Exception as e:  # noqa: BLE001
            return Answer(url, error=f"{type(e).__name__}: {e}")

    def _send(self, url: str, method: str, verify: bool) -> Answer:
        context = ssl.create_default_context() if verify else ssl._create_unverified_context()
        request = urllib.request.Request(url, headers={"User-Agent": self.config.user_agent}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.config.request_timeout_sec, context=context) as r:
                return Answer(url, r.geturl(), r.status, dict(r.headers.items()), r.read())
        except urllib.error.HTTPError as e:
            return Answer(url, e.geturl(), e.code, dict(e.headers.items()), e.read())


def domain_of(url: str, suffixes: tuple[str, ...] = ()) -> str:
    labels = urlsplit(url).netloc.split(":")[0].lower().split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in suffixes else labels[-2:])


def canonical(url: str) -> str:
    return url.split("#")[0].rstrip("/")


def visit(start: str, config: FeatureConfig) -> Iterator[dict]:
    """Rows of ANSWERS for one site: robots.txt, pages breadth first up to the caps, a sample of links never visited,
    stylesheets, sitemaps, the certificate and the registration."""
    site, home, seq = Visitor(config), domain_of(start, config.public_suffixes), 0

    def row(kind: str, a: Answer, **more) -> dict:
        return {"kind": kind, "site_key": start, "seq": seq, "url": a.url, "final_url": a.final_url, "status": a.status, "headers": a.headers, "content_type": a.content_type, "text": None, "content": None, "get_status": None, "error": a.error, "ssl_bypass": a.ssl_bypass} | more

    answer = site.ask(urljoin(start, "/robots.txt"))
    rules, robots = RobotFileParser(), answer.text() if answer.status == 200 else ""
    rules.parse(robots.splitlines())
    yield row("robots", answer, text=robots)
    if delay := rules.crawl_delay(config.user_agent):
        site.delay = max(site.delay, float(delay))
    todo, seen, pages, inside, sheets = deque([start]), set(), 0, {}, {}
    while todo and pages < config.max_pages_per_site:
        url = todo.popleft()
        if canonical(url) in seen:
            continue
        seen.add(canonical(url))
        if not rules.can_fetch(config.user_agent, url):
            continue
        answer = site.ask(url)
        html = answer.text() if answer.status == 200 and "text/html" in answer.content_type else None
        yield row("page", answer, text=html)
        seq += 1
        facts = None if html is None else parse_page(html, answer.final_url)
        if facts is None:
            continue
        pages += 1
        sheets |= dict.fromkeys(facts["stylesheet_hrefs"])
        for anchor in facts["anchors"]:
            link = anchor["abs"]
            if not anchor["href"].startswith(("mailto:", "javascript:", "#", "tel:")) and link.lower().startswith(("http://", "https://")) and domain_of(link, config.public_suffixes) == home:
                inside[canonical(link)] = None
                if canonical(link) not in seen and len(seen) + len(todo) < 8 * config.max_pages_per_site:
                    todo.append(link)
    if not pages:
        return
    left = sorted((u for u in inside if u not in seen), key=lambda u: (_order(u), u))
    for url in left[: config.broken_link_sample_size]:
        answer = site.ask(url, "HEAD")
        again = site.ask(url) if answer.status == 405 else None
        yield row("check", answer, get_status=again.status if again else None, error=answer.error or (again.error if again else None))
    for url in list(sheets)[: config.max_css_files_per_site]:
        answer = site.ask(url)
        yield row("css", answer, content=answer.body)
    if config.collect_sitemap:
        yield from (row("sitemap", a, content=a.body) for a in _sitemaps(start, robots, site))
    yield row("tls", Answer(urlsplit(start).netloc.split(":")[0]), **certificate(start, config))
    if config.lookup_whois:
        yield row("whois", Answer(home), **registration(home, config.request_timeout_sec))


def _order(url: str) -> int:
    """The order of ``sites.unvisited_links``: Spark's hash of the address, signed."""
    h = xxhash.xxh64_intdigest(url.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _sitemaps(start: str, robots: str, site: Visitor) -> Iterator[Answer]:
    """The files that ``sitemap.collect_inventory`` will ask for."""
    plain = lambda pattern: re.compile(re.sub(r"^(?:\(\?[a-zA-Z]+\))+", "", pattern), re.I | re.M | re.S)  # noqa: E731  flags as those patterns carry
    queue = deque(plain(R.SITEMAP_DIRECTIVE).findall(robots) or [urljoin(start, p) for p in DEFAULT_SITEMAPS])
    seen, urls = set(), 0
    while queue and len(seen) < site.config.max_sitemap_files and urls < site.config.max_sitemap_urls:
        url = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        answer = site.ask(url)
        yield answer
        body = decode(answer.body, url) if answer.status == 200 else None
        locs = plain(R.SITEMAP_LOC).findall(body or "")
        if locs and "<sitemapindex" in body.lower():
            queue.extend(locs)
        else:
            urls += len(locs)


def certificate(url: str, config: FeatureConfig) -> dict:
    """What the handshake says, as the fields of a row."""
    host, context = urlsplit(url).netloc.split(":")[0], ssl.create_default_context()
    if not config.verify_ssl:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    try:
        with socket.create_connection((host, 443), timeout=config.request_timeout_sec) as s, context.wrap_socket(s, server_hostname=host) as tls:
            got = tls.getpeercert() or {}
    except ssl.SSLError as e:
        return {"error": str(e)}
    except Exception:  # noqa: BLE001  no connection is no certificate, and no error of one
        return {}
    named = {k: dict(pair for part in got.get(k, ()) for pair in part).get("organizationName") for k in ("issuer", "subject")}
    until = got.get("notAfter")
    said = named | {"until": str(ssl.cert_time_to_seconds(until)) if until else None}
    return {"status": 1, "headers": {k: v for k, v in said.items() if v}}


def registration(domain: str, timeout: float) -> dict:
    """The registrar's record, asked for where the root server points."""

    def ask(server: str) -> str:
        with socket.create_connection((server, 43), timeout=timeout) as s:
            s.sendall(domain.encode("idna") + b"\r\n")
            return b"".join(iter(lambda: s.recv(4096), b"")).decode("utf-8", "replace")

    try:
        said = ask("whois.iana.org")
        other = re.search(r"(?im)^(?:refer|whois):\s*(\S+)", said)
        return {"status": 1, "text": ask(other[1]) if other else said}
    except Exception as e:  # noqa: BLE001
        return {"error": f"{type(e).__name__}: {e}"}


CREATED = r"(?im)^\s*(?:creation date|created(?: on)?|registered(?: on)?|domain registration date):\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
ORGANISATION = r"(?im)^\s*(?:registrant organi[sz]ation|org(?:-name|anisation|anization)?|registrant):[ \t]*(\S[^\r\n]*)"


def crawl(urls: DataFrame, config: FeatureConfig = FeatureConfig(), tasks: int = 64) -> DataFrame:
    """urls(input_url), distinct -> ANSWERS.  A site is visited by one task from start to end; write the result before it
    is read, or the sites are visited again."""
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for frame in frames:
            for url in frame["input_url"]:
                if not first and config.mid_run_pause_sec:
                    time.sleep(config.mid_run_pause_sec * random.uniform(1, 1.5))
                first = False
                rows = list(visit(url, config))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", ANSWERS)])

    return urls.select("input_url").repartition(tasks, "input_url").mapInPandas(run, ANSWERS)


def responses(answers: DataFrame) -> Responses:
    """The tables of the feature plan."""

    def of(kind: str, *columns) -> DataFrame:
        return answers.where(F.col("kind") == kind).select(*columns)

    fields = F.col("headers")
    ok = F.coalesce(F.col("status") == 1, F.lit(False))
    dates = F.transform(F.regexp_extract_all("text", F.lit(CREATED), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")))
    return Responses(
        of("page", "site_key", "seq", "url", "final_url", "status", "headers", "content_type", F.col("text").alias("html"), "error", "ssl_bypass"),
        of("robots", "site_key", F.col("text").alias("robots_text")),
        of("sitemap", "site_key", "url", "status", "content"),
        of("check", "site_key", "url", F.col("status").alias("head_status"), "get_status", "error"),
        of("css", "site_key", F.col("url").alias("href"), "status", "content"),
        of("tls", F.col("url").alias("hostname"), fields["issuer"].alias("issuer_org"), fields["subject"].alias("subject_org"), F.timestamp_seconds(fields["until"].cast("double")).alias("not_after"), ok.alias("handshake_ok"), "error").dropDuplicates(["hostname"]),
        of("whois", F.col("url").alias("domain"), dates.alias("creation_dates"), F.nullif(F.regexp_extract("text", ORGANISATION, 1), F.lit("")).alias("org"), F.col("text").alias("raw_text")).where("raw_text is not null").dropDuplicates(["domain"]),
    )
