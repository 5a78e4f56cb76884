"""Optional fetching as a Spark data source: one partition per site, polite within it.  Needs a network; never used by
queries or tests, which work on tables of responses."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestead.schemas import FETCH_LOG


class SitePartition(InputPartition):
    def __init__(self, site: str, urls: list[str]):
        super().__init__(site)
        self.site, self.urls = site, urls


class PoliteReader(DataSourceReader):
    """Options: urls (separated by white space), delay, timeout, user_agent, insecure, method (GET or HEAD)."""

    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.delay, self.timeout = float(options.get("delay", 1.5)), float(options.get("timeout", 15))
        self.agent, self.method = options.get("user_agent", "lodestead-crawler"), options.get("method", "GET")
        self.insecure = options.get("insecure", "false").lower() == "true"

    def partitions(self) -> list[SitePartition]:
        sites: dict[str, list[str]] = {}
        for url in self.urls:
            sites.setdefault("/".join(url.split("/")[:3]), []).append(url)
        return [SitePartition(site, urls) for site, urls in sites.items()]

    def read(self, partition: SitePartition) -> Iterator[tuple]:
        context = ssl._create_unverified_context() if self.insecure else ssl.create_default_context()
        for seq, url in enumerate(partition.urls):
            if seq:
                time.sleep(self.delay)
            try:
                request = urllib.request.Request(url, headers={"User-Agent": self.agent}, method=self.method)
                with urllib.request.urlopen(request, timeout=self.timeout, context=context) as r:
                    kind = r.headers.get("Content-Type", "")
                    body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace") if self.method == "GET" else None
                    yield partition.site, seq, url, r.geturl(), r.status, dict(r.headers.items()), kind, body, None
            except urllib.error.HTTPError as e:
                yield partition.site, seq, url, e.geturl(), e.code, dict(e.headers.items()), e.headers.get("Content-Type", ""), None, None
            except Exception as e:  # noqa: BLE001  every failure is a row
                yield partition.site, seq, url, None, None, {}, None, None, f"{type(e).__name__}: {e}"


class SiteFetch(DataSource):
    """spark.dataSource.register(SiteFetch); spark.read.format("site_fetch").option("urls", ...).load()."""

    @classmethod
    def name(cls) -> str:
        return "site_fetch"

    def schema(self) -> str:
        return FETCH_LOG

    def reader(self, schema) -> PoliteReader:
        return PoliteReader(self.options)
