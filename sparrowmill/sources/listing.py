"""Listing pages from the web as a Spark data source.

As a stream a listing is followed page by page: each batch fetches the next page, with
spacing and retries, in one place, so all requests of a listing keep their distance; the
first page without a new link ends it, and nothing is asked for after that. The offset holds
the page and the links seen, so a restarted stream goes on where it was. As a batch all
pages up to a number known beforehand are fetched at once, a page a partition.
"""

from __future__ import annotations

import hashlib
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SPACING, TRIES = 2.0, 3


def http_get(url: str) -> tuple[int, str]:
    """Status and text of a page; 0 where the network fails."""
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except (urllib.error.URLError, TimeoutError):
        return 0, ""


def fetched(url: str, get: Callable[[str], tuple[int, str]] = http_get, sleep: Callable[[float], None] = time.sleep, spacing: float = SPACING) -> str | None:
    """The page's text after at most TRIES tries, spacing seconds before each; None where all fail.

    Too many requests (429) wait a minute times the number of the try, errors of the
    server or network five seconds times it. Other refusals are errors at once.
    """
    for attempt in range(1, TRIES + 1):
        sleep(spacing)
        status, text = get(url)
        if 200 <= status < 300:
            return text
        if 400 <= status < 500 and status != 429:
            raise ValueError(f"{url} answers {status}")
        sleep(60.0 * attempt if status == 429 else 5.0 * attempt)
    return None


def page_links(html: str, extension: str) -> list[str]:
    """Addresses of a page's anchors that end so, in either case."""
    found = re.findall(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", html, re.IGNORECASE)
    return [h for h in found if h.lower().endswith(extension.lower())]


class Listing(DataSource):
    """spark.readStream.format("listing").option("url", ...).load(): page_no, url, html, up to option pages (50) of them.

    Links are addresses that end with option extension (.pdf). register() makes the format known.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "page_no int, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["url"], int(self.options.get("pages", 50)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PacedListing(self.options["url"], int(self.options.get("pages", 50)), self.options.get("extension", ".pdf"), float(self.options.get("spacing", SPACING)))


def numbered(url: str, page: int) -> str:
    return url if page == 1 else f"{url}?page={page}"


class PacedListing(SimpleDataSourceStreamReader):
    """One page a batch. An offset is the last page asked for, marks of the links up to it, and whether the listing has ended."""

    def __init__(self, url: str, pages: int, extension: str = ".pdf", spacing: float = SPACING, get: Callable[[str], tuple[int, str]] = http_get, sleep: Callable[[float], None] = time.sleep):
        self.url, self.pages, self.extension, self.spacing, self.get, self.sleep = url, pages, extension, spacing, get, sleep

    def initialOffset(self) -> dict:
        return {"page": 0, "seen": [], "ended": False}

    def _page(self, n: int) -> str | None:
        return fetched(numbered(self.url, n), self.get, self.sleep, self.spacing)

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str, str]], dict]:
        if start["ended"] or start["page"] >= self.pages:
            return iter([]), start
        n = start["page"] + 1
        html = self._page(n)
        marks = {hashlib.blake2b(h.encode(), digest_size=8).hexdigest() for h in page_links(html or "", self.extension)} - set(start["seen"])
        if not marks:
            return iter([]), {**start, "ended": True}
        return iter([(n, numbered(self.url, n), html)]), {"page": n, "seen": [*start["seen"], *sorted(marks)], "ended": False}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str, str]]:
        """The pages of a batch that is run again; one that no longer answers is left out."""
        for n in range(start["page"] + 1, end["page"] + 1):
            html = self._page(n)
            if html is not None:
                yield n, numbered(self.url, n), html


class ListingReader(DataSourceReader):
    def __init__(self, url: str, pages: int):
        self.url, self.pages = url, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str, str]]:
        page = numbered(self.url, partition.value)
        html = fetched(page)
        if html is not None:
            yield partition.value, page, html


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)


def followed(spark: SparkSession, url: str, folder: str, pages: int = 50, extension: str = ".pdf", spacing: float = SPACING) -> DataFrame:
    """A listing's pages (page_no, url, html) up to its end, stored below folder; a second call asks for what has not been asked for."""
    register(spark)
    stream = spark.readStream.format("listing").option("url", url).option("pages", pages).option("extension", extension).option("spacing", spacing).load()
    query = stream.writeStream.format("parquet").option("path", f"{folder}/pages").option("checkpointLocation", f"{folder}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("page_no int, url string, html string").parquet(f"{folder}/pages")
