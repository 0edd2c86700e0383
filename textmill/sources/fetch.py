"""Fetching: the protocol, a table of pages as an offline source, and HTTP at the edge of the engine."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.ratelimit import DEFAULT_RATE, EPOCH_FROM, LEAST_RATE, LOW_SHARE, SETS, backoff_s
from textmill.functions.urls import authority
from textmill.plans.protocols import Fetcher

FETCHED = "url string, depth int, status int, headers map<string,array<string>>, body binary, content_type string, fetched_at timestamp, error string"
ATTEMPTS, MAX_BODY = 3, 10 * 1024 * 1024


def retriable(status: int) -> bool:
    """Too many requests, and failures of the server. Other statuses count as answers, and their bodies flow on."""
    return status == 429 or status >= 500


class Pace:
    """When the next request to a host may start. Threads of a task share one; a host is fetched by one task.

    The rate is the explicit one, else that of the newest response headers, else one request in each crawl delay, else
    the default. Retry-After holds back all requests to the host.
    """

    def __init__(self, explicit: float = 0.0, crawl_delay_s: float = 0.0, default: float = DEFAULT_RATE, clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep):
        self.explicit, self.crawl_delay_s, self.default, self.clock, self.wait = explicit, crawl_delay_s, default, clock, wait
        self.header = self.next = 0.0
        self.lock = threading.Lock()

    def rate(self) -> float:
        return self.explicit or self.header or (1 / self.crawl_delay_s if self.crawl_delay_s > 0 else 0) or self.default or DEFAULT_RATE

    def turn(self) -> None:
        """Waits for the next free moment and takes it."""
        with self.lock:
            at = max(self.next, self.clock())
            self.next = at + 1 / self.rate()
        if at > self.clock():
            self.wait(at - self.clock())

    def heard(self, status: int, headers: dict[str, list[str]]) -> None:
        now = self.clock()
        found, limit, retry = rate_of(headers, now)
        with self.lock:
            if found and limit > 0:
                self.header = limit
            if status == 429 and retry > 0:
                self.next = max(self.next, now + retry)


def rate_of(headers: dict[str, list[str]], now: float) -> tuple[bool, float, float]:
    """Whether any rate header is there, the rate that follows (0: none), and the seconds of Retry-After; as functions.ratelimit has them."""
    first = {k.lower(): v[0].strip() for k, v in headers.items() if v}

    def number(text: str | None) -> float | None:
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    retry = 0.0
    if "retry-after" in first:
        text = first["retry-after"]
        try:
            retry = float(int(text)) if re.fullmatch(r"[+-]?\d+", text) else parsedate_to_datetime(text).timestamp() - now
        except (TypeError, ValueError):
            retry = 0.0
    own = next((names for names in SETS if any(n in first for n in names)), None)
    if own is None:
        return "retry-after" in first, 0.0, max(0.0, retry)
    limit, remaining, reset = (number(first.get(n)) for n in own)
    if not limit or limit <= 0:
        return True, 0.0, max(0.0, retry)
    window = 0.0 if reset is None else reset - now if reset > EPOCH_FROM else reset
    rate = (remaining or 0) / window if window > 0 else limit
    return True, max(LEAST_RATE, rate * (0.5 if (remaining or 0) / limit < LOW_SHARE else 1)), max(0.0, retry)


def with_retries(get: Callable[[str], tuple[int, dict, bytes]], url: str, wait: Callable[[float], None] = time.sleep, pace: Pace | None = None) -> tuple[int, dict, bytes]:
    """The answer to the first attempt that isn't retriable; after the last, ValueError. Transport errors aren't retried."""
    for attempt in range(1, ATTEMPTS + 1):
        if pace:
            pace.turn()
        status, headers, body = get(url)
        if pace:
            pace.heard(status, headers)
        if not retriable(status):
            if len(body) > MAX_BODY:
                raise ValueError(f"body of {len(body)} bytes")
            return status, headers, body
        if attempt < ATTEMPTS:
            wait(backoff_s(attempt))
    raise ValueError(f"status {status} after {ATTEMPTS} attempts")


def http_get(user_agent: str, timeout_s: float) -> Callable[[str], tuple[int, dict, bytes]]:
    def get(url: str) -> tuple[int, dict, bytes]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            r = urlopen(Request(url, headers={"User-Agent": user_agent}), timeout=timeout_s)
        except HTTPError as e:
            r = e
        headers: dict[str, list[str]] = {}
        for k, v in r.headers.items():
            headers.setdefault(k.lower(), []).append(v)
        return r.status, headers, r.read(MAX_BODY + 1)

    return get


class HttpFetcher:
    """Fetches on the executors. All URLs of a host go to one task, whose threads share the host's pace; failures become rows with an error."""

    name = "http"

    def __init__(self, rate: float = 0.0, user_agent: str = "textmill/1.0", timeout_s: float = 30.0, get: Callable | None = None, workers: int = 10, crawl_delay_s: float = 0.0):
        self.rate, self.get, self.workers, self.crawl_delay_s = rate, get or http_get(user_agent, timeout_s), workers, crawl_delay_s

    def can_fetch(self, url: str) -> bool:
        return url.startswith(("http://", "https://"))

    def one(self, url: str, depth: int, pace: Pace) -> tuple:
        try:
            status, headers, body = with_retries(self.get, url, pace=pace)
            return url, depth, status, headers, body, (headers.get("content-type") or [""])[0], _now(), None
        except Exception as e:  # a page that fails is a row in the error table, not a failed job
            return url, depth, None, None, None, None, _now(), str(e)

    def fetch(self, frontier: DataFrame) -> DataFrame:
        fetcher = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            paces: dict[str, Pace] = {}
            with ThreadPoolExecutor(fetcher.workers) as pool:
                for b in batches:
                    asked = [(u, d, paces.setdefault(urlsplit(u).netloc.lower(), Pace(fetcher.rate, fetcher.crawl_delay_s))) for u, d in zip(b["url"], b["depth"], strict=True)]
                    for at in range(0, len(asked), 100):  # bounds the bodies in memory
                        rows = list(pool.map(lambda x: fetcher.one(*x), asked[at : at + 100]))
                        yield pd.DataFrame(rows, columns=["url", "depth", "status", "headers", "body", "content_type", "fetched_at", "error"])

        return frontier.select("url", "depth").repartition(authority(F.col("url"))).mapInPandas(run, FETCHED)


def _now() -> pd.Timestamp:
    return pd.Timestamp.now("UTC").tz_localize(None)


class TableFetcher:
    """Answers from a table of pages (url, html), by normal form."""

    name = "table"

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def can_fetch(self, url: str) -> bool:
        return True

    def fetch(self, frontier: DataFrame) -> DataFrame:
        from textmill.functions.urls import normalize_url

        known = self.pages.select(normalize_url(F.col("url")).alias("_n"), F.col("html").cast("binary").alias("body")).dropDuplicates(["_n"])
        asked = frontier.select("url", "depth", normalize_url(F.col("url")).alias("_n"))
        return asked.join(known, "_n", "left").select(
            "url", "depth", F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), F.create_map().cast("map<string,array<string>>").alias("headers"),
            "body", F.lit("text/html; charset=utf-8").alias("content_type"), F.current_timestamp().alias("fetched_at"), F.lit(None).cast("string").alias("error"),
        )


def route(fetchers: list[Fetcher], url: str) -> Fetcher:
    """The first that can; none falls back to another on failure."""
    for f in fetchers:
        if f.can_fetch(url):
            return f
    raise ValueError(f"nothing fetches {url}")


def pages_as_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table in the shape of fetched pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url"), F.lit(0).alias("depth"), F.lit(200).alias("status"), F.col("html").alias("body"))
