"""Remote sources behind a rate limiter, as a Python data source; off unless a fetch function is named."""

from __future__ import annotations

import importlib
import random
import threading
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Requests a second and burst by kind of source, for a whole job.
LIMITS = {"filings": (10.0, 1), "prices": (50.0, 100), "news": (50.0, 100)}


#: Seconds to hold off after a refusal: at first, and at most.
HOLD, HOLD_TOP = 5.0, 300.0
#: What the message of a refusal says.
REFUSED = ("429", "rate limit", "too many requests")


class TooManyRequests(Exception):
    """A source refused; ``retry_after`` are the seconds it asks to be left alone, if it says so."""

    def __init__(self, message: str = "too many requests", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def status_of(error: BaseException) -> int | None:
    """The HTTP status an error carries, itself or in its response."""
    for holder in (error, getattr(error, "response", None)):
        for name in ("status_code", "status", "code"):
            if isinstance(found := getattr(holder, name, None), int):
                return found
    return None


def is_refusal(error: BaseException) -> bool:
    """Whether the source asks for fewer requests, by its status or its message."""
    return isinstance(error, TooManyRequests) or status_of(error) == 429 or any(x in str(error).lower() for x in REFUSED)


def is_passing(error: BaseException) -> bool:
    """Whether a later try may succeed: refusals, lost connections, time-outs, faults of the server."""
    status = status_of(error)
    if is_refusal(error) or (status is not None and 500 <= status < 600):
        return True
    return status is None and isinstance(error, (ConnectionError, TimeoutError, OSError))


def asked_pause(error: BaseException) -> float | None:
    """The pause a refusal asks for, from itself or from the Retry-After of its response."""
    if (own := getattr(error, "retry_after", None)) is not None:
        return float(own)
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        return float(headers.get("Retry-After", headers.get("retry-after")))
    except (TypeError, ValueError):
        return None


class TokenBucket:
    """At most ``rate`` permits a second, ``burst`` of them at once; none while it holds off after a refusal."""

    def __init__(self, rate: float, burst: int, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at, self.lock = float(burst), clock(), threading.Lock()
        self.until, self.hold = float("-inf"), HOLD

    def _pause(self) -> float:
        """Seconds until a permit may be had; 0 takes it."""
        now = self.clock()
        if now < self.until - 1e-9:
            return self.until - now
        if self.until > float("-inf"):
            self.until, self.hold, self.at = float("-inf"), HOLD, max(self.at, self.until)
        self.tokens = min(float(self.burst), self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1 - 1e-9:
            return (1 - self.tokens) / self.rate
        self.tokens -= 1
        return 0.0

    def take(self, timeout: float | None = None) -> float | None:
        """Wait for a permit: the seconds waited, or None if there is none within ``timeout`` seconds."""
        waited = 0.0
        while True:
            with self.lock:
                pause = self._pause()
            if not pause:
                return waited
            if timeout is not None and waited + pause > timeout:
                return None
            self.sleep(pause)
            waited += pause

    def slow_down(self, retry_after: float | None = None) -> None:
        """Hold off: as long as the source asks for, else for HOLD seconds, twice as long if it refuses again meanwhile."""
        with self.lock:
            now = self.clock()
            if retry_after is None and now < self.until:
                self.hold = min(self.hold * 2, HOLD_TOP)
            self.until = now + (self.hold if retry_after is None else retry_after)

    def succeeded(self) -> None:
        self.hold = HOLD


class HostLimiter:
    """Requests to one host lie at least ``base`` ± ``jitter`` seconds apart; hosts don't wait for each other."""

    def __init__(self, base: float = 7.0, jitter: float = 3.0, clock=time.monotonic, sleep=time.sleep, draw=random.random):
        self.base, self.jitter, self.clock, self.sleep, self.draw = base, jitter, clock, sleep, draw
        self.next: dict[str, float] = {}
        self.lock = threading.Lock()

    @staticmethod
    def host(url: str) -> str:
        parts = urlsplit(url)
        return (parts.netloc or parts.path.split("/")[0]).lower()

    def take(self, url: str) -> float:
        """Wait for the turn of the URL's host; the seconds waited."""
        with self.lock:
            now, host = self.clock(), self.host(url)
            turn = max(now, self.next.get(host, now))
            self.next[host] = turn + max(0.0, self.base + (2 * self.draw() - 1) * self.jitter)
        if turn > now:
            self.sleep(turn - now)
        return turn - now


def with_retries(call, tries: int = 3, first: float = 0.5, top: float = 60.0, sleep=time.sleep, jitter=random.random, bucket: TokenBucket | None = None):
    """The result of ``call``; after a failure that may pass it waits twice as long each time, with jitter.

    With a ``bucket`` every try takes a permit, and a refusal makes the bucket hold off.  Other errors are raised
    at once."""
    for attempt in range(tries):
        if bucket is not None:
            bucket.take()
        try:
            result = call()
        except Exception as error:
            if bucket is not None and is_refusal(error):
                bucket.slow_down(asked_pause(error))
            if attempt == tries - 1 or not is_passing(error):
                raise
            sleep(min(top, first * 2**attempt) * (1 + jitter() / 2))
        else:
            if bucket is not None:
                bucket.succeeded()
            return result


class KeyPartition(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(keys)
        self.keys = keys


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.options, self.schema = options, schema
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.parts = max(1, min(int(options.get("partitions", "1")), len(self.keys) or 1))

    def partitions(self) -> list[InputPartition]:
        return [KeyPartition(self.keys[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: KeyPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        rate, burst = LIMITS[self.options.get("kind", "prices")]
        # The limit is the job's: every partition gets its share of it.
        bucket = TokenBucket(rate / self.parts, max(1, burst // self.parts))
        hosts = HostLimiter(float(self.options["host_delay"]), float(self.options.get("host_jitter", 0))) if "host_delay" in self.options else None
        for key in partition.keys:
            if hosts is not None:
                hosts.take(key)
            yield from with_retries(lambda k=key: list(fetch(k, self.options)), bucket=bucket)


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(…).option("fetch", "module:function").option("keys", "A,B")``:
    rows that a function gives for each key.  With ``host_delay`` (seconds) the keys are addresses, and each
    task leaves that much between requests to one host."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)
