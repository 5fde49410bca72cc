"""A polite HTTP client: bounded retries with growing waits, Retry-After, and a least interval between requests."""

from __future__ import annotations

import random
import time
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

RETRIED = {429, 500, 502, 503, 504}


class Client:
    def __init__(self, retries: int = 4, timeout: float = 30.0, interval: float = 1.0, longest: float = 60.0, opener=urlopen, sleep=time.sleep, clock=time.time) -> None:
        self.retries, self.timeout, self.interval, self.longest = retries, timeout, interval, longest
        self.opener, self.sleep, self.clock, self.last = opener, sleep, clock, None

    def wait(self, attempt: int, retry_after: str | None) -> float:
        """Return seconds to wait before another attempt; a server's wish, in seconds or as a date, comes first."""
        if retry_after:
            if retry_after.strip().isdigit():
                return min(self.longest, float(retry_after))
            try:
                return min(self.longest, max(0.0, parsedate_to_datetime(retry_after).timestamp() - self.clock()))
            except (TypeError, ValueError):
                pass
        return min(self.longest, 2.0**attempt * (1 + 0.25 * random.random()))

    def get(self, url: str, data: bytes | None = None, headers: dict[str, str] | None = None) -> bytes:
        for attempt in range(self.retries + 1):
            if self.last is not None:
                self.sleep(max(0.0, self.last + self.interval - self.clock()))
            self.last = self.clock()
            try:
                with self.opener(Request(url, data=data, headers=headers or {}), timeout=self.timeout) as answer:
                    return answer.read()
            except HTTPError as e:
                if e.code not in RETRIED or attempt == self.retries:
                    raise
                self.sleep(self.wait(attempt, e.headers.get("Retry-After") if e.headers and e.code == 429 else None))
            except URLError:
                if attempt == self.retries:
                    raise
                self.sleep(self.wait(attempt, None))
        raise AssertionError("unreachable")
