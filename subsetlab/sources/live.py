"""A source behind a page that calls back: a key in the page, a session object, then pages of results by POST."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from subsetlab.sources.archive import paged
from subsetlab.sources.http import Client

log = logging.getLogger("subsetlab.sources")


@dataclass
class CallbackSource:
    """Where pages come from. ``key_pattern`` finds the key (its first group) in the page at ``page_path``; without it ``default_key`` is used.

    ``body`` gives a request's body from (session, key, page index); ``rows`` finds (draw_id, draw_date) in a stored page.
    """

    base: str
    page_path: str
    session_path: str
    result_path: str
    key_pattern: str
    default_key: str
    session_request: dict
    session_method: str
    result_method: str
    body: Callable[[object, str, int], dict]
    rows: Callable[[str], list[dict]]
    client: Client = field(default_factory=Client)
    method_header: str = "X-AjaxPro-Method"
    most: int = 2000
    _session: object = None
    _key: str | None = None

    def key(self) -> str:
        """Return the key that the page names; whatever goes wrong, the default one."""
        if self._key is None:
            try:
                found = re.search(self.key_pattern, self.client.get(self.base + self.page_path).decode("utf-8", "replace"))
            except OSError as e:
                log.warning("no page to find the key in", extra={"error": str(e)})
                found = None
            if found is None:
                log.warning("key not found; the default one is used")
            self._key = found[1] if found else self.default_key
        return self._key

    def call(self, path: str, method: str, body: dict) -> str:
        headers = {self.method_header: method, "Content-Type": "text/plain; charset=utf-8", "Referer": self.base + self.page_path}
        return self.client.get(self.base + path, json.dumps(body).encode(), headers).decode()

    def session(self) -> object:
        if self._session is None:
            answer = self.call(self.session_path, self.session_method, self.session_request)
            try:
                self._session = json.loads(answer)["value"]
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"no session in {answer[:200]!r}") from e
        return self._session

    def page(self, index: int) -> tuple[str, list[dict]]:
        content = self.call(self.result_path, self.result_method, self.body(self.session(), self.key(), index))
        return content, self.rows(content)

    def fetch(self, last: str | None, oldest: str | None = None) -> Iterable[tuple[int, str]]:
        """Yield (index, content), newest first, up to the page that holds ``last`` or is older than ``oldest``: what an ingestion takes."""
        for index, content, _ in paged(self.page, stop_at=last, oldest=oldest, most=self.most):
            yield index, content
