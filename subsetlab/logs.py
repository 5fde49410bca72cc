"""Logging as one JSON object a line."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

#: What every record has anyway.
KNOWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """Write time, level, logger and message of a record, what was added to it, and its exception."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "event": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in KNOWN}
        if record.exc_info:
            line["exc"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def configure(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """Let the package's logger write JSON lines to standard error, and to ``path`` as well."""
    logger = logging.getLogger("subsetlab")
    logger.handlers.clear()
    logger.setLevel(level)
    logger.propagate = False
    for handler in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
    return logger
