"""A log handler that posts structured events, one JSON object per line, to a log server."""

from __future__ import annotations

import json
import logging
import traceback
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

#: Names of levels in events, and the path that takes raw events.
LEVELS = {"CRITICAL": "Fatal", "ERROR": "Error", "WARNING": "Warning", "INFO": "Information", "DEBUG": "Debug", "NOTSET": "Verbose"}
RAW, KIND, KEY = "/api/events/raw?clef", "application/vnd.serilog.clef", "X-Seq-ApiKey"
_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class EventHandler(logging.Handler):
    """Posts each record; send(url, body, headers) replaces the request in tests. A failed post never raises."""

    def __init__(self, url: str, key: str = "", timeout_s: float = 5, send: Callable | None = None):
        super().__init__()
        if not url:
            raise ValueError("a log server is required")
        self.url, self.key, self.timeout_s, self.send = url.rstrip("/") + RAW, key, timeout_s, send or self._post

    def event(self, record: logging.LogRecord) -> dict:
        at = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        told = record.msg if isinstance(record.msg, dict) else {}
        text = told.get("message", "structured log") if told else record.getMessage()
        out = {"@t": at, "@mt": text, "@l": LEVELS.get(record.levelname, record.levelname.title()), "logger": record.name}
        out |= {k: v for k, v in vars(record).items() if k not in _OWN and not k.startswith("_")} | told
        if record.exc_info:
            out["@x"] = "".join(traceback.format_exception(*record.exc_info))
        return out

    def _post(self, url: str, body: bytes, headers: dict) -> None:
        urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=self.timeout_s).close()

    def emit(self, record: logging.LogRecord) -> None:
        try:
            body = (json.dumps(self.event(record), ensure_ascii=False, separators=(",", ":"), default=str) + "\n").encode()
            self.send(self.url, body, {"Content-Type": KIND, **({KEY: self.key} if self.key else {})})
        except Exception:  # noqa: BLE001  logging must not stop the work
            self.handleError(record)


def logger(name: str, **context) -> logging.Logger | logging.LoggerAdapter:
    """The logger of that name, with the context in each of its events."""
    found = logging.getLogger(name)
    return logging.LoggerAdapter(found, context, merge_extra=True) if context else found


def configure(url: str, key: str = "", level: str = "INFO", timeout_s: float = 5) -> None:
    root = logging.getLogger()
    root.handlers[:] = [EventHandler(url, key, timeout_s)]
    root.setLevel(level.upper())
