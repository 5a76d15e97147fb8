"""Progress lines on the console and in a file."""

from __future__ import annotations

import logging
import sys


def logger(name: str = "erspark", path: str | None = None) -> logging.Logger:
    """A logger with times; with a path it also appends to that file on the driver."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.INFO)
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
        if path:
            handlers.append(logging.FileHandler(path))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%H:%M:%S"))
            log.addHandler(h)
    return log
