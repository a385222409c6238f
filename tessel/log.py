"""Where messages go: a logger of one's own, or none."""

from __future__ import annotations

import logging
import time as clock

_logger: logging.Logger | None = None
_begun: dict[str, float] = {}


def set_logger(logger: logging.Logger | None) -> None:
    global _logger
    _logger = logger


def _say(level: int, *parts: object) -> None:
    if _logger is not None:
        _logger.log(level, " ".join(map(str, parts)))


def debug(*parts: object) -> None:
    _say(logging.DEBUG, *parts)


def info(*parts: object) -> None:
    _say(logging.INFO, *parts)


log = info


def warn(*parts: object) -> None:
    _say(logging.WARNING, *parts)


def error(*parts: object) -> None:
    _say(logging.ERROR, *parts)


def time(label: str) -> None:
    _begun[label] = clock.perf_counter()


def time_end(label: str) -> None:
    if label in _begun:
        info(f"{label}: {(clock.perf_counter() - _begun.pop(label)) * 1000:.3f} ms")
