"""Errors, with the texts that users of raster readers know."""

from __future__ import annotations

from collections.abc import Sequence


class RasterError(ValueError):
    """Anything wrong with a file, an option or a request."""


class ImageIndexError(RasterError):
    def __init__(self, index: int):
        super().__init__(f"No image at index {index}")
        self.index = index


class AbortError(Exception):
    def __init__(self, message: str = "Request was aborted", signal: object = None):
        super().__init__(message)
        self.signal = signal


class AggregateError(Exception):
    def __init__(self, errors: Sequence[Exception], message: str = ""):
        super().__init__(message or "; ".join(map(str, errors)))
        self.errors = list(errors)
