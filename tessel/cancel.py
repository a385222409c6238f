"""Stopping work: a token that Spark jobs started under it are cancelled by."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tessel.errors import AbortError


class CancellationToken:
    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"cancel-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        """Interrupts every job that runs under the token, and lets no other begin."""
        self.cancelled = True
        self.spark.interruptTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise AbortError()

    @contextmanager
    def running(self):
        self.check()
        self.spark.addTag(self.tag)
        try:
            yield self
        finally:
            self.spark.removeTag(self.tag)
