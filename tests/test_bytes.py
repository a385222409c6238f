from __future__ import annotations

import logging
import struct

import pytest
from pyspark.sql import functions as F

from tessel import log
from tessel.cancel import CancellationToken
from tessel.errors import AbortError, AggregateError, RasterError
from tessel.functions.binary import CODES, Slice, View, signed, unsigned


def test_views():
    for kind, code in CODES.items():
        for little in (True, False):
            raw = b"\0" + struct.pack(("<" if little else ">") + code, 1.5 if kind.startswith("float") else 77)
            assert View(raw).get(kind, 1, little) == (1.5 if kind.startswith("float") else 77)
    with pytest.raises(RasterError, match="Offset is outside the bounds of the DataView"):
        View(b"abc").get("uint32", 0)
    part = Slice(struct.pack("<IQ", 5, 2**63), 100, True, False)
    assert part.read_offset(100) == 5 and part.read("uint64", 104) == 2**63 and part.covers(104, 8) and not part.covers(105, 8) and part.top == 112


def test_columns(spark):
    raw = struct.pack(">HiQ", 65535, -5, 2**64 - 1) + struct.pack("<i", -7)
    row = spark.createDataFrame([(bytearray(raw),)], "d binary").select(unsigned(F.col("d"), 0, 2).alias("a"), signed(F.col("d"), 2, 4).alias("b"), unsigned(F.col("d"), 6, 8).alias("c"), signed(F.col("d"), 14, 4, True).alias("e"), unsigned(F.col("d"), 16, 4).alias("f")).first()
    assert (int(row["a"]), row["b"], int(row["c"]), row["e"], row["f"]) == (65535, -5, 2**64 - 1, -7, None)


def test_tokens_and_logs(spark, caplog):
    token = CancellationToken(spark)
    with token.running():
        assert spark.range(3).count() == 3
    token.cancel()
    with pytest.raises(AbortError), token.running():
        pass
    assert AggregateError([ValueError("x")]).errors[0].args == ("x",)
    log.set_logger(logging.getLogger("raster"))
    with caplog.at_level(logging.INFO, "raster"):
        log.time("t")
        log.time_end("t")
        log.warn("careful", 1)
    log.set_logger(None)
    log.error("nobody hears")
    assert [r.getMessage()[:2] for r in caplog.records] == ["t:", "ca"]
