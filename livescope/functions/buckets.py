"""Log-linear histogram buckets: sixteen to a power of two, exact below 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets stop here; longer calls fall in the last one.
LAST = 1023


def bucket_index(value: Column) -> Column:
    v = F.greatest(value, F.lit(0).cast("long"))
    # length(bin(v)) - 1 is floor(log2 v) exactly, which a logarithm of doubles is not.
    shift = F.length(F.bin(v)) - 5
    high = (shift + 1) * 16 + F.call_function("shiftright", v, shift).bitwiseAND(15)
    return F.least(F.when(v < 32, v).otherwise(high), F.lit(LAST)).cast("int")


def bucket_low(index: Column) -> Column:
    i = index.cast("long")
    shift = (F.floor(i / 16) - 1).cast("int")
    return F.when(i < 32, i).otherwise(F.call_function("shiftleft", i % 16 + 16, shift)).cast("long")


def bucket_high(index: Column) -> Column:
    return bucket_low(index + 1)
