"""Digests that stand for long keys in joins and indexes.

Two 64-bit hashes of the same columns, chained from different starts, make 128
bits: two of 10**12 different keys agree with a probability of about 10**-15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEDUP_KEY, MONEY

DIGEST = ["key_hi", "key_lo"]


def digest(*columns: Column) -> list[Column]:
    """``key_hi`` and ``key_lo`` of the columns."""
    return [F.xxhash64(F.lit(start), *columns).alias(name) for start, name in zip(("hi", "lo"), DIGEST)]


def line_key() -> list[Column]:
    """Digest of a shipment line's six-column key, whatever the width of its
    money and the sign of its zeros."""
    cells = {"fob_value": F.col("fob_value").cast(MONEY), "quantity": F.col("quantity") + F.lit(0.0)}
    return digest(*(cells.get(c, F.col(c)) for c in DEDUP_KEY))


def whole_key() -> Column:
    """Lines that can be duplicates: none of the key columns is NULL."""
    out = F.lit(True)
    for c in DEDUP_KEY:
        out = out & F.col(c).isNotNull()
    return out
