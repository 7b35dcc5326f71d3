"""The order book of an event: its levels and its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOOK


def top_of_book() -> list[Column]:
    """The columns of level 0; null where an event has no level."""
    level = F.get(F.col("levels"), F.lit(0))
    return [level[c].alias(c) for c in BOOK]


def levels_normalised(events: DataFrame) -> DataFrame:
    """One row for each event and depth."""
    return events.select("rec_id", F.explode("levels").alias("l")).select("rec_id", "l.depth", *(F.col(f"l.{c}") for c in BOOK))


def book_hash(levels: Column) -> Column:
    """SHA-256 in hex over the levels' prices (64 bits each), sizes and counts (32 bits each), all big-endian."""

    def packed(c: Column, digits: int) -> Column:
        return F.right(F.lpad(F.hex(c), F.lit(16), F.lit("0")), F.lit(digits))

    def level(x: Column) -> Column:
        return F.concat(*(packed(x[c], 16 if c.endswith("_px") else 8) for c in BOOK))

    return F.sha2(F.unhex(F.array_join(F.transform(levels, level), "")), 256)
