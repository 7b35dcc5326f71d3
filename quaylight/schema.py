"""Types of the market-data tables, schema codes and intervals.

Times are nanoseconds since 1970 and prices fixed-point, both as longs: Spark's timestamps would lose the
nanoseconds and doubles the exactness.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND

TRADE = 84  #: the code of a trade in ``action``
DATASET_CODES = {"futures": 1, "equities": 2, "option": 3}


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
}


def columns(spec: str, **more: T.DataType) -> T.StructType:
    """"name type, name type" as a type, without a session; ``more`` names further types."""
    kinds = _TYPES | more
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(","))])


LEVEL = columns("depth int, bid_px bigint, bid_sz bigint, bid_ct bigint, ask_px bigint, ask_sz bigint, ask_ct bigint")
LEVELS = T.ArrayType(LEVEL)
BOOK = ["bid_px", "ask_px", "bid_sz", "ask_sz", "bid_ct", "ask_ct"]

INSTRUMENTS = columns(
    "dataset string, instrument_id bigint, ticker string, name string, vendor string, vendor_data bigint, last_available bigint,"
    " first_available bigint, expiration_date bigint, is_continuous boolean, active boolean"
)
#: A record as it arrives: ``rtype`` names the kind of record.
RAW = columns(
    "rtype string, dataset string, instrument_id bigint, ts_event bigint, price bigint, size bigint, action int, side int, flags int,"
    " ts_recv bigint, ts_in_delta int, sequence bigint, discriminator bigint, levels levels",
    levels=LEVELS,
)
MBP = columns(
    "dataset string, rec_id bigint, instrument_id bigint, ts_event bigint, price bigint, size bigint, action int, side int, flags int,"
    " ts_recv bigint, ts_in_delta int, sequence bigint, discriminator bigint, order_book_hash string, levels levels, day bigint, load_id string",
    levels=LEVELS,
)
CONTINUOUS_MAP = columns("ts_day bigint, continuous_ticker string, instrument_id bigint, continuous_instrument_id bigint, rollover_flag int")

#: What makes two events the same event.
EVENT_KEY = ["instrument_id", "ts_event", "price", "size", "flags", "sequence", "order_book_hash", "ts_recv", "action", "side", "discriminator"]

_EVENT = "instrument_id bigint, ts_event bigint, rollover_flag int, price bigint, size bigint, action int, side int, flags int, depth int, ts_recv bigint, ts_in_delta int, sequence bigint"
_SIDES = "bid_px bigint, ask_px bigint, bid_sz bigint, ask_sz bigint, bid_ct bigint, ask_ct bigint"
MBP1_RECORD = columns(f"{_EVENT}, discriminator bigint, {_SIDES}")
TRADE_RECORD = columns(_EVENT)
BBO_RECORD = columns(f"instrument_id bigint, ts_event bigint, rollover_flag int, {_SIDES}")
OHLCV_RECORD = columns("instrument_id bigint, ts_event bigint, rollover_flag int, open bigint, close bigint, low bigint, high bigint, volume bigint")


@dataclass(frozen=True)
class SchemaCode:
    record: str
    interval: int | None = None


SCHEMAS = {
    "mbp-1": SchemaCode("mbp1"),
    "tbbo": SchemaCode("tbbo"),
    "trades": SchemaCode("trade"),
    "ohlcv-1s": SchemaCode("ohlcv", SECOND),
    "ohlcv-1m": SchemaCode("ohlcv", MINUTE),
    "ohlcv-1h": SchemaCode("ohlcv", HOUR),
    "ohlcv-1d": SchemaCode("ohlcv", DAY),
    "bbo-1s": SchemaCode("bbo", SECOND),
    "bbo-1m": SchemaCode("bbo", MINUTE),
}
