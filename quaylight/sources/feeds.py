"""Market data derived from general event and order-line tables, so that every query has data of any size to read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.book import book_hash
from ..functions.timeutil import day_of
from ..operators.continuous import write_continuous_map
from ..operators.ingest import prepare
from ..operators.retrieve import Market
from ..scratch import new_path
from .folders import stamp

START = 1_704_067_200 * S.SECOND  #: 2024-01-01
LATEST = (1 << 63) - 1  #: the last instant that a long of nanoseconds tells, in April 2262
_FIRST_EXPIRY, _BETWEEN = START + 8 * S.DAY + 17 * S.HOUR, 9 * S.DAY  #: a root's contracts expire every nine days
TICK = 10_000_000
_ACTIONS = {"purchase": 84, "signup": 65, "click": 67, "view": 77, "error": 82}


def _nanos(ts: str) -> Column:
    """A timestamp without zone as nanoseconds since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) * 1000")


def _level(depth: int) -> Column:
    k, price = F.col("k"), F.col("price")
    away = TICK * depth
    return F.struct(
        F.lit(depth).alias("depth"),
        (price - TICK * (1 + k % 5) - away).alias("bid_px"),
        (1 + k % 10 + depth).cast("long").alias("bid_sz"),
        (1 + k % 4).cast("long").alias("bid_ct"),
        (price + TICK * (1 + k % 3) + away).alias("ask_px"),
        (1 + k % 7 + depth).cast("long").alias("ask_sz"),
        (1 + k % 6).cast("long").alias("ask_ct"),
    )


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures events of two book levels from ``events``; a purchase is a trade."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.create_map(*(F.lit(x) for pair in _ACTIONS.items() for x in pair))[F.col("event_type")]
    base = e.select(
        F.lit("futures").alias("dataset"),
        F.col("event_id").alias("rec_id"),
        F.col("user_id").alias("instrument_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.round(F.col("value") * 100).cast("long") * TICK).alias("price"),
        action.alias("action"),
        _nanos("ts").alias("ts_recv"),
    )
    levels = F.array(_level(0), _level(1))
    return base.select(
        "dataset",
        "rec_id",
        "instrument_id",
        F.col("ts_recv").alias("ts_event"),
        "price",
        (F.col("k") + 1).cast("long").alias("size"),
        "action",
        F.element_at(F.array(F.lit(65), F.lit(66), F.lit(78)), F.col("k") % 3 + 1).alias("side"),
        F.lit(0).alias("flags"),
        "ts_recv",
        F.col("k").alias("ts_in_delta"),
        F.col("rec_id").alias("sequence"),
        F.lit(0).cast("long").alias("discriminator"),
        book_hash(levels).alias("order_book_hash"),
        levels.alias("levels"),
        day_of("ts_recv").alias("day"),
        F.lit("feed").alias("load_id"),
    )


def event_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instrument for each user, in five roots, and the continuous symbols of ranks 0 and 1.

    From user 48,345 on (sf0.1 times 33), contracts expire later than a long of nanoseconds can tell, and bear its last
    instant. No rank depends on it: they are live on all days, and of equal expiries the lower id, which is the earlier contract
    of its root, comes first.
    """
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    root = F.concat(F.expr("char(65 + user_id % 5)"), F.lit("X"))
    slot = F.expr("user_id div 5")
    expiry = F.when(slot <= (LATEST - _FIRST_EXPIRY) // _BETWEEN, _FIRST_EXPIRY + slot * _BETWEEN).otherwise(LATEST)
    raw = users.select(
        F.col("user_id").alias("instrument_id"),
        F.concat(root, F.lpad(slot.cast("string"), 4, "0")).alias("ticker"),
        F.concat(F.lit("Contract "), slot.cast("string")).alias("name"),
        expiry.alias("expiration_date"),
        F.lit(False).alias("is_continuous"),
    )
    symbols = spark.range(20).select(
        (1_000_000 + 10 * F.expr("id div 4") + F.expr("CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 6 END")).cast("long").alias("instrument_id"),
        F.concat(F.expr("char(65 + id div 4)"), F.lit("X."), F.when(F.col("id") % 4 < 2, "c").otherwise("v"), F.lit("."), (F.col("id") % 2).cast("string")).alias("ticker"),
        F.lit("Continuous").alias("name"),
        F.lit(0).cast("long").alias("expiration_date"),
        F.lit(True).alias("is_continuous"),
    )
    return raw.unionByName(symbols).select(
        F.lit("futures").alias("dataset"),
        "instrument_id",
        "ticker",
        "name",
        F.when(F.col("instrument_id") % 2 == 0, "north").otherwise("south").alias("vendor"),
        F.lit(1).cast("long").alias("vendor_data"),
        F.lit(START + 30 * S.DAY).alias("last_available"),
        F.lit(START).alias("first_available"),
        "expiration_date",
        "is_continuous",
        (F.col("instrument_id") % 7 != 0).alias("active"),
    )


def _store_map(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "continuous-map")
    write_continuous_map(event_feed(spark, sf_dir), event_instruments(spark, sf_dir), path)
    return path


def stored_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous map, written anew as a store keeps it and read again."""
    return spark.read.schema(S.CONTINUOUS_MAP).parquet(_store_map(spark, sf_dir))


#: The stored map of each application and folder, and the events' files that it was made of: built by the first query that
#: asks, deleted when the driver ends.
_MAPS: dict[tuple[str, str], tuple[tuple, str]] = {}


def market(spark: SparkSession, sf_dir: str, continuous: bool = False) -> Market:
    """The feed's tables; continuous symbols go by the folder's stored map, which stays as it is until the events' files change,
    and is then built anew (``stored_map`` always builds another; a store's map is refreshed by ``mapstore``)."""
    known = None
    if continuous:
        key = (spark.sparkContext.applicationId, sf_dir)
        files = stamp(spark, f"{sf_dir}/events.parquet")
        if _MAPS.get(key, ((), ""))[0] != files:
            _MAPS[key] = files, _store_map(spark, sf_dir)
        known = spark.read.schema(S.CONTINUOUS_MAP).parquet(_MAPS[key][1])
    return Market(event_feed(spark, sf_dir), event_instruments(spark, sf_dir), known)


def line_feed(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, also: Iterable[str] = ()) -> DataFrame:
    """Trades of equities from ``lineitem``, or some ``lines`` of it, as raw records: the supplier is the instrument, seconds are
    spread over the ship day. The order key, line number and part make up sequence, discriminator and flags. Columns of the
    lines in ``also`` are kept."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet") if lines is None else lines
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long") * TICK
    at = _nanos("l_shipdate") + ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400) * S.SECOND
    base = li.select(price.alias("price"), at.alias("t"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *also)
    one = F.struct(
        F.lit(0).alias("depth"),
        (F.col("price") - TICK).alias("bid_px"),
        F.lit(1).cast("long").alias("bid_sz"),
        F.lit(1).cast("long").alias("bid_ct"),
        (F.col("price") + TICK).alias("ask_px"),
        F.lit(1).cast("long").alias("ask_sz"),
        F.lit(1).cast("long").alias("ask_ct"),
    )
    return base.select(
        F.lit("mbp-1").alias("rtype"),
        F.lit("equities").alias("dataset"),
        F.col("l_suppkey").alias("instrument_id"),
        F.col("t").alias("ts_event"),
        "price",
        F.col("l_quantity").cast("long").alias("size"),
        F.lit(S.TRADE).alias("action"),
        F.lit(65).alias("side"),
        F.lit(0).alias("flags"),
        F.col("t").alias("ts_recv"),
        F.lit(0).alias("ts_in_delta"),
        F.col("l_orderkey").alias("sequence"),
        F.col("l_linenumber").cast("long").alias("discriminator"),
        F.array(one).alias("levels"),
        "l_partkey",
        *also,
    )


def equities(spark: SparkSession, sf_dir: str) -> Market:
    """Equities: events from order lines, instruments from suppliers. Arrival must not depend on how the table was read, so
    the line's own columns make up rec_id: order, line, quantity and price, below 2^63 for orders below 2^30."""
    rec_id = ((F.col("sequence") * 8 + F.col("discriminator")) * 64 + F.col("size")) * (1 << 24) + F.expr(f"price div {TICK}")
    events = prepare(line_feed(spark, sf_dir), "lines", 0).withColumn("rec_id", rec_id)
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("equities").alias("dataset"), F.col("s_suppkey").alias("instrument_id"), F.col("s_name").alias("ticker"))
    return Market(events, known)


def options(spark: SparkSession, sf_dir: str) -> Market:
    """Options: an event for each order of a customer, received up to four seconds late; open orders are no trades."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = o.select("o_orderkey", "o_custkey", "o_orderstatus", (F.round(F.col("o_totalprice") * 100).cast("long") * TICK).alias("price"), (_nanos("o_orderdate") + F.col("o_orderkey") * 7919 % 86400 * S.SECOND).alias("t"))
    one = F.struct(
        F.lit(0).alias("depth"),
        (F.col("price") - TICK).alias("bid_px"),
        (1 + F.col("o_orderkey") % 9).alias("bid_sz"),
        F.lit(1).cast("long").alias("bid_ct"),
        (F.col("price") + TICK).alias("ask_px"),
        (1 + F.col("o_orderkey") % 8).alias("ask_sz"),
        F.lit(2).cast("long").alias("ask_ct"),
    )
    raw = base.select(
        F.lit("mbp-1").alias("rtype"),
        F.lit("option").alias("dataset"),
        F.col("o_custkey").alias("instrument_id"),
        F.col("t").alias("ts_event"),
        "price",
        (1 + F.col("o_orderkey") % 7).alias("size"),
        F.when(F.col("o_orderstatus") == "O", 65).otherwise(S.TRADE).alias("action"),
        F.lit(78).alias("side"),
        F.lit(0).alias("flags"),
        (F.col("t") + F.col("o_orderkey") % 5 * S.SECOND).alias("ts_recv"),
        F.lit(7).alias("ts_in_delta"),
        F.col("o_orderkey").alias("sequence"),
        F.lit(0).cast("long").alias("discriminator"),
        F.array(one).alias("levels"),
    )
    events = prepare(raw, "orders", 0).withColumn("rec_id", F.col("sequence"))
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("option").alias("dataset"), F.col("c_custkey").alias("instrument_id"), F.col("c_name").alias("ticker"))
    return Market(events, known)
