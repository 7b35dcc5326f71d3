"""Records of symbols in a time range, in any of nine schemas, for raw and continuous symbols."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.book import top_of_book
from ..functions.timeutil import bucket_end, bucket_start, time_range

#: A symbol list of at most so many tickers selects a dimension small enough to broadcast.
BROADCAST_SYMBOLS = 50_000


@dataclass(frozen=True)
class Market:
    """The tables that queries read; ``continuous_map`` only for continuous symbols."""

    mbp: DataFrame
    instruments: DataFrame
    continuous_map: DataFrame | None = None


@dataclass(frozen=True)
class RetrieveParams:
    """``symbols``: tickers, or None for all of the data set. Times are [start_ts, end_ts), but raw bars and
    snapshots include events at end_ts."""

    symbols: Sequence[str] | None
    start_ts: int
    end_ts: int
    schema: str
    dataset: str = "futures"
    stype: str = "raw"


def chosen(df: DataFrame, column: str, symbols: Sequence[str] | None) -> DataFrame:
    """Rows of the symbols; broadcast if the list bounds them."""
    if symbols is None:
        return df
    kept = df.where(F.col(column).isin(list(symbols)))
    return F.broadcast(kept) if len(symbols) <= BROADCAST_SYMBOLS else kept


def record(df: DataFrame, kind) -> DataFrame:
    """Cast to a record type, in its column order."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields))


def order_key() -> Column:
    """Arrival order, also among equal times, as one number: below 2^126, so it fits a decimal. Unlike a struct it has
    a fixed width, so that aggregations by it are by hash and need no sort."""
    return F.expr("CAST(ts_recv AS DECIMAL(19,0)) * 9223372036854775808BD + rec_id")


def raw_events(market: Market, p: RetrieveParams, end: int, trades_only: bool) -> DataFrame:
    """Events of raw symbols with start <= ts_recv <= end."""
    events = time_range(market.mbp.where(F.col("dataset") == p.dataset), p.start_ts, end)
    if trades_only:
        events = events.where(F.col("action") == S.TRADE)
    known = market.instruments.where(F.col("dataset") == p.dataset).select("instrument_id", "ticker")
    wanted = chosen(known, "ticker", p.symbols).select("instrument_id")
    return events.join(wanted, "instrument_id", "left_semi").withColumn("rollover_flag", F.lit(0))


def bars(events: DataFrame, interval: int) -> DataFrame:
    """Open, close, low, high and volume for each instrument and bucket; sums and extremes combine before the shuffle."""
    keyed = events.withColumn("arrival", order_key())
    return keyed.groupBy("instrument_id", bucket_start("ts_recv", interval).alias("ts_event")).agg(
        F.min_by("price", "arrival").alias("open"),
        F.max_by("price", "arrival").alias("close"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.sum("size").alias("volume"),
        F.max("rollover_flag").alias("rollover_flag"),
    )


def snapshots(events: DataFrame, interval: int) -> DataFrame:
    """The last book of each right-closed bucket, stamped with its end; buckets without events are absent."""
    keyed = events.select("instrument_id", bucket_end("ts_recv", interval).alias("ts_event"), "rollover_flag", *top_of_book(), order_key().alias("arrival"))
    last = [F.max_by(c, "arrival").alias(c) for c in S.BOOK]
    return keyed.groupBy("instrument_id", "ts_event").agg(F.max("rollover_flag").alias("rollover_flag"), *last)


def event_records(events: DataFrame, kind, time: str = "ts_recv") -> DataFrame:
    """Events as records in order of time and arrival, with the top of the book if the record has it."""
    full = events.withColumn("depth", F.lit(0))
    if "bid_px" in kind.names:
        full = full.select("*", *top_of_book())
    return record(full.orderBy(time, "rec_id"), kind)


def retrieve(market: Market, p: RetrieveParams) -> DataFrame:
    """The records that ``p`` asks for, in order of time."""
    if p.schema not in S.SCHEMAS:
        raise ValueError(f"unknown schema {p.schema}")
    if p.dataset not in S.DATASET_CODES:
        raise ValueError(f"unknown data set {p.dataset}")
    if p.stype not in ("raw", "continuous"):
        raise ValueError(f"unknown symbol type {p.stype}")
    code = S.SCHEMAS[p.schema]
    trades_only = code.record in ("tbbo", "trade", "ohlcv")
    if p.stype == "continuous" and p.dataset == "futures":
        from .continuous import continuous_events

        events = continuous_events(market, p, trades_only)
        inside = F.col("ts_recv").between(p.start_ts, p.end_ts - 1)
    else:
        events = raw_events(market, p, p.end_ts if code.interval else p.end_ts - 1, trades_only)
        inside = F.lit(True)
    if code.interval is None:
        if code.record == "trade":  # those of equities and options come by the time of the event
            return event_records(events.where(inside), S.TRADE_RECORD, "ts_recv" if p.dataset == "futures" else "ts_event")
        return event_records(events.where(inside), S.MBP1_RECORD)
    done = bars(events, code.interval) if code.record == "ohlcv" else snapshots(events, code.interval)
    if p.stype == "continuous" and p.dataset == "futures":
        done = done.where(F.col("ts_event").between(p.start_ts, p.end_ts - 1))
    return record(done, S.OHLCV_RECORD if code.record == "ohlcv" else S.BBO_RECORD).orderBy("ts_event", "instrument_id")


def symbols(instruments: DataFrame, dataset: str, tickers: Sequence[str] | None) -> DataFrame:
    """(instrument_id, ticker) of the tickers that exist; others are silently absent."""
    return chosen(instruments.where(F.col("dataset") == dataset), "ticker", tickers).select("instrument_id", "ticker")


def symbol_map(instruments: DataFrame, dataset: str, tickers: Sequence[str] | None) -> DataFrame:
    """``symbols`` as one row with a map, as part of a result's metadata; it takes the memory of its tickers, so use
    ``symbols`` where there is no list of them."""
    pairs = F.sort_array(F.collect_list(F.struct("instrument_id", "ticker")))
    return symbols(instruments, dataset, tickers).agg(F.map_from_entries(pairs).alias("mappings"))


def metadata(market: Market, p: RetrieveParams) -> DataFrame:
    """One row about the result: schema, data set, times and symbol map; also if there are no records."""
    return symbol_map(market.instruments, p.dataset, p.symbols).select(
        F.lit(p.schema).alias("schema"), F.lit(p.dataset).alias("dataset"), F.lit(p.start_ts).cast("long").alias("start"), F.lit(p.end_ts).cast("long").alias("end"), "mappings"
    )


def write_result(result: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """The result as Parquet files of bounded size, in its order."""
    result.write.option("maxRecordsPerFile", records_per_file).mode("overwrite").parquet(path)
