"""Continuous futures: which contract a continuous symbol means on which day, and events through that map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.timeutil import day_of, floor_day, time_range
from .retrieve import Market, RetrieveParams, order_key


def active_days(mbp: DataFrame) -> DataFrame:
    """Days with futures events; reads the partition value only."""
    return mbp.where("dataset = 'futures'").select((F.col("day") * S.DAY).alias("ts_day")).distinct()


def _futures(instruments: DataFrame) -> DataFrame:
    return instruments.where("dataset = 'futures'")


def _lookup(instruments: DataFrame) -> DataFrame:
    return _futures(instruments).select(F.col("ticker").alias("continuous_ticker"), F.col("instrument_id").alias("continuous_instrument_id"))


def with_rollover(mapped: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Flag the days on which a continuous symbol's contract differs from its row before; the first has none. ``before``:
    each symbol's last row of an earlier map, if there is one."""
    named = mapped.withColumn("_new", F.lit(True))
    if before is not None:
        old = before.select("ts_day", "continuous_ticker", "instrument_id", F.lit(False).alias("_new"))
        named = named.unionByName(old, allowMissingColumns=True)
    last = F.lag("instrument_id").over(Window.partitionBy("continuous_ticker").orderBy("ts_day"))
    flag = F.when(last.isNotNull() & ~last.eqNullSafe(F.col("instrument_id")), 1).otherwise(0)
    return named.withColumn("rollover_flag", flag).where("_new").select(*S.CONTINUOUS_MAP.names)


#: The first of a root's contracts, in order of expiry, that is not over on the day; 31 halvings serve any array.
_FIRST_LIVE = """
  aggregate(
    sequence(1, 31), named_struct('lo', 0, 'hi', size(contracts)),
    (a, i) -> if(a.lo >= a.hi, a,
      if(contracts[shiftright(a.lo + a.hi, 1)].expiration_date < ts_day,
         named_struct('lo', shiftright(a.lo + a.hi, 1) + 1, 'hi', a.hi),
         named_struct('lo', a.lo, 'hi', shiftright(a.lo + a.hi, 1)))),
    a -> a.lo)
"""


def calendar_ranks_of(days: DataFrame, instruments: DataFrame, root_len: int = 2, ranks: int | None = None) -> DataFrame:
    """Contracts that have not expired, for each of ``days`` (ts_day) and root, by nearness of expiry from 0; only the
    nearest ``ranks`` of them if a number is given.

    A root's contracts are one array in order of expiry (some 16 bytes a contract), so a day's live ones are the end of
    it, from a place that binary search finds, and their ranks are their places. Days and contracts are never joined or
    sorted against each other: what is made is what is returned.
    """
    contracts = _futures(instruments).where("is_continuous = false AND expiration_date IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("expiration_date", "instrument_id"))).alias("contracts")
    roots = contracts.groupBy(F.left("ticker", F.lit(root_len)).alias("root")).agg(ordered)
    calendar = days.agg(F.array_sort(F.collect_set("ts_day"))).scalar()
    dated = roots.select("root", "contracts", F.explode(calendar).alias("ts_day")).withColumn("first", F.expr(_FIRST_LIVE))
    live = F.slice("contracts", F.col("first") + 1, F.size("contracts") if ranks is None else F.lit(ranks))
    return dated.select("ts_day", "root", F.posexplode(live).alias("rank", "c")).select("ts_day", "root", "c.instrument_id", "rank")


def calendar_ranks(mbp: DataFrame, instruments: DataFrame, root_len: int = 2, ranks: int | None = None) -> DataFrame:
    """``calendar_ranks_of`` for all days with events."""
    return calendar_ranks_of(active_days(mbp), instruments, root_len, ranks)


def daily_volume(mbp: DataFrame) -> DataFrame:
    """Traded size for each instrument and day; null on days with events but no trade."""
    return (
        mbp.where("dataset = 'futures'")
        .groupBy("instrument_id", (F.col("day") * S.DAY).alias("ts_event"))
        .agg(F.sum(F.when(F.col("action") == S.TRADE, F.col("size"))).alias("daily_volume"))
    )


def volume_ranks_of(volumes: DataFrame, instruments: DataFrame, wanted: Column, root_len: int = 2) -> DataFrame:
    """Contracts of each ``wanted`` day and root by the volume of their last row before the day, then of the row before
    that, then expiry. ``volumes`` (instrument_id, ts_event, daily_volume) has these rows too."""
    known = _futures(instruments).select("instrument_id", "ticker", "expiration_date")
    met = volumes.join(known, "instrument_id")
    by_contract = Window.partitionBy("instrument_id").orderBy("ts_event")
    lagged = met.withColumn("prev", F.lag("daily_volume").over(by_contract)).withColumn("prev2", F.lag("daily_volume", 2).over(by_contract))
    root = F.left("ticker", F.lit(root_len))
    order = [F.desc_nulls_last("prev"), F.desc_nulls_last("prev2"), F.asc_nulls_last("expiration_date"), F.asc("instrument_id")]
    rank = F.row_number().over(Window.partitionBy(root, "ts_event").orderBy(*order)) - 1
    return lagged.where(wanted).select(F.col("ts_event").alias("ts_day"), root.alias("root"), "instrument_id", rank.alias("rank"))


def volume_ranks(mbp: DataFrame, instruments: DataFrame, root_len: int = 2) -> DataFrame:
    """``volume_ranks_of`` for all days but the first, which has no rank."""
    return volume_ranks_of(daily_volume(mbp), instruments, F.col("ts_event") > active_days(mbp).agg(F.min("ts_day")).scalar(), root_len)


def calendar_symbols(ranked: DataFrame, instruments: DataFrame) -> DataFrame:
    """root.c.rank; symbols that are no instrument have a null id."""
    named = ranked.withColumn("continuous_ticker", F.concat("root", F.lit(".c."), F.col("rank").cast("string")))
    return named.join(_lookup(instruments.where("is_continuous = true")), "continuous_ticker", "left")


def volume_symbols(ranked: DataFrame, instruments: DataFrame) -> DataFrame:
    """root.v.rank; only symbols that are instruments."""
    named = ranked.withColumn("continuous_ticker", F.concat("root", F.lit(".v."), F.col("rank").cast("string")))
    return named.join(_lookup(instruments), "continuous_ticker")


def calendar_map(mbp: DataFrame, instruments: DataFrame, root_len: int = 2) -> DataFrame:
    return with_rollover(calendar_symbols(calendar_ranks(mbp, instruments, root_len), instruments))


def volume_map(mbp: DataFrame, instruments: DataFrame, root_len: int = 2) -> DataFrame:
    return with_rollover(volume_symbols(volume_ranks(mbp, instruments, root_len), instruments))


def build_continuous_map(mbp: DataFrame, instruments: DataFrame, root_len: int = 2) -> DataFrame:
    return calendar_map(mbp, instruments, root_len).unionByName(volume_map(mbp, instruments, root_len))


def write_continuous_map(mbp: DataFrame, instruments: DataFrame, path: str, root_len: int = 2) -> None:
    """Rebuild the stored map, each file in order of day and symbol; a sort over all files would compute the map twice, once
    for its ranges."""
    build_continuous_map(mbp, instruments, root_len).sortWithinPartitions("ts_day", "continuous_ticker").write.mode("overwrite").parquet(path)


def mapped_events(market: Market, p: RetrieveParams, trades_only: bool) -> tuple[DataFrame, DataFrame]:
    """(map rows of the window, events of its days under their continuous ids). The window's first day is whole, so
    that a day's first event is found even if the window begins after it."""
    if market.continuous_map is None:
        raise ValueError("continuous symbols need the continuous map")
    first, last = floor_day(p.start_ts), p.end_ts
    rows = market.continuous_map.where(F.col("ts_day").between(first, last) & F.col("continuous_instrument_id").isNotNull())
    if p.symbols is not None:
        rows = rows.where(F.col("continuous_ticker").isin(list(p.symbols)))
    days = rows.select("instrument_id", day_of("ts_day").alias("day"), F.col("continuous_instrument_id").alias("cid"))
    events = time_range(market.mbp.where("dataset = 'futures'"), first, floor_day(last) + S.DAY - 1)
    if trades_only:
        events = events.where(F.col("action") == S.TRADE)
    # A map day is a whole day, so the range join on time is an equality of days.
    mapped = events.join(days, ["instrument_id", "day"]).drop("instrument_id").withColumnRenamed("cid", "instrument_id")
    return rows, mapped


def rollover_events(map_rows: DataFrame, events: DataFrame) -> DataFrame:
    """(instrument_id, ts_recv, rec_id) of the first event at or after each flagged day of each continuous id.

    Events are first cut down to one for each id and day. Those and the flagged days are then swept together, from the
    last day to the first: the event seen last when a flagged day comes is its own. A sort of a row for each id and day.
    """
    arrival = events.select("instrument_id", "day", "ts_recv", "rec_id", order_key().alias("arrival"))
    firsts = arrival.groupBy("instrument_id", "day").agg(*(F.min_by(c, "arrival").alias(c) for c in ("ts_recv", "rec_id")))
    flagged = map_rows.where("rollover_flag = 1").select(F.col("continuous_instrument_id").alias("instrument_id"), day_of("ts_day").alias("day"), F.lit(True).alias("flagged"))
    swept = firsts.withColumn("flagged", F.lit(False)).unionByName(flagged, allowMissingColumns=True)
    # Of one day the event comes before the flag, which it serves.
    back = Window.partitionBy("instrument_id").orderBy(F.desc("day"), "flagged").rowsBetween(Window.unboundedPreceding, 0)
    after = swept.select("instrument_id", "flagged", *(F.last(c, ignorenulls=True).over(back).alias(c) for c in ("ts_recv", "rec_id")))
    return after.where("flagged AND ts_recv IS NOT NULL").select("instrument_id", "ts_recv", "rec_id").distinct()


def continuous_events(market: Market, p: RetrieveParams, trades_only: bool) -> DataFrame:
    """Events under continuous ids with rollover_flag 1 on the first event after each change of contract."""
    rows, mapped = mapped_events(market, p, trades_only)
    flags = rollover_events(rows, mapped).withColumn("flag", F.lit(1))
    flagged = mapped.join(flags, ["instrument_id", "ts_recv", "rec_id"], "left")
    return flagged.withColumn("rollover_flag", F.coalesce("flag", F.lit(0))).drop("flag")
