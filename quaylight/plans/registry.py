"""The registered queries of the market-data engine, over whole tables, and (in sql.py) their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.book import levels_normalised
from ..functions.last_value import fill_forward, filled_forward, last_non_null
from ..operators import continuous, emission, ingest, instruments, mapstore, quality, results
from ..operators.retrieve import RetrieveParams, metadata, retrieve, symbol_map, write_result
from ..operators.retrieve import symbols as known_symbols
from ..scratch import new_path
from ..sources import documents, feeds
from ..streaming.ingest_stream import recent_duplicates_dropped, record_stream, start_ingest
from . import sql
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
#: All of the feeds' time.
FROM, TO = feeds.START, feeds.START + 31 * S.DAY
_LINE = ["instrument_id", "ts_event", "price", "size", "sequence", "discriminator"]


def _raw(schema: str) -> Query:
    return lambda spark, d: retrieve(feeds.market(spark, d), RetrieveParams(None, FROM, TO, schema))


def _continuous(schema: str) -> Query:
    return lambda spark, d: retrieve(feeds.market(spark, d, continuous=True), RetrieveParams(None, FROM, TO, schema, stype="continuous"))


def _map(build) -> Query:
    return lambda spark, d: build(feeds.event_feed(spark, d), feeds.event_instruments(spark, d))


def first_events_of_contracts(spark: SparkSession, d: str) -> DataFrame:
    rows, mapped = continuous.mapped_events(feeds.market(spark, d, continuous=True), RetrieveParams(None, FROM, TO, "mbp-1", stype="continuous"), False)
    return continuous.rollover_events(rows, mapped)


def daily_volume(spark: SparkSession, d: str) -> DataFrame:
    return continuous.daily_volume(feeds.event_feed(spark, d))


def last_trade_price(spark: SparkSession, d: str) -> DataFrame:
    """For each instrument the last trade price, by the aggregate."""
    price = F.when(F.col("action") == S.TRADE, F.col("price"))
    return feeds.event_feed(spark, d).groupBy("instrument_id").agg(last_non_null(price, F.struct("ts_recv", "rec_id")).alias("last_trade_price"))


def trade_price_filled(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last trade price up to it on its day."""
    price = F.when(F.col("action") == S.TRADE, F.col("price"))
    w = Window.partitionBy("instrument_id", "day").orderBy("ts_recv", "rec_id")
    return feeds.event_feed(spark, d).select("rec_id", fill_forward(price, w).alias("trade_price"))


def trade_price_carried(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last trade price of its instrument up to it, across days."""
    price = F.when(F.col("action") == S.TRADE, F.col("price"))
    events = feeds.event_feed(spark, d).select("rec_id", "instrument_id", "ts_recv", "action", "price")
    return filled_forward(events, "instrument_id", ["ts_recv", "rec_id"], price, "trade_price").select("rec_id", "trade_price")


def book_hash(spark: SparkSession, d: str) -> DataFrame:
    return feeds.event_feed(spark, d).select("rec_id", "order_book_hash")


def levels(spark: SparkSession, d: str) -> DataFrame:
    return levels_normalised(feeds.event_feed(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ingest.prepare(feeds.line_feed(spark, d), "lines", 0)


#: The columns of an order line that records are made of, and those that tell it from others.
_USED, _OF_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], ["l_orderkey", "l_linenumber"]
#: Order lines that one task makes records of, some more or less, at about 500 bytes of memory each.
_LINES_A_PART = 250_000


def _returned(spark: SparkSession, d: str) -> DataFrame:
    """The raw records of returned lines (flag R). Lines are met before records are made of them, so that no book is shuffled."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    keys = li.where("l_returnflag = 'R'").select(*_OF_LINE).distinct()
    return feeds.line_feed(spark, d, li.select(*_USED).join(keys, _OF_LINE, "left_semi"))


def _sent_again(spark: SparkSession, d: str) -> DataFrame:
    """All trades, and after them those of returned lines (flag R) a second time; the first time ts_in_delta is the part, then
    less than 0.

    Lines move once, by order and line, before records are made of them: returned lines are met there, and equal events, whose
    sequence and discriminator these are, are made where they meet. No book or fingerprint is shuffled. Parts are small enough to
    be sorted in memory."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    parts = -(-li.count() // _LINES_A_PART)
    deal = [parts, *_OF_LINE] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else _OF_LINE
    lines = li.select(*_USED, F.monotonically_increasing_id().alias("arrived")).repartition(*deal)
    keys = li.where("l_returnflag = 'R'").select(*_OF_LINE).repartition(*deal).distinct().withColumn("again", F.lit(True))
    times = F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    raw = feeds.line_feed(spark, d, lines.join(keys, _OF_LINE, "left").withColumn("time", F.explode(times)), also=["arrived", "time"])
    part = F.col("l_partkey").cast("int")
    sent = raw.withColumn("ts_in_delta", F.when(F.col("time") == 0, part).otherwise(-part - 1))
    return ingest.prepare(sent, "lines", 0, arrival=F.col("arrived") + F.col("time") * F.lit(1 << 62))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicate_keys(_sent_again(spark, d)).select(*_LINE, "n")


def dedup_load(spark: SparkSession, d: str) -> DataFrame:
    """What a load that drops duplicates keeps, without the ids that arrival gives; ts_in_delta tells the first arrival."""
    return ingest.drop_duplicates(_sent_again(spark, d), dealt=True).select(*_LINE, "ts_in_delta", "order_book_hash")


def load_against_store(spark: SparkSession, d: str) -> DataFrame:
    """Trades that a store of the returned lines does not hold."""
    stored = ingest.prepare(_returned(spark, d), "lines", 0)
    return ingest.against_store(_lines(spark, d), stored, "left_anti").select(*_LINE)


def orphan_events(spark: SparkSession, d: str) -> DataFrame:
    """Trades whose supplier has a negative balance, when only the others are known as instruments."""
    known = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal >= 0").select(F.lit("equities").alias("dataset"), F.col("s_suppkey").alias("instrument_id"))
    return ingest.orphans(_lines(spark, d), known).select(*_LINE)


def load_high_water(spark: SparkSession, d: str) -> DataFrame:
    return ingest.high_water_mark(feeds.event_feed(spark, d), "futures")


#: All of the years of orders.
_YEARS = 694_224_000 * S.SECOND, 1_262_304_000 * S.SECOND


def _equities(schema: str) -> Query:
    return lambda spark, d: retrieve(feeds.equities(spark, d), RetrieveParams(None, *_YEARS, schema, dataset="equities"))


def _options(schema: str) -> Query:
    return lambda spark, d: retrieve(feeds.options(spark, d), RetrieveParams(None, *_YEARS, schema, dataset="option"))


def _window(schema: str, stype: str = "raw") -> Query:
    """By a list of tickers, of which one does not exist, in a window that begins and ends within a day."""
    tickers = sql.RAW_TICKERS if stype == "raw" else sql.CONTINUOUS_TICKERS
    lo, hi = FROM + 3 * S.DAY + 6 * S.HOUR, FROM + 9 * S.DAY + 18 * S.HOUR
    return lambda spark, d: retrieve(feeds.market(spark, d, stype == "continuous"), RetrieveParams(tickers, lo, hi, schema, stype=stype))


def symbol_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The latest contract of each continuous symbol, by the symbols' lists of intervals."""
    day = F.struct(F.col("ts_day").alias("start"), (F.col("ts_day") + S.DAY).alias("end"), F.col("instrument_id").cast("string").alias("raw"))
    mappings = feeds.stored_map(spark, d).groupBy(F.col("continuous_ticker").alias("symbol")).agg(F.collect_list(day).alias("intervals"))
    return quality.flat_symbol_map(mappings).select(F.explode("mappings").alias("symbol", "raw"))


def wrong_types(spark: SparkSession, d: str) -> DataFrame:
    """Events that a load would reject when all but trades call themselves tbbo."""
    rtype = F.when(F.col("action") == S.TRADE, ingest.RECORD_TYPE).otherwise("tbbo")
    return ingest.wrong_types(feeds.event_feed(spark, d).withColumn("rtype", rtype)).select("rec_id", "rtype")


def _records(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """The events as they arrive."""
    return feeds.event_feed(spark, d).where(where).withColumn("rtype", F.lit(ingest.RECORD_TYPE)).select(*S.RAW.names)


def _loaded(spark: SparkSession, d: str) -> tuple[str, list[tuple]]:
    """A new store after five loads: trades; events of unknown instruments (rejected and rolled back); trades again
    (rejected); all events, of which the new ones stay; the same load once more. The store, and what became of them."""
    store, known, raw = new_path(spark, "store"), feeds.event_instruments(spark, d), _records(spark, d)
    trades, said = _records(spark, d, f"action = {S.TRADE}"), []
    for load_id, rows, dim, duplicates in (("trades", trades, known, "error"), ("orphans", raw, known.limit(0), "drop"), ("again", trades, known, "error"), ("rest", raw, known, "drop"), ("rest", raw, known, "drop")):
        try:
            done = ingest.bulk_load(rows, store, dim, load_id, duplicates)
            said.append((load_id, done.n_rows, done.n_dropped, done.status))
        except ingest.Rejected:
            said.append((load_id, 0, 0, "rejected"))
    return store, said


def load_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after loads that succeed, fail and come twice."""
    return ingest.read_store(spark, _loaded(spark, d)[0]).select(*_LINE, "load_id")


def load_summaries(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_loaded(spark, d)[1], "load string, n_rows long, n_dropped long, status string")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive as files of a stream, trades twice, in the store that the stream loads."""
    source, store = new_path(spark, "arriving"), new_path(spark, "store")
    _records(spark, d).unionByName(_records(spark, d, f"action = {S.TRADE}")).write.parquet(source)
    start_ingest(record_stream(spark, source), store, feeds.event_instruments(spark, d), new_path(spark, "stream")).awaitTermination()
    return ingest.read_store(spark, store).select(*_LINE)


def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Events that each instrument has left in a store after the inactive ones are deleted."""
    store, known = new_path(spark, "store"), feeds.event_instruments(spark, d)
    ingest.bulk_load(_records(spark, d), store, known, "events", "drop")
    ingest.delete_events(spark, store, known.where("not active"))
    return ingest.read_store(spark, store).groupBy("instrument_id").agg(F.count("*").alias("n_events"))


def continuous_map_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """The map of a store that was loaded in two parts, built after the first and refreshed after the second."""
    store, path, known = new_path(spark, "store"), new_path(spark, "map-store"), feeds.event_instruments(spark, d)
    late = feeds.START + 20 * S.DAY
    for load_id, where in (("early", f"ts_recv < {late}"), ("late", f"ts_recv >= {late}")):
        ingest.bulk_load(_records(spark, d, where), store, known, load_id)
        mapstore.refresh_map(spark, store, known, path)
    return mapstore.read_map(spark, path)


def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """What a store of two loads has of each instrument after the inactive ones are deleted and its days rewritten."""
    store, known = new_path(spark, "store"), feeds.event_instruments(spark, d)
    for load_id, where in (("trades", f"action = {S.TRADE}"), ("others", f"action <> {S.TRADE}")):
        ingest.bulk_load(_records(spark, d, where), store, known, load_id)
    ingest.delete_events(spark, store, known.where("not active"))
    ingest.compact(spark, store, max_files=1)
    return ingest.read_store(spark, store).groupBy("instrument_id", "load_id").agg(F.count("*").alias("n_events"), F.sum("size").alias("size"))


def recent_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Events that are sent twice, after a stream has dropped repeats within its watermark."""
    source, out = new_path(spark, "arriving"), new_path(spark, "recent")
    events = feeds.event_feed(spark, d)
    events.unionByName(events).write.parquet(source)
    stream = recent_duplicates_dropped(spark.readStream.schema(events.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("instrument_id", "ts_recv", "sequence", "price")


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """How many trades the files of a written result hold, and how many of them step back in time within a file."""
    out = new_path(spark, "result")
    write_result(_raw("trades")(spark, d), out, 500)
    return quality.record_count(spark.read.parquet(out)).crossJoin(quality.file_order_check(spark, out).agg(F.count("*").alias("n_backward")))  # one row each


def equity_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of equities, from order lines."""
    return _equities("ohlcv-1d")(spark, d)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return known_symbols(feeds.event_instruments(spark, d), "futures", None)


def symbol_map_of(spark: SparkSession, d: str) -> DataFrame:
    """The symbol map of a list of tickers, of which one does not exist."""
    tickers = sql.RAW_TICKERS + sql.CONTINUOUS_TICKERS
    return symbol_map(feeds.event_instruments(spark, d), "futures", tickers).select(F.explode("mappings").alias("instrument_id", "ticker"))


def result_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = metadata(feeds.market(spark, d), RetrieveParams(None, FROM, TO, "trades"))
    return m.select("schema", "dataset", "start", "end", F.size("mappings").alias("n_symbols"))


def _found(*columns: str, **filters) -> Query:
    return lambda spark, d: instruments.find_instruments(feeds.event_instruments(spark, d), "futures", **filters).select(*columns)


def instruments_by_vendor(spark: SparkSession, d: str) -> DataFrame:
    return instruments.find_instruments(feeds.event_instruments(spark, d), "futures", vendor="north").select("instrument_id", "ticker", "active")


def instrument_create(spark: SparkSession, d: str) -> DataFrame:
    """The dimension with an equity for each supplier, also for those that share a name (the key is the number)."""
    dim = feeds.event_instruments(spark, d)
    new = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.lit("equities").alias("dataset"), F.col("s_name").alias("ticker"), F.col("s_name").alias("name"), F.lit("east").alias("vendor"),
        F.lit(2).cast("long").alias("vendor_data"), F.lit(0).cast("long").alias("last_available"), F.lit(0).cast("long").alias("first_available"),
        F.lit(None).cast("long").alias("expiration_date"), F.lit(False).alias("is_continuous"), F.lit(True).alias("active"),
    )
    return instruments.create_instruments(dim, new, namesakes=True).select("dataset", "instrument_id", "ticker", "vendor", "expiration_date")


def instrument_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The dimension after its inactive instruments have moved to another vendor."""
    dim = feeds.event_instruments(spark, d)
    changes = dim.where("not active").withColumn("vendor", F.lit("west")).withColumn("active", F.lit(True))
    return instruments.update_instruments(dim, changes).select("instrument_id", "ticker", "vendor", "active")


def instrument_delete(spark: SparkSession, d: str) -> DataFrame:
    """How many events each instrument has left after the inactive ones are deleted."""
    dim = feeds.event_instruments(spark, d)
    _, events = instruments.delete_instruments(dim, feeds.event_feed(spark, d), dim.where("not active").select("instrument_id"))
    return events.groupBy("instrument_id").agg(F.count("*").alias("n_events"))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as documents, their orders as signals, lines as instructions and as trades."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("signal_pos"), _seconds("o_orderdate").alias("timestamp"))
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("signal_pos"), *key, F.col("l_quantity").cast("int").alias("quantity"))
    # A line's place in its order is numbered where the order's lines meet for the join, so that no later exchange carries the
    # key. Tickers are made above the join, so that all tables made of it share one exchange of plain columns.
    placed = li.withColumn("pos", F.row_number().over(Window.partitionBy("signal_pos").orderBy(*key, "quantity")))
    met = placed.join(orders.select("doc_id", "signal_pos"), "signal_pos")
    instructions = met.select("signal_pos", "pos", F.col("l_partkey").cast("string").alias("ticker"), "quantity", "doc_id")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name")), orders, instructions


_STATISTICS, _ACCOUNT = documents.BACKTEST["metadata"].dataType["static_stats"].dataType, documents.LIVE["account"].dataType


def _marked(names: list[str]) -> dict[str, Column]:
    """A value for each field that tells document and field."""
    return {n: F.col("doc_id") * 100 + i for i, n in enumerate(names)}


def _stored_documents(spark: SparkSession, d: str, kind: str) -> str:
    """Customers as documents of a kind: built from tables, written as JSON, read, split into tables, stored, and those on
    the other side of a balance of nothing deleted. Returns the folder."""
    docs, signals, lines = _documents(spark, d)
    customer = spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_custkey", "doc_id")
    null = lambda kind, **known: F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    parameters = null(documents.BACKTEST["metadata"].dataType["parameters"].dataType, strategy_name=F.col("c_name"), capital=cents, tickers=F.array("c_mktsegment"))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    series = null(documents.BACKTEST["period_timeseries_stats"].dataType.elementType, timestamp=_seconds("o_orderdate"), equity_value=F.round(F.col("o_totalprice") * 100))
    order = null(documents.BACKTEST["signals"].dataType.elementType["trade_instructions"].dataType.elementType, ticker=F.col("ticker"), quantity=F.col("quantity"))
    trade = null(documents.BACKTEST["trades"].dataType.elementType, ticker=F.col("ticker"), quantity=F.col("quantity"))
    tables = {
        "header": docs.select("doc_id", "name"),
        "parameters": customer.select("doc_id", parameters.alias("p")).select("doc_id", "p.*"),
        "signals": signals,
        "instructions": lines.select("doc_id", "signal_pos", "pos", order.alias("i")).select("doc_id", "signal_pos", "pos", "i.*"),
        "trades": lines.select("doc_id", F.struct("signal_pos", "pos").alias("pos"), trade.alias("t")).select("doc_id", "pos", "t.*"),
        "static_stats": customer.select("doc_id", null(_STATISTICS, **_marked(_STATISTICS.names)).alias("s")).select("doc_id", "s.*"),
        # The daily series has the same orders, in cents less one.
        "series": orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), series.alias("s"))
        .select("doc_id", "pos", "s.*").withColumn("granularity", F.explode(F.array(F.lit("period"), F.lit("daily")))).withColumn("equity_value", F.col("equity_value") - F.when(F.col("granularity") == "daily", 1).otherwise(0)),
        "account": customer.select("doc_id", null(_ACCOUNT, **_marked(_ACCOUNT.names) | {"currency": F.col("doc_id"), "start_buying_power": F.col("c_nationkey")}).alias("a")).select("doc_id", "a.*"),
    }
    tables = {k: v.withColumn("kind", F.lit(kind)) for k, v in tables.items() if k in results.PARTS[kind]}
    source, folder = new_path(spark, "json"), new_path(spark, "documents")
    results.assemble(tables, kind).drop("doc_id").write.json(source, compression="gzip")
    read = documents.read_documents(spark, source, kind, lines=True)
    # A live session has no id of its own: its account names the customer here.
    read = read.withColumn("doc_id", (F.col("metadata.backtest_id") if kind == "backtest" else F.col("account.currency")).cast("long"))
    results.write_tables(results.store_documents(read, kind), folder)
    results.delete_stored(customer.where("c_acctbal < 0" if kind == "backtest" else "c_acctbal >= 0").select("doc_id"), folder, kind)
    return folder


def _assembled(kind: str) -> Query:
    """Numbers of the parts of each stored document, sums and firsts of them, its name, capital and ticker."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        whole = results.assemble(results.read_tables(spark, _stored_documents(spark, d, kind), kind), kind)
        parameters = F.col("metadata.parameters" if kind == "backtest" else "parameters")
        total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
        return whole.select(
            "doc_id",
            (F.col("metadata.backtest_name") if kind == "backtest" else parameters["strategy_name"]).alias("name"),
            F.get(parameters["tickers"], F.lit(0)).alias("ticker"),
            parameters["capital"].alias("capital"),
            F.size("signals").alias("n_signals"),
            total("signals", lambda x: F.size(x["trade_instructions"])).cast("int").alias("n_instructions"),
            F.size("trades").alias("n_trades"),
            total("trades", lambda x: x["quantity"]).alias("quantity"),
            F.get("trades", F.lit(0))["ticker"].alias("first_ticker"),
            F.get("signals", F.size("signals") - 1)["timestamp"].alias("last_time"),
            (total("period_timeseries_stats", lambda x: x["equity_value"]) if kind == "backtest" else F.col("account.start_buying_power")).alias("equity"),
        )

    return query


def _unpivoted(whole: DataFrame, record: str, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{record}.{n}").cast("long").alias("value")) for n in names)))
    return whole.select("doc_id", pairs.alias("p")).select("doc_id", "p.field", "p.value")


def backtest_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Each statistic of each stored backtest."""
    whole = results.assemble(results.read_tables(spark, _stored_documents(spark, d, "backtest"), "backtest"), "backtest")
    return _unpivoted(whole, "metadata.static_stats", _STATISTICS.names)


def equity_series(spark: SparkSession, d: str) -> DataFrame:
    """Both series of each stored backtest, by position."""
    whole = results.assemble(results.read_tables(spark, _stored_documents(spark, d, "backtest"), "backtest"), "backtest")
    parts = [whole.select("doc_id", F.lit(g).alias("granularity"), F.posexplode(c).alias("pos", "s")) for g, c in results.SERIES.items()]
    return parts[0].unionByName(parts[1]).select("doc_id", "granularity", "pos", "s.timestamp", "s.equity_value")


def live_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Each field of the account of each stored live session; its currency is a number here."""
    whole = results.assemble(results.read_tables(spark, _stored_documents(spark, d, "live"), "live"), "live")
    return _unpivoted(whole, "account", _ACCOUNT.names)


def live_list(spark: SparkSession, d: str) -> DataFrame:
    """Stored live sessions, and whether the list tells the time of storing as text."""
    listed = results.list_documents(results.read_tables(spark, _stored_documents(spark, d, "live"), "live")["header"], "live")
    shown = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$") & (F.to_timestamp("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX") <= F.current_timestamp())
    return listed.select("doc_id", shown.alias("has_time"))


def docs_purged(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each table has of each document after deleted ones are taken out of the files."""
    folder = _stored_documents(spark, d, "backtest")
    results.purge(spark, folder)
    tables = results.read_tables(spark, folder, "backtest")
    counted = [tables[name].groupBy("doc_id").agg(F.count("*").alias("n_rows")).withColumn("part", F.lit(name)) for name in ("header", "signals", "instructions")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).select("part", "doc_id", "n_rows")


def doc_list(spark: SparkSession, d: str) -> DataFrame:
    return results.list_documents(results.read_tables(spark, _stored_documents(spark, d, "backtest"), "backtest")["header"], "backtest")


def doc_ids_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Ids of stored backtests by the names of every tenth of the first customers."""
    names = [r.c_name for r in spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 10 = 1 AND c_custkey < 500").select("c_name").collect()]
    return results.ids_by_name(results.read_tables(spark, _stored_documents(spark, d, "backtest"), "backtest")["header"], names)


def _seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def signals_nested(spark: SparkSession, d: str) -> DataFrame:
    """Signals nested by document and flattened again: position, time, count and list of their instructions."""
    _, signals, instructions = _documents(spark, d)
    nested = results.nest_signals(signals, instructions)
    s = nested.select("doc_id", F.posexplode("signals").alias("signal_pos", "s"))
    what = F.array_join(F.transform("s.trade_instructions", lambda i: F.concat_ws(":", i["ticker"], i["quantity"].cast("string"))), ",")
    return s.select("doc_id", "signal_pos", F.col("s.timestamp").alias("timestamp"), F.size("s.trade_instructions").alias("n_instructions"), what.alias("instructions"))


def trades_by_doc(spark: SparkSession, d: str) -> DataFrame:
    """Number, quantity and first ticker of each document's trades, by the gathered array."""
    docs, _, instructions = _documents(spark, d)
    gathered = results.gathered(instructions.withColumn("o", F.struct("signal_pos", "pos")).drop("pos", "signal_pos"), "trades", order="o")
    whole = docs.join(gathered, "doc_id", "left")
    quantity = F.aggregate("trades", F.lit(0).cast("long"), lambda a, t: a + t["quantity"])
    return whole.select("doc_id", "name", F.when(F.col("trades").isNull(), 0).otherwise(F.size("trades")).alias("n_trades"), F.coalesce(quantity, F.lit(0)).cast("long").alias("quantity"), F.get("trades", F.lit(0))["ticker"].alias("first_ticker"))


def doc_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table and document kind left after documents with a negative balance are deleted."""
    docs, signals, instructions = _documents(spark, d)
    ids = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").alias("doc_id"))
    tables = {"header": docs, "signals": signals, "instructions": instructions}
    left = results.delete_documents({k: v.withColumn("kind", F.lit("backtest")) for k, v in tables.items()}, "backtest", ids)
    counted = [t.groupBy("doc_id").agg(F.count("*").alias("n_rows")).withColumn("part", F.lit(name)) for name, t in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).select("part", "doc_id", "n_rows")


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The differences between all events and the events of active instruments with trades left out."""
    m = feeds.market(spark, d)
    cols = ["instrument_id", "ts_recv", "price", "size", "action"]
    some = m.mbp.join(m.instruments.where("active").select("instrument_id"), "instrument_id", "left_semi").where(F.col("action") != S.TRADE)
    return quality.reconcile(m.mbp.select(*cols), some.select(*cols))


def reconcile_keyed(spark: SparkSession, d: str) -> DataFrame:
    """What has changed where, if in the last days trades of inactive instruments are missing and errors have other prices
    and sizes."""
    m = feeds.market(spark, d)
    cols = ["day", "instrument_id", "rec_id", "ts_recv", "action", "price", "size"]
    late = F.col("ts_recv") >= FROM + 25 * S.DAY
    idle = m.instruments.where("not active").select(F.col("instrument_id").alias("idle"))
    left = m.mbp.select(*cols)
    met = left.join(idle, F.col("instrument_id") == F.col("idle"), "left").where(~(late & F.col("idle").isNotNull() & (F.col("action") == S.TRADE)))
    other = late & (F.col("action") == 82)
    right = met.withColumn("price", F.col("price") + F.when(other, 1).otherwise(0)).withColumn("size", F.col("size") + F.when(other, 1).otherwise(0)).select(*cols)
    return quality.reconcile_keyed(left, right, ["day", "instrument_id", "rec_id"], ["day", "instrument_id"]).select("instrument_id", "rec_id", "side", "changed")


def result_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest of a result in chunks adds up to, and how many chunks begin before the one before has ended."""
    listed = emission.emit(_raw("trades")(spark, d), new_path(spark, "result"), records_per_file=500)
    whole = listed.agg(F.sum("n_records").alias("n_records"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max(F.col("n_before") + F.col("n_records")).alias("n_upto"))
    return whole.crossJoin(emission.steps_between(listed).agg(F.count("*").alias("n_backward")))  # one row each


def csv_load(spark: SparkSession, d: str) -> DataFrame:
    """A store that was loaded from CSV in which errors have no number for a price, and how many lines were rejected."""
    source, store = new_path(spark, "csv"), new_path(spark, "store")
    rows = _records(spark, d)
    sides = [F.get("levels", F.lit(i))[c].alias(f"{c}_{i:02d}") for i in range(2) for c in S.BOOK]
    price = F.when(F.col("action") == 82, "?").otherwise(F.col("price").cast("string"))
    rows.withColumn("price", price).select(*(c for c in S.RAW.names if c != "levels"), *sides).write.option("header", "true").csv(source)
    done = ingest.load_csv(spark, source, store, feeds.event_instruments(spark, d), "csv", depth=2)
    return levels_normalised(ingest.read_store(spark, store).select(F.col("sequence").alias("rec_id"), "levels")).withColumn("n_rejected", F.lit(done.n_rejected).cast("long"))


def chronological_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.chronological_check(feeds.event_feed(spark, d))


def rollover_count(spark: SparkSession, d: str) -> DataFrame:
    return quality.rollover_count(_continuous("mbp-1")(spark, d))


QUERIES: dict[str, Query] = {
    "mbp1_raw": _raw("mbp-1"),
    "tbbo_raw": _raw("tbbo"),
    "trades_raw": _raw("trades"),
    "ohlcv_1s": _raw("ohlcv-1s"),
    "ohlcv_1m": _raw("ohlcv-1m"),
    "ohlcv_1h": _raw("ohlcv-1h"),
    "ohlcv_1d": _raw("ohlcv-1d"),
    "bbo_1s": _raw("bbo-1s"),
    "bbo_1m": _raw("bbo-1m"),
    "mbp1_continuous": _continuous("mbp-1"),
    "tbbo_continuous": _continuous("tbbo"),
    "trades_continuous": _continuous("trades"),
    "ohlcv_1d_continuous": _continuous("ohlcv-1d"),
    "ohlcv_1h_continuous": _continuous("ohlcv-1h"),
    "bbo_1s_continuous": _continuous("bbo-1s"),
    "bbo_1m_continuous": _continuous("bbo-1m"),
    "continuous_map_calendar": _map(continuous.calendar_map),
    "continuous_map_volume": _map(continuous.volume_map),
    "continuous_map": _map(continuous.build_continuous_map),
    "rollover_events": first_events_of_contracts,
    "daily_volume": daily_volume,
    "last_non_null": last_trade_price,
    "trade_price_filled": trade_price_filled,
    "trade_price_carried": trade_price_carried,
    "book_hash": book_hash,
    "levels_normalised": levels,
    "duplicate_keys": duplicate_keys,
    "dedup_load": dedup_load,
    "load_against_store": load_against_store,
    "orphan_events": orphan_events,
    "load_high_water": load_high_water,
    "ohlcv_1d_equities": equity_bars,
    "mbp1_equities": _equities("mbp-1"),
    "tbbo_equities": _equities("tbbo"),
    "trades_equities": _equities("trades"),
    "bbo_1m_equities": _equities("bbo-1m"),
    "mbp1_option": _options("mbp-1"),
    "tbbo_option": _options("tbbo"),
    "trades_option": _options("trades"),
    "ohlcv_1h_option": _options("ohlcv-1h"),
    "bbo_1s_option": _options("bbo-1s"),
    "ohlcv_1s_continuous": _continuous("ohlcv-1s"),
    "ohlcv_1m_continuous": _continuous("ohlcv-1m"),
    "window_mbp1": _window("mbp-1"),
    "window_ohlcv_1h": _window("ohlcv-1h"),
    "window_bbo_1m": _window("bbo-1m"),
    "window_mbp1_continuous": _window("mbp-1", "continuous"),
    "window_ohlcv_1d_continuous": _window("ohlcv-1d", "continuous"),
    "continuous_map_stored": feeds.stored_map,
    "symbol_intervals": symbol_intervals,
    "wrong_types": wrong_types,
    "load_round_trip": load_round_trip,
    "load_summaries": load_summaries,
    "stream_ingest": stream_ingest,
    "store_delete": store_delete,
    "store_compacted": store_compacted,
    "continuous_map_refreshed": continuous_map_refreshed,
    "recent_duplicates": recent_duplicates,
    "result_files": result_files,
    "instruments_by_ticker": _found("instrument_id", "ticker", "vendor", ticker=sql.RAW_TICKERS + sql.CONTINUOUS_TICKERS),
    "instruments_by_id": _found("instrument_id", "ticker", "vendor", instrument_id=range(0, 200, 10)),
    "instruments_by_class": _found("instrument_id", "ticker", "vendor", "active"),
    "symbol_map_of": symbol_map_of,
    "backtests_assembled": _assembled("backtest"),
    "live_assembled": _assembled("live"),
    "doc_list": doc_list,
    "doc_ids_by_name": doc_ids_by_name,
    "symbol_map": symbols,
    "result_metadata": result_metadata,
    "instruments_by_vendor": instruments_by_vendor,
    "instrument_create": instrument_create,
    "instrument_upsert": instrument_upsert,
    "instrument_delete": instrument_delete,
    "signals_nested": signals_nested,
    "trades_by_doc": trades_by_doc,
    "doc_delete": doc_delete,
    "reconcile": reconcile,
    "reconcile_keyed": reconcile_keyed,
    "result_chunks": result_chunks,
    "csv_load": csv_load,
    "backtest_statistics": backtest_statistics,
    "equity_series": equity_series,
    "live_accounts": live_accounts,
    "live_list": live_list,
    "docs_purged": docs_purged,
    "chronological_check": chronological_check,
    "rollover_count": rollover_count,
}
assert set(SQL) <= set(QUERIES)
