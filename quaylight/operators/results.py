"""Trading-result documents as flat tables and back, many documents in a job.

``kind`` is backtest or live. A document has an integer id; its parts keep their positions, so documents come back
as they went in.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..scratch import exists
from ..sources.folders import only_writer, publish, published, remove, withdraw

SERIES = {"period": "period_timeseries_stats", "daily": "daily_timeseries_stats"}
Tables = dict[str, DataFrame]


def assign_ids(docs: DataFrame, top: int = 0, order: list[str] | None = None) -> DataFrame:
    """Documents with ``doc_id`` above ``top``, consecutive in the order; with gaps where no order is given. The order is
    of columns or fields."""
    if order is None:
        return docs.withColumn("doc_id", F.monotonically_increasing_id() + top + 1)
    keyed = docs.select("*", *(F.col(c).alias(f"_by{i}") for i, c in enumerate(order)))
    done = numbered(keyed, [f"_by{i}" for i in range(len(order))], "doc_id")
    return done.select(*docs.columns, (F.col("doc_id") + top).alias("doc_id"))


def _rows(docs: DataFrame, array: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(array).alias("pos", "r")).select("doc_id", "pos", "r.*")


def explode_signals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals by position, their instructions by both positions)."""
    signals = docs.select("doc_id", F.posexplode("signals").alias("signal_pos", "s"))
    instructions = signals.select("doc_id", "signal_pos", F.posexplode("s.trade_instructions").alias("pos", "i"))
    return signals.select("doc_id", "signal_pos", F.col("s.timestamp").alias("timestamp")), instructions.select("doc_id", "signal_pos", "pos", "i.*")


def store_documents(docs: DataFrame, kind: str) -> Tables:
    """Documents with doc_id (and name, for backtests in metadata) → flat tables, each with a ``kind`` column."""
    head = docs.select("doc_id", F.col("metadata.backtest_name").alias("name"), "metadata.parameters", "metadata.static_stats") if kind == "backtest" else docs.select("doc_id", F.lit(None).cast("string").alias("name"), "parameters", "account")
    signals, instructions = explode_signals(docs)
    tables = {
        "header": head.select("doc_id", "name", F.current_timestamp().alias("created_at")),
        "parameters": head.select("doc_id", "parameters.*"),
        "trades": _rows(docs, "trades"),
        "signals": signals,
        "instructions": instructions,
    }
    if kind == "backtest":
        tables["static_stats"] = head.select("doc_id", "static_stats.*")
        tables["series"] = reduce(DataFrame.unionByName, (_rows(docs, c).withColumn("granularity", F.lit(g)) for g, c in SERIES.items()))
    else:
        tables["account"] = head.select("doc_id", "account.*")
    return {name: t.withColumn("kind", F.lit(kind)) for name, t in tables.items()}


def unique_names(new_header: DataFrame, header: DataFrame) -> DataFrame:
    """Names of new documents that exist already or come twice."""
    twice = new_header.where("name is not null").groupBy("kind", "name").count().where("count > 1").select("kind", "name")
    return new_header.join(header, ["kind", "name"], "left_semi").select("kind", "name").unionByName(twice).distinct()


def gathered(rows: DataFrame, name: str, by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """The rows of each key as an array in order, without key and order."""
    by = by or ["doc_id"]
    fields = [c for c in rows.columns if c not in (*by, order, "kind", "granularity")]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("r"))))
    return rows.groupBy(*by).agg(F.transform(listed, lambda x: x["r"]).alias(name))


def nest_signals(signals: DataFrame, instructions: DataFrame) -> DataFrame:
    """doc_id and its signals with their instructions; signals without any keep an empty list."""
    inner = gathered(instructions, "trade_instructions", ["doc_id", "signal_pos"])
    empty = F.array().cast(inner.schema["trade_instructions"].dataType)
    full = signals.drop("kind").join(inner, ["doc_id", "signal_pos"], "left").withColumn("trade_instructions", F.coalesce("trade_instructions", empty))
    return gathered(full, "signals", order="signal_pos")


def _one(table: DataFrame, name: str) -> DataFrame:
    return table.select("doc_id", F.struct(*(c for c in table.columns if c not in ("doc_id", "kind"))).alias(name))


def assemble(tables: Tables, kind: str) -> DataFrame:
    """Whole documents of one kind, all ids at once; filter the tables first for one document."""
    t = {k: v.where(F.col("kind") == kind) for k, v in tables.items()}
    parts = [_one(t["parameters"], "parameters"), gathered(t["trades"], "trades"), nest_signals(t["signals"], t["instructions"])]
    if kind == "backtest":
        parts.append(_one(t["static_stats"], "static_stats"))
        parts += [gathered(t["series"].where(F.col("granularity") == g), c) for g, c in SERIES.items()]
    else:
        parts.append(_one(t["account"], "account"))
    whole = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, t["header"].select("doc_id", "name"))
    for f in whole.schema.fields:
        if f.dataType.typeName() == "array":
            whole = whole.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    if kind == "backtest":
        meta = F.struct(F.col("doc_id").cast("int").alias("backtest_id"), F.col("name").alias("backtest_name"), "parameters", "static_stats")
        return whole.select("doc_id", meta.alias("metadata"), *SERIES.values(), "trades", "signals")
    return whole.select("doc_id", "parameters", "account", "trades", "signals")


def ids_by_name(header: DataFrame, names: list[str]) -> DataFrame:
    return header.where(F.col("name").isin(names)).select("kind", "doc_id", "name")


def list_documents(header: DataFrame, kind: str) -> DataFrame:
    """(id, name) of backtests, (id, created_at as text) of live sessions."""
    shown = F.col("name") if kind == "backtest" else F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("created_at")
    return header.where(F.col("kind") == kind).select("doc_id", shown)


def delete_documents(tables: Tables, kind: str, ids: DataFrame) -> Tables:
    """All tables without the documents in ``ids`` (doc_id) of that kind."""
    gone = ids.select("doc_id", F.lit(kind).alias("kind"))
    return {name: t.join(gone, ["doc_id", "kind"], "left_anti") for name, t in tables.items()}


def _base(spark: SparkSession, folder: str) -> str:
    """Where the folder's tables lie: in its newest generation, if it was purged."""
    versions = published(spark, folder)
    return f"{folder}/{versions[-1][1]}" if versions else folder


def write_tables(tables: Tables, folder: str, mode: str = "append") -> None:
    """Each table as Parquet, partitioned by kind. One writer at a time."""
    spark = next(iter(tables.values())).sparkSession
    with only_writer(spark, folder, f"documents {uuid.uuid4().hex}"):
        _write(tables, _base(spark, folder), mode)


def _write(tables: Tables, base: str, mode: str = "append") -> None:
    for name, t in tables.items():
        t.write.mode(mode).partitionBy("kind").parquet(f"{base}/{name}")


_PARTS = ["header", "parameters", "trades", "signals", "instructions"]
PARTS = {"backtest": [*_PARTS, "static_stats", "series"], "live": [*_PARTS, "account"]}


def read_tables(spark: SparkSession, folder: str, kind: str) -> Tables:
    """What write_tables wrote of a kind, without deleted documents."""
    base = _base(spark, folder)
    tables = {name: spark.read.parquet(f"{base}/{name}").where(F.col("kind") == kind) for name in PARTS[kind]}
    if not exists(spark, f"{base}/deleted"):
        return tables
    return delete_documents(tables, kind, spark.read.parquet(f"{base}/deleted").where(F.col("kind") == kind))


def delete_stored(ids: DataFrame, folder: str, kind: str) -> None:
    """Delete documents by ``ids`` (doc_id) with all their parts: one small table is appended, no part is rewritten until
    ``purge``. Ids are not given out again."""
    spark = ids.sparkSession
    with only_writer(spark, folder, f"deletion {uuid.uuid4().hex}"):
        ids.select("doc_id", F.lit(kind).alias("kind")).distinct().write.mode("append").parquet(f"{_base(spark, folder)}/deleted")


def purge(spark: SparkSession, folder: str) -> bool:
    """Take deleted documents with all their parts out of the files for good; whether there were any. The tables are written
    anew as the folder's next generation, which readers see all at once; then the one before is deleted. If it dies,
    readers see the tables as before or as after."""
    with only_writer(spark, folder, f"purge {uuid.uuid4().hex}") as lock:
        base, new = _base(spark, folder), f"generation-{uuid.uuid4().hex}"
        if not exists(spark, f"{base}/deleted"):
            return False
        gone = spark.read.parquet(f"{base}/deleted")
        every = sorted({part for parts in PARTS.values() for part in parts})
        tables = {n: spark.read.parquet(f"{base}/{n}").join(gone, ["doc_id", "kind"], "left_anti") for n in every if exists(spark, f"{base}/{n}")}
        _write(tables, f"{folder}/{new}")
        publish(lock, new)
        for number, name in published(spark, folder)[:-1]:
            withdraw(spark, folder, number, name)
            remove(spark, f"{folder}/{name}")
        if base == folder:
            for n in (*every, "deleted"):
                remove(spark, f"{folder}/{n}")
        return True
