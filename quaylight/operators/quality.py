"""Checks that a user of the tables runs: counts, order, reconciliation, symbol intervals, rollovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_records"))


def backward_steps(df: DataFrame, position: Column, within: list[Column]) -> DataFrame:
    """Records whose ts_recv is less than that of the record before, by position within each part (a file, a day)."""
    before = F.lag("ts_recv").over(Window.partitionBy(*within).orderBy(position))
    return df.withColumn("before", before).where(F.col("ts_recv") < F.col("before"))


def chronological_check(df: DataFrame, position: Column | None = None, stretch: int = 1_000_000) -> DataFrame:
    """One row: how many records there are and how many come before the record before them in time, by their long
    positions (arrival). Stretches of so many positions are looked through apart, and their ends then put together,
    so the last window sees a row for each stretch."""
    place = (F.col("rec_id") if position is None else position).cast("long")
    rows = df.select(place.alias("at"), F.call_function("div", place, F.lit(stretch).cast("bigint")).alias("stretch"), "ts_recv")
    inner = backward_steps(rows, F.col("at"), [F.col("stretch")]).agg(F.count("*").alias("n_inner"))
    ends = rows.groupBy("stretch").agg(F.min_by("ts_recv", "at").alias("ts_recv"), F.max_by("ts_recv", "at").alias("last"), F.count("*").alias("n"))
    before = F.lag("last").over(Window.orderBy("stretch"))
    outer = ends.withColumn("before", before).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count(F.when(F.col("ts_recv") < F.col("before"), 1)).alias("n_outer"))
    return outer.crossJoin(inner).select("n_records", (F.col("n_inner") + F.col("n_outer")).alias("n_backward"))  # one row each


def file_order_check(spark, path: str) -> DataFrame:
    """Backward steps within each file of a written result, by the rows' positions in it."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "ts_recv")
    return backward_steps(rows, F.col("row"), [F.col("file")])


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """The multiset difference both ways: a row for each distinct record that is not as often on both sides, with the
    surplus n and the side that has it."""
    cols = left.columns
    counted = left.select(*cols, F.lit(1).alias("_n")).unionByName(right.select(*cols, F.lit(-1).alias("_n")))
    net = counted.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.select(*cols, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))


def branch_digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """For each branch the number of rows and two sums of row hashes: the same for the same rows in any order. A branch's
    digest is the sum of its parts', so coarser ones need no second look at the rows."""
    sums = (F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"_h{seed}") for seed in (1, 2))
    return df.groupBy(*by).agg(F.count("*").alias("_rows"), *sums)


def differing(left: DataFrame, right: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Branches (values of ``by``) whose rows are not the same on both sides."""
    one, two = (branch_digests(df, by, columns) for df in (left, right))
    both = one.unionByName(two.select(*by, *((-F.col(c)).alias(c) for c in ("_rows", "_h1", "_h2"))))
    return both.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("_rows", "_h1", "_h2"))).where("_rows <> 0 OR _h1 <> 0 OR _h2 <> 0").select(*by)


def reconcile_keyed(left: DataFrame, right: DataFrame, key: list[str], by: list[str], most_days: int = 20_000) -> DataFrame:
    """Where two tables differ, by key: the key, side (left or right for a row that only one side has, changed for one that
    both have) and changed, the names of the columns that differ, by comma in the order of the table.

    First each branch of ``by`` (the first of which is ``day``, the others part of each row's key) is summed up on both
    sides, once over all rows; only rows of branches that differ are then compared, and of partitioned tables only their
    days are read again. Rows that share a key are told apart by their place among themselves in the order of the other
    columns, so a key that is repeated compares like with like as far as it goes. Nulls are values like any.
    """
    columns = left.columns
    rest = [c for c in columns if c not in key]
    found = written(differing(left, right, by, columns), "differing")
    days = [r.day for r in found.select("day").distinct().limit(most_days + 1).collect()]

    def narrowed(df: DataFrame, side: str) -> DataFrame:
        some = df.where(F.col("day").isin(days)) if len(days) <= most_days else df
        names = {b: f"_{b}" for b in by}
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        met = some.join(found.withColumnsRenamed(names), same, "left_semi")
        copy = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_first() for c in rest)))
        return met.select(*key, copy.alias("_copy"), F.struct(*rest).alias(side)) if rest else met.select(*key, copy.alias("_copy"), F.lit(True).alias(side))

    one, two = narrowed(left, "_left"), narrowed(right, "_right")
    met = one.unionByName(two, allowMissingColumns=True).groupBy(*key, "_copy").agg(F.first("_left", True).alias("_left"), F.first("_right", True).alias("_right"))
    names = F.array(*(F.when(~F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")), c) for c in rest)) if rest else F.array().cast("array<string>")
    side = F.when(F.col("_right").isNull(), "left").when(F.col("_left").isNull(), "right").otherwise("changed")
    changed = F.when(F.col("_left").isNull() | F.col("_right").isNull(), "").otherwise(F.array_join(names, ","))
    return met.select(*key, side.alias("side"), changed.alias("changed")).where("side <> 'changed' OR changed <> ''")


def flat_symbol_map(mappings: DataFrame) -> DataFrame:
    """(symbol, intervals array<struct<start, end, raw>>) → one row with the map symbol → raw symbol; of several
    intervals the latest counts."""
    last = mappings.select("symbol", F.explode("intervals").alias("i")).groupBy("symbol").agg(F.max_by("i.raw", F.struct("i.start", "i.raw")).alias("raw"))
    return last.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "raw")))).alias("mappings"))


def rollover_count(records: DataFrame) -> DataFrame:
    """How many records of each instrument begin a new contract."""
    return records.where("rollover_flag = 1").groupBy("instrument_id").agg(F.count("*").alias("n_rollovers"))
