"""What the operators of this subpackage share: the scratch folder and tables that cut lineage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch as scratch_tables
from ..scratch import discard, exists, scratch_dir

__all__ = ["discard", "exists", "scratch_dir"]
#: The white space that the contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The lists of what is made inside the ``scratch``es that this thread (or task of an event loop) is in.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def new_path(spark: SparkSession, label: str, leaves: bool = False) -> str:
    path = scratch_tables.new_path(spark, label)
    for made in () if leaves else _OPEN.get():
        made.append(path)
    return path


def materialize(df: DataFrame, label: str, leaves: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost
    executor costs a re-read, not a recomputation. Returns the table and its path. With ``leaves`` it outlives the
    ``scratch`` that it is made in."""
    spark = df.sparkSession
    path = new_path(spark, label, leaves)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside, by this thread, is deleted at the end; nothing that leaves it may read those tables any
    more. Queries in other threads keep their own."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(before)
        discard(spark, made)


def refuse(df: DataFrame, adds: Iterable[str]) -> None:
    """The columns that an operator adds must not be there yet."""
    if taken := sorted({c.lower() for c in adds} & {c.lower() for c in df.columns}):
        raise ValueError(f"columns that the operator adds exist already: {', '.join(taken)}")


def wrapped(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no name of theirs can meet one of ours."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; for ASCII alone that is the faster lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
