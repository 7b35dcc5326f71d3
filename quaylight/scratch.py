"""Scratch tables in the folder that the cluster shares; one folder an application, deleted when the driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of
    its own; on a cluster that would lose rows, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaylight-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def _delete(jvm, conf, path: str) -> None:
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(conf).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends there, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing reads any more."""
    for p in paths:
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), p)
