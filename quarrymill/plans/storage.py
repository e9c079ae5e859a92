"""Cutting lineage with tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else the checkpoint folder of the SparkContext.

    Where neither is set, a local master writes beside its warehouse, as the one machine is all there is;
    a cluster has no folder that it surely shares, so there an error says what to set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("no shared folder: set spark.checkpoint.dir, or call SparkContext.setCheckpointDir")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back, so that later steps neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrymill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later step reads, and of the tables that a result rests on."""
    path = vars(df).get("written_to")
    if path in _written:
        _delete(_written.pop(path), path)
    for table in vars(df).get("rests_on", ()):
        discard(table)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def release() -> None:
    """Remove every table written by `materialize` in this process."""
    while _written:
        path, spark = _written.popitem()
        _delete(spark, path)
