"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing a Parquet table and reading it again, so a lost
executor costs a re-read and never a recomputation of a whole loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []
#: Where the folder is kept if spark.checkpoint.dir, which a session cannot change, is unset.
_OWN = "eventide.work.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and a cluster a
    folder in its warehouse, if that is a store and no machine's own disk.
    """
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, None):
        return found
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        made = tempfile.mkdtemp(prefix="eventide-")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = warehouse.rstrip("/") + "/eventide_work"
    spark.conf.set(_OWN, made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/eventide-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._eventide_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_eventide_path", None)
    if path in _TABLES:
        _delete(df.sparkSession, path)


def made() -> int:
    """How many tables there are: a mark for ``sweep``."""
    return len(_TABLES)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables made since a mark but ``keep``; only for callers whose results are written."""
    kept = {getattr(df, "_eventide_path", None) for df in keep}
    for path in _TABLES[since:]:
        if path not in kept:
            _delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete(spark: SparkSession, path: str) -> None:
    delete(spark, path)
    _TABLES.remove(path)
