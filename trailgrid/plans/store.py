"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Whether a query's shuffle files go when it ends, and not only when the driver happens to collect its garbage.
_SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    A session on one machine that names no such folder gets a temporary one,
    deleted when Python ends.  On a cluster a missing setting is an error: a
    folder of the driver's own disk would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="trailgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base := f"file://{own}")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet and read them back: what follows starts from a short plan and survives lost executors.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path, was = shared_path(spark, name), spark.conf.get(_SHORT_LIVED, None)
    spark.conf.set(_SHORT_LIVED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_SHORT_LIVED)
        else:
            spark.conf.set(_SHORT_LIVED, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave, once nothing is read from them any more."""
    for table in tables:
        names = {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}
        for path in [p for p in _made if p.rpartition("/")[2] in names]:
            _delete(table.sparkSession, path)
            _made.remove(path)


def release(spark: SparkSession) -> int:
    """Delete all that ``shared_path`` has named in this process, once no result is read from it any more; how many there were."""
    paths, n = list(_made), len(_made)
    _made.clear()
    for path in paths:
        _delete(spark, path)
    return n


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
