"""Cutting lineage in loops: a written table in the shared folder that spark.checkpoint.dir names.

Where it is unset, a local master gets a folder of its own; a cluster does not, as each executor would then write to its own disk.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back. The table is removed by spent(), or when the driver ends."""
    spark = df.sparkSession
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lineage-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/cut-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_at = path
    return back


def spent(*tables: DataFrame) -> None:
    """Tables made by cut() whose last reader is done."""
    for t in tables:
        at = getattr(t, "_durable_at", None)
        if at in _made:
            _remove(_made.pop(at), at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for at, spark in _made.items():
        try:
            _remove(spark, at)
        except Exception:  # the session has ended: the folder's owner clears it
            return
