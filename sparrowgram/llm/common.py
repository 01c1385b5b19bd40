"""What the operators of this subpackage share: reading, Arrow maps and durable lineage cuts.

Inputs are narrowed to the named columns before anything else, so that further columns,
whatever their names, can't clash with columns made here.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only: new name = name in df."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster
    does not, as each executor would then write to its own disk."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def drop(spark: SparkSession, at: str) -> None:
    """Removes a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for spark, at in _made:
        try:
            drop(spark, at)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_clean)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back.

    The written table outlives any executor. It is removed when the driver ends, or before by spent().
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._cut_at = at
    return back


def spent(*tables: DataFrame) -> None:
    """Tables made by cut() whose last reader is done."""
    for t in tables:
        at = getattr(t, "_cut_at", None)
        if at is not None and (t.sparkSession, at) in _made:
            _made.remove((t.sparkSession, at))
            drop(t.sparkSession, at)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each Arrow batch; row counts may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def bounded_batches(b: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of b with about `most` bytes in a string column, at least one row each."""
    col = b.column(column)
    if b.nbytes <= most:
        yield b
        return
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < b.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield b.slice(at, to - at)
        at = to


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["F", "arrow_map", "batch", "bounded_batches", "cut", "narrowed", "partitions", "shared_dir", "spent", "table"]
