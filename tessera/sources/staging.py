"""Tables that several steps read, written once to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list] = []


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder in its warehouse, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


def new_folder(spark: SparkSession, outlive: bool = False) -> str:
    """A path of its own in the shared folder; what is there goes when the session ends, or the released() block around it.

    With ``outlive`` it stays when the innermost block ends.
    """
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    target, system = _target(spark, path)
    system.mkdirs(target)  # a path that is not there is not noted for the end
    system.deleteOnExit(target)
    if len(_open) > outlive:
        _open[-1 - outlive].append((spark, path))
    return path


def written(df: DataFrame, outlive: bool = False) -> DataFrame:
    """The same rows, read from Parquet in a new_folder()."""
    path = new_folder(df.sparkSession, outlive)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table whose rows become files that one task makes.
ROWS = 10_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as their number asks for.

    A table of narrow rows is a small file, which one task reads however many rows it has. What is made from them is much larger, so they are
    dealt out before. Rows are counted in the file's footer; an adaptive shuffle would go by their bytes.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)), key)


@contextmanager
def released() -> Iterator[None]:
    """Tables written inside are deleted at the end: for steps whose result is stored by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            target, system = _target(spark, path)
            system.delete(target, True)
