"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written under every ``settle`` that is under way, the innermost last.
_written: list[list[str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``; where that is unset, a folder beside the
    warehouse tables is used, which a cluster shares as well. The rule is the same
    for every master.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table.

    The table goes when the session's JVM ends.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    if _written:
        _written[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written step that no later plan reads."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def drop_step(step: DataFrame) -> None:
    """Deletes the files of a table from ``cut`` that no later plan reads."""
    for file in step.inputFiles()[:1]:
        remove(step.sparkSession, file.rsplit("/", 1)[0])


def write_step(df: DataFrame, path: str) -> None:
    """Adds ``df`` to a written table. Its shuffle files go at once: no other plan reads them."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.unset(_FREE_SHUFFLES) if before is None else conf.set(_FREE_SHUFFLES, before)


def settle(make: Callable[..., DataFrame], *args, **more) -> DataFrame:
    """The written table of ``make(*args, **more)``; the steps written on the way to it go."""
    own: list[str] = []
    _written.append(own)
    try:
        made = make(*args, **more)
    finally:
        _written.pop()
    done = cut(made)
    for path in own:
        remove(done.sparkSession, path)
    return done


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Drops the lineage and survives the loss of executors like a checkpoint.
    Unlike one, the table comes back with its true size and without the
    constraints of the plan that made it, so loops plan in constant time and
    small results are broadcast on a known size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    write_step(df, path)
    return spark.read.schema(df.schema).parquet(path)
