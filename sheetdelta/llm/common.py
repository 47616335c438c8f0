"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.session import remove, scratch_path

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Steps whose rows may hold megabytes: pages are cut by size from the first row on, and packed as a stream.
STEP_OPTIONS = {"compression": "zstd", "parquet.page.size.row.check.min": "1"}


def written(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` as a table in the shared folder, and what deletes it once nothing reads it any more."""
    spark = rows.sparkSession
    path = scratch_path(spark, "step")
    rows.write.options(**STEP_OPTIONS).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), lambda: remove(spark, path)


def bucketed(rows: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """The same, bucketed and sorted by ``key``.

    There are as many buckets as a shuffle makes partitions, so joins on the key leave the
    table where it is.
    """
    spark = rows.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, key).sortBy(key).options(**STEP_OPTIONS, path=path).saveAsTable(name)

    def forget() -> None:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)

    return spark.table(name), forget


def held_out(key: Column) -> Column:
    """Rows that no model learns from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def encoded(text: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, empty for null."""
    return [value or b"" for value in text.cast(pa.binary()).to_pylist()]


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Maps Arrow batches to columns given as a dict in the order of ``schema``."""
    target = arrow_schema(schema)
    names = target.names

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                found = work(batch)
                yield pa.RecordBatch.from_arrays([column(found[n], target.field(n).type) for n in names], schema=target)

    return df.mapInArrow(run, schema)


def column(values: object, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each component of a graph on ``0..n-1`` that fits one task."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        live = low < high
        if not live.any():
            break
        left, right = left[live], right[live]
        np.minimum.at(label, high[live], low[live])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label
