"""Sheet lists as ranges of numbers, so that no row holds all sheets of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta.session import cut

#: Numbers of a block that one task folds.
BLOCK = 4096


def seq_ranges(rows: DataFrame, keys: Sequence[str], seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """(keys, first, last): maximal runs of neighbouring numbers of each group; doubles count once, nulls not.

    Each block of numbers is folded on its own. Only ranges that reach a border of their block,
    two per block at most, are put together along the group; all others are whole already.
    """
    own = rows.filter(F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("long").alias("_seq")).distinct()
    own = own.withColumn("_block", F.floor(F.col("_seq") / block))
    island = F.col("_seq") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_seq"))
    folded = cut(own.withColumn("_island", island).groupBy(*keys, "_block", "_island").agg(
        F.min("_seq").alias("first"), F.max("_seq").alias("last")).select(*keys, "first", "last"))
    border = (F.pmod("first", F.lit(block)) == 0) | (F.pmod("last", F.lit(block)) == block - 1)
    order = Window.partitionBy(*keys).orderBy("first")
    starts = F.coalesce(F.lag("last").over(order) + 1 < F.col("first"), F.lit(True)).cast("long")
    chained = folded.filter(border).withColumn("_start", starts).withColumn("_run", F.sum("_start").over(order))
    joined = chained.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return folded.filter(~border).unionByName(joined.select(*keys, "first", "last"))


def range_text(first: Column, last: Column) -> Column:
    """A range as text: ``4`` or ``4-9``."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
