"""Running values and positions over ordered groups that may be huge.

A plain window puts a whole group into one task. Here every group is cut into
buckets that follow the sort order; each bucket is scanned on its own and gets
the combined value of the buckets before it, which is a small per-bucket table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"min": F.least, "max": F.greatest}


@dataclass(frozen=True)
class Scan:
    """One running value: what is folded, how, from which end, and whether the row itself counts."""

    value: Column
    agg: str = "sum"
    reverse: bool = False
    inclusive: bool = True


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], scans: dict[str, Scan]) -> DataFrame:
    """Adds running values per ``keys`` in the ascending ``order``.

    ``bucket`` must be non-decreasing along ``order``; its size bounds the work
    of one task. All scans share one pass over the buckets and one join, so
    ``df`` is read twice however many there are.
    """
    names = list(scans)
    work = df.withColumn("__bucket", bucket).withColumns({f"__v_{n}": scans[n].value for n in names})

    totals = work.groupBy(*keys, "__bucket").agg(
        *[_AGGREGATES[scans[n].agg](f"__v_{n}").alias(f"__t_{n}") for n in names]
    )
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    earlier = {
        False: group.orderBy(F.col("__bucket").asc()).rowsBetween(Window.unboundedPreceding, -1),
        True: group.orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1),
    }
    before = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__kb"),
        *[_AGGREGATES[scans[n].agg](f"__t_{n}").over(earlier[scans[n].reverse]).alias(f"__before_{n}") for n in names],
    )

    bucketed = Window.partitionBy(*keys, "__bucket")
    frames = {
        (reverse, inclusive): bucketed.orderBy(*([c.desc() for c in order] if reverse else order)).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
        for reverse in (False, True) for inclusive in (False, True)
    }
    scanned = work.withColumns(
        {f"__in_{n}": _AGGREGATES[s.agg](f"__v_{n}").over(frames[s.reverse, s.inclusive]) for n, s in scans.items()}
    )
    same = scanned["__bucket"].eqNullSafe(before["__kb"])
    for key in keys:
        same = same & scanned[key].eqNullSafe(before[f"__k_{key}"])
    joined = scanned.join(before, same, "left")

    def merged(n: str) -> Column:
        first, rest = F.col(f"__before_{n}"), F.col(f"__in_{n}")
        if scans[n].agg == "sum":
            return F.coalesce(first, F.lit(0)) + F.coalesce(rest, F.lit(0))
        return _MERGE[scans[n].agg](first, rest)   # both skip nulls

    return joined.select(*df.columns, *[merged(n).alias(n) for n in names])


def position(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str) -> DataFrame:
    """1-based row number per ``keys`` along ``order``."""
    return running(df, keys, bucket, order, {out: Scan(F.lit(1).cast("long"))})
