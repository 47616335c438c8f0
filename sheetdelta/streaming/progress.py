"""Live views over running comparisons. Every function takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetdelta.functions import severity as V


def _live(details: DataFrame) -> Column:
    return V.live_status(F.col("status"), F.col("change_level"))["live_status"]


def live_progress(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Finished pages per live status (T1). Update or complete mode; state is one row per run."""
    live = _live(details)
    return details.groupBy(*run).agg(
        F.count("*").alias("done"), *[F.count_if(live == s).alias(s) for s in ("changed", "unchanged", "added", "removed")]
    )


def live_page_stream(details: DataFrame, page_map: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """One view row per finished page (T2). Append mode; the page map is the static side."""
    rows = details.select(*run, "seq", _live(details).alias("live_status"), "change_level")
    return rows.join(page_map.select(*run, "seq", "a_idx", "b_idx"), [*run, "seq"])


def eta_stream(details: DataFrame, totals: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Remaining time from the mean time of the finished pages (T6)."""
    done = details.groupBy(*run).agg(F.count("*").alias("done"), F.sum("elapsed_sec").alias("elapsed_sec"))
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return done.join(totals, list(run)).select(
        *run, "total", "done", "elapsed_sec", (F.col("elapsed_sec") / F.col("done") * left).alias("remaining_sec")
    )
