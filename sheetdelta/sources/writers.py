"""Writers: page map files, report documents, replaced detail rows, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.operators.report import replace_rows
from sheetdelta.session import cut


def page_map_rows(details: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The page map columns in order; columns the details lack are blank."""
    have = set(details.columns)
    return details.select(
        *keep, *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in C.PAGE_MAP_COLUMNS]
    )


def write_page_map(details: DataFrame, path: str, run: Sequence[str] = ("run_id",)) -> None:
    """One CSV folder per run with a header, rows by number inside each file."""
    rows = page_map_rows(details, run)
    rows.sortWithinPartitions(*run, "seq").write.mode("overwrite").partitionBy(*run).option("header", True).csv(path)


#: Pages, or ranges of sheets, of one part of a report.
REPORT_PART = 1000


def report_documents(pages: DataFrame, settings: DataFrame, run: Sequence[str] = ("run_id",), part: int = REPORT_PART) -> DataFrame:
    """Nested documents of each run, in parts: settings, counts and up to ``part`` pages in view order.

    Part 0 has the first pages; settings and counts stand in every part. The sheets with settings of their own are
    ranges, dealt to parts by their first number, so no row grows with the run.
    """
    from sheetdelta.operators.report import mixed_precision_flags, mixed_ranges, report_counts, view_order, with_status

    counts = report_counts(pages, run)
    flags = mixed_precision_flags(pages, run)
    listed = view_order(with_status(pages), run)
    body = listed.groupBy(*run, F.floor((F.col("view_order") - 1) / part).alias("part")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "view_order", "seq", "a_page", "b_page", "simple_status", "confidence", "moved", "change_level",
                    "diff_percent", "diff_foreground_percent", "bboxes_count",
                )
            )
        ).alias("pages")
    )
    names = ("unchanged", "changed", "new", "removed", "moved")
    ranges = mixed_ranges(pages, run)
    # as many parts as the pages make; a run of n sheets has fewer than n ranges
    parts = body.groupBy(*run).agg(F.max("part").alias("_last"))
    dealt = ranges.join(parts, list(run)).withColumn("part", F.pmod(F.floor(F.col("first") / part), F.col("_last") + 1))
    mixed = dealt.groupBy(*run, "part").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("mixed"))
    joined = body.join(counts, list(run)).join(flags, list(run)).join(settings, list(run), "left").join(mixed, [*run, "part"], "left")
    extra = [c for c in settings.columns if c not in run]
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return joined.select(
        *run, "part",
        F.struct(*extra, F.col("is_mixed").alias("is_mixed_precision"), F.coalesce("mixed", none).alias("mixed_precision")).alias("settings"),
        F.struct(F.struct(*names).alias("counts")).alias("summary"), "pages",
    )


def write_report_model(pages: DataFrame, settings: DataFrame, path: str, run: Sequence[str] = ("run_id",)) -> None:
    report_documents(pages, settings, run).write.mode("overwrite").json(path)


def write_replaced(details: DataFrame, updates: DataFrame, path: str, keys: Sequence[str] = ("run_id", "seq")) -> None:
    """Rewrites only the partitions of the runs that have updates."""
    run = keys[0]
    touched = details.join(updates.select(run).distinct(), [run], "left_semi")
    rows = cut(replace_rows(touched, updates, keys))   # the same folder is read and written
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def append_history(runs: DataFrame, path: str) -> None:
    """Appends records; the cap is applied when the history is read."""
    runs.write.mode("append").json(path)
