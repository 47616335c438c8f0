"""Counts, orders and report rows over detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.functions import severity as V
from sheetdelta.operators.ordered import position
from sheetdelta.operators.ranges import seq_ranges

_BUCKET = 4096


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def summarize_pairs(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows per status and per level; a size mismatch counts only in the total."""
    status, level = F.col("status"), F.col("change_level")
    return details.groupBy(*run).agg(
        F.count("*").alias("total"),
        *[_n(status == s).alias(s) for s in ("matched", "added", "removed")],
        *[_n(level == name).alias(name) for name in C.LEVELS],
    )


def summary_counts(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts in which a size mismatch is matched and changed."""
    status = F.col("status")
    matched = ~status.isin("added", "removed")
    unchanged = (status == "matched") & (F.coalesce("change_level", F.lit("")) == "unchanged")
    return details.groupBy(*run).agg(
        _n(matched).alias("matched"), _n(status == "added").alias("added"), _n(status == "removed").alias("removed"),
        (_n(matched) - _n(unchanged)).alias("changed"), _n(unchanged).alias("unchanged"),
    )


def engineer_counts(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts per level over matched rows only, size mismatches apart."""
    status, level = F.col("status"), F.col("change_level")
    return details.groupBy(*run).agg(
        *[_n(status == s).alias(s) for s in ("matched", "added", "removed", "size_mismatch")],
        *[_n((status == "matched") & (level == name)).alias(name) for name in C.LEVELS],
    )


def with_status(details: DataFrame) -> DataFrame:
    """Detail rows with page status, confidence, moved flag, simple status and distribution key."""
    row = V.detail_columns()
    tagged = details.withColumn("_s", V.status_and_confidence(row)).select(*details.columns, "_s.*")
    level_tag = F.when(
        F.col("status").isin("added", "removed"), F.lit("")
    ).otherwise(V.report_tags(F.col("change_level"))["level_tag"])
    bar_status = (
        F.when(F.col("status") == "added", "ADDED").when(F.col("status") == "removed", "REMOVED")
        .otherwise(V.report_tags(F.col("change_level"))["status_tag"])
    )
    return tagged.withColumns(
        {
            "simple_status": V.simple_status(F.col("status"), F.col("content_status")),
            "bar_status": bar_status,
            "dist_key": V.distribution_key(bar_status, level_tag),
        }
    )


def report_counts(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts of the report; removed sheets are also changed ones."""
    simple = F.col("simple_status")
    return with_status(details).groupBy(*run).agg(
        _n(simple == "UNCHANGED").alias("unchanged"), _n(simple == "CHANGED").alias("changed"),
        _n(simple == "NEW").alias("new"), _n(F.col("status") == "removed").alias("removed"),
        _n(F.col("moved")).alias("moved"),
    )


def dashboard_counts(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Disjoint counts by page status."""
    bar = F.col("bar_status")
    return with_status(details).groupBy(*run).agg(
        *[_n(bar == name).alias(name.lower()) for name in ("CHANGED", "ADDED", "REMOVED", "UNCHANGED")]
    )


def severity_distribution(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Count and percent per distribution key in the report's order, empty groups left out."""
    wide = with_status(details).groupBy(*run).agg(
        F.count("*").alias("total"),
        *[_n(F.col("dist_key") == key).alias(key) for key in C.DISTRIBUTION_ORDER],
    )
    parts = F.array(
        *[
            F.struct(F.lit(i + 1).alias("place"), F.lit(key).alias("dist_key"), F.col(key).alias("n"))
            for i, key in enumerate(C.DISTRIBUTION_ORDER)
        ]
    )
    return (
        wide.select(*run, "total", F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p"))
        .select(*run, "p.*", (100.0 * F.col("p.n") / F.col("total")).alias("percent"))
    )


def level_rank(dist_key: Column) -> Column:
    rank = F.lit(0)
    for name, value in C.LEVEL_SORT_RANK.items():
        rank = F.when(dist_key == name, value).otherwise(rank)
    return rank


def live_counts(page_map: DataFrame, details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts of the live view; pairs without a detail row are pending."""
    rows = attach_details(page_map, details, run)
    live = F.col("live_status")
    return rows.groupBy(*run).agg(
        *[_n(live == name).alias(name) for name in ("changed", "unchanged", "added", "removed", "pending")]
    )


def attach_details(page_map: DataFrame, details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """All pairs of the page map with their live status."""
    graded = details.select(
        *run, "seq", V.live_status(F.col("status"), F.col("change_level"))["live_status"].alias("live_status")
    )
    return page_map.select(*run, "seq").join(graded, [*run, "seq"], "left").fillna("pending", ["live_status"])


def elapsed_and_eta(details: DataFrame, totals: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Elapsed time, mean per page and the time the remaining pages will take."""
    done = details.groupBy(*run).agg(
        F.count("*").alias("done"), F.sum("elapsed_sec").alias("elapsed_sec"), F.avg("elapsed_sec").alias("mean_sec")
    )
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return totals.join(done, list(run)).select(
        *run, "total", "done", "elapsed_sec", "mean_sec", (F.col("elapsed_sec") / F.col("done") * left).alias("remaining_sec")
    )


def mixed_precision_flags(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Whether any sheet of a run has settings of its own, and how many; ``mixed_ranges`` says which."""
    return details.groupBy(*run).agg(F.bool_or("mixed_settings").alias("is_mixed"), _n(F.col("mixed_settings")).alias("mixed_count"))


def mixed_ranges(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sheets with settings of their own, as ranges of numbers (first, last)."""
    return seq_ranges(details.filter("mixed_settings"), run)


def view_order(details: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Position in the report: by page of the new revision, sheets without one last."""
    missing = F.col("b_page").isNull().cast("int")
    page = F.coalesce("b_page", F.lit(0))
    # along the order: the flag, the page, then runs of seq numbers
    bucket = F.struct(missing.alias("m"), page.alias("p"), F.floor(F.col("seq") / _BUCKET).alias("s"))
    return position(details, list(run), bucket, [missing, page, F.col("seq")], "view_order")


def matrix_order(details: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """Rows by a metric with nulls last and seq as tie-break; the percent of a sparse sheet is no value."""
    value = F.col(metric)
    if metric == "diff_foreground_percent":
        value = F.when(~F.coalesce(F.col("foreground_sparse"), F.lit(False)), value)
    if metric == "level":
        value = level_rank(with_status(details)["dist_key"])
    ordered = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return details.orderBy(ordered, F.col("seq"))


def engineer_order(details: DataFrame) -> DataFrame:
    """Sections of the engineer report: foreground percent, where that is 0 or missing the sheet percent."""
    weight = F.coalesce(F.nullif("diff_foreground_percent", F.lit(0.0)), F.nullif("diff_percent", F.lit(0.0)), F.lit(0.0))
    return details.withColumn("sort_value", weight).orderBy(F.col("sort_value").desc(), "seq")


def replace_rows(details: DataFrame, updates: DataFrame, keys: Sequence[str] = ("run_id", "seq")) -> DataFrame:
    """Details with the rows of ``updates`` in place of those with the same key."""
    return details.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)
