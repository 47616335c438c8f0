"""Severity grades, page status and notes as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetdelta import config as C


def _grade(value: Column, bounds: tuple[float, float, float]) -> Column:
    """Rank 0..3 of one signal."""
    return reduce(lambda acc, bound: acc + F.when(value >= bound, 1).otherwise(0), bounds, F.lit(0))


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in C.LEVELS]), rank + 1)


def _is_sparse(sparse: Column) -> Column:
    return F.coalesce(sparse, F.lit(False))


def signal_levels(fg_percent: Column, sparse: Column, region_mm2: Column, zones: Column) -> Column:
    """The signals that count for a page as (signal, value, level); empty for legacy rows."""
    count = F.coalesce(zones, F.lit(0)).cast("double")

    def signal(name: str, value: Column, bounds: tuple[float, float, float]) -> Column:
        return F.struct(
            F.lit(name).alias("signal"), value.cast("double").alias("value"),
            level_name(_grade(value, bounds)).alias("level"),
        )

    current = fg_percent.isNotNull()
    candidates = F.array(
        F.when(current & ~_is_sparse(sparse), signal("fg", fg_percent, C.FOREGROUND_BOUNDS)),
        F.when(current & region_mm2.isNotNull(), signal("region", region_mm2, C.REGION_BOUNDS_MM2)),
        F.when(current, signal("zones", count, C.ZONE_COUNT_BOUNDS)),
    )
    return F.array_compact(candidates)


def classify(diff_percent: Column, zones: Column, fg_percent: Column, sparse: Column, region_mm2: Column) -> Column:
    """Worst level over the signals; rows without foreground percent use the sheet percent."""
    count = F.coalesce(zones, F.lit(0))
    legacy = (
        F.when(diff_percent >= C.MODERATE_PERCENT, 3)
        .when(diff_percent >= C.MINOR_PERCENT, 2)
        .when((diff_percent >= C.UNCHANGED_PERCENT) | (count > 0), 1)
        .otherwise(0)
    )
    rank = F.greatest(
        F.when(_is_sparse(sparse), 0).otherwise(_grade(fg_percent, C.FOREGROUND_BOUNDS)),
        F.when(region_mm2.isNull(), 0).otherwise(_grade(region_mm2, C.REGION_BOUNDS_MM2)),
        _grade(count.cast("double"), C.ZONE_COUNT_BOUNDS),
    )
    return level_name(F.when(fg_percent.isNull(), legacy).otherwise(rank))


def report_tags(level: Column) -> Column:
    same = F.coalesce(level, F.lit("unchanged")) == "unchanged"
    return F.struct(
        F.when(same, "UNCHANGED").otherwise("CHANGED").alias("status_tag"),
        F.when(same, "UNCHANGED").otherwise(F.upper(level)).alias("level_tag"),
    )


def status_and_confidence(row: dict[str, Column]) -> Column:
    """Page status, match confidence, content status and moved flag of a detail row."""
    status, a_page, b_page = row["status"], row["a_page"], row["b_page"]
    moved = F.coalesce((a_page != 0) & (b_page != 0) & (a_page != b_page), F.lit(False))
    graded = F.when(
        row["diff_percent"].isNotNull(),
        classify(
            row["diff_percent"], row["bboxes_count"], row["diff_foreground_percent"],
            row["foreground_sparse"], row["max_region_area_mm2"],
        ),
    )
    content = report_tags(F.coalesce(row["change_level"], graded))["status_tag"]
    page_status = (
        F.when(status == "added", "ADDED").when(status == "removed", "REMOVED")
        .when(status == "size_mismatch", "CHANGED").otherwise(content)
    )
    score = F.coalesce(row["score"], F.lit(0.0))
    confidence = (
        F.when(status.isin("added", "removed", "size_mismatch"), "NONE")
        .when(score >= 0.98, "EXACT").when(score >= 0.75, "PROBABLE").otherwise("NONE")
    )
    return F.struct(
        page_status.alias("page_status"), confidence.alias("confidence"),
        page_status.alias("content_status"),
        (moved & ~status.isin("added", "removed")).alias("moved"),
    )


def page_notes(row: dict[str, Column], content_status: Column) -> Column:
    """Notes of a page as (kind, key, x, y): one summary or warning, then an info note."""
    status = row["status"]
    none = F.lit(None).cast("double")

    def note(kind: str, key: str, x: Column = none, y: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(key).alias("key"), x.alias("x"), y.alias("y")
        )

    area = F.coalesce(row["diff_area_mm2"], F.lit(0.0))
    without_percent = _is_sparse(row["foreground_sparse"]) | row["diff_foreground_percent"].isNull()
    first = (
        F.when(status == "added", note("summary", "new_only"))
        .when(status == "removed", note("summary", "removed_in_new"))
        .when(status == "size_mismatch", note("warn", "size_mismatch"))
        .when(content_status == "UNCHANGED", note("summary", "no_significant"))
        .when(without_percent, note("summary", "visual_changes_sparse", area))
        .otherwise(note("summary", "visual_changes", row["diff_foreground_percent"], area))
    )
    dx = F.coalesce(row["alignment_shift_x_mm"], F.lit(0.0))
    dy = F.coalesce(row["alignment_shift_y_mm"], F.lit(0.0))
    second = F.when(F.coalesce(row["ecc_failed"], F.lit(False)), note("info", "registration_failed")).when(
        F.sqrt(dx * dx + dy * dy) >= 0.2, note("info", "alignment_shift", dx, dy)
    )
    return F.array_compact(F.array(first, second))


def live_status(status: Column, level: Column) -> Column:
    """Status and level class of the live view; a size mismatch shows as a major change."""
    mismatch = (status == "size_mismatch") | (F.coalesce(level, F.lit("")) == "size_mismatch")
    tags = report_tags(level)
    unchanged = tags["status_tag"] == "UNCHANGED"
    return F.struct(
        F.when(status.isin("added", "removed"), status)
        .when(mismatch, "changed").when(unchanged, "unchanged").otherwise("changed").alias("live_status"),
        F.when(status.isin("added", "removed"), status)
        .when(mismatch, "major").otherwise(F.lower(tags["level_tag"])).alias("level_class"),
    )


def simple_status(status: Column, content_status: Column) -> Column:
    """NEW, CHANGED or UNCHANGED; a removed sheet counts as CHANGED."""
    return (
        F.when(status == "added", "NEW").when(status == "removed", "CHANGED")
        .when(content_status == "UNCHANGED", "UNCHANGED").otherwise("CHANGED")
    )


def distribution_key(page_status: Column, level_tag: Column) -> Column:
    return F.when((page_status == "CHANGED") & (F.coalesce(level_tag, F.lit("")) != ""), level_tag).otherwise(page_status)


def detail_columns() -> dict[str, Column]:
    """The detail row columns the status expressions read."""
    names = (
        "status", "a_page", "b_page", "score", "diff_percent", "bboxes_count", "diff_foreground_percent",
        "foreground_sparse", "max_region_area_mm2", "diff_area_mm2", "change_level", "ecc_failed",
        "alignment_shift_x_mm", "alignment_shift_y_mm",
    )
    return {name: F.col(name) for name in names}
