"""Expressions over run history records and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetdelta import config as C


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def coerce_float(value: Column, default: float) -> Column:
    """Number of a text field; blank or unreadable text gives the default."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(default))


def coerce_int(value: Column, default: int) -> Column:
    """As ``coerce_float``, cut to a whole number."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("double").cast("long"), F.lit(default))


def coerce_page(value: Column) -> Column:
    """Page number of a text field; null for blank, dash, text and fractions."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def coerce_bool(value: Column) -> Column:
    return F.lower(F.trim(_text(value))).isin(*C.TRUE_WORDS)


def validate_settings(dpi: Column, strictness: Column) -> Column:
    """Struct of dpi, strictness and the key of the first broken rule."""
    number = F.trim(dpi.cast("string")).try_cast("double")
    name = F.lower(F.trim(strictness))
    error = (
        F.when(number.isNull() | (number != F.floor(number)), "dpi_not_integer")
        .when((number < C.MIN_DPI) | (number > C.MAX_DPI), "dpi_out_of_range")
        .when(~name.isin(*C.STRICTNESS), "strictness_invalid")
    )
    return F.struct(
        F.when(error.isNull(), number.cast("long")).alias("dpi"),
        F.when(error.isNull(), name).alias("strictness"),
        error.alias("error_key"),
    )


def normalize_result(raw: Column) -> Column:
    """Folds the result words of both stores onto one vocabulary."""
    word = F.lower(F.trim(_text(raw)))
    known = F.lit(None).cast("string")
    for alias, result in C.RESULT_ALIASES.items():
        known = F.when(word == alias, result).otherwise(known)
    return F.coalesce(known, F.nullif(word, F.lit("")), F.lit("unknown"))


ID_FIELDS = ("ts", "old_pdf", "new_pdf", "out_dir", "run_dir", "result")


def stable_id(source: Column, record: dict[str, Column]) -> Column:
    """Job id of an agent row, else source and eight hex digits over six fields."""
    job = F.trim(_text(record["job_id"]))
    seed = F.concat_ws("|", *[_text(record[name]) for name in ID_FIELDS])
    hashed = F.concat(source, F.lit(":"), F.substring(F.sha1(seed.cast("binary")), 1, 8))
    return F.when((source == "mcp") & (job != ""), F.concat(F.lit("mcp:"), job)).otherwise(hashed)


def replay_settings(source: Column, record: dict[str, Column]) -> Column:
    """Settings needed to run a comparison again, under one naming for both stores."""
    ui = source == "ui"
    ui_gap = F.when(coerce_bool(record["bbox_merge"]), coerce_float(record["bbox_merge_gap"], C.UI_MERGE_GAP)).otherwise(0.0)
    return F.struct(
        coerce_int(record["dpi"], C.DEFAULT_DPI).alias("dpi"),
        coerce_float(record["stroke_tol"], C.DEFAULT_TOLERANCE_PX).alias("stroke_tol"),
        F.coalesce(F.nullif(record["diff_strictness"], F.lit("")), F.lit(C.DEFAULT_STRICTNESS)).alias("diff_strictness"),
        _text(record["exclude_regions"]).alias("exclude_regions"),
        F.when(ui, ui_gap)
        .otherwise(coerce_float(record["bbox_merge_gap_mm"], C.DEFAULT_MERGE_GAP_MM)).alias("bbox_merge_gap_mm"),
        F.when(ui, coerce_float(record["bbox_merge_max_ratio"], C.DEFAULT_MERGE_RATIO))
        .otherwise(coerce_float(record["bbox_merge_max_area_ratio"], C.DEFAULT_MERGE_RATIO))
        .alias("bbox_merge_max_area_ratio"),
        F.when(ui, coerce_bool(record["keep_debug"])).otherwise(coerce_bool(record["keep_debug_images"]))
        .alias("keep_debug_images"),
        coerce_bool(record["ignore_line_weight"]).alias("ignore_line_weight"),
    )


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.rtrim(_text(path), F.lit("/")), r"\\", "/"), "/", -1)
