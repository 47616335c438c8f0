"""Compatibility and score of two sheets as Column expressions.

``a`` and ``b`` name struct columns with thumb, tokens, sheet_mark, width_pt
and height_pt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.functions.text import mark_similarity
from sheetdelta.functions.vectors import text_similarity, visual_similarity


def _aspect_gap(a: Column, b: Column) -> Column:
    """Relative difference of the aspects; null where a side is 0."""
    left, right = F.try_divide(a["width_pt"], a["height_pt"]), F.try_divide(b["width_pt"], b["height_pt"])
    return F.try_divide(F.abs(left - right), F.greatest(left, right))


def size_compatible(a: Column, b: Column) -> Column:
    area_a, area_b = a["width_pt"] * a["height_pt"], b["width_pt"] * b["height_pt"]
    ratio = F.try_divide(F.least(area_a, area_b), F.greatest(area_a, area_b))
    ok = (ratio >= C.MIN_AREA_RATIO) & (_aspect_gap(a, b) <= C.MAX_ASPECT_DELTA)
    return F.coalesce((area_a > 0) & (area_b > 0) & ok, F.lit(False))


def has_mark(mark: Column) -> Column:
    return F.coalesce(F.length(mark), F.lit(0)) > 0


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["tokens"], b["tokens"]))


def cross_size_compatible(a: Column, b: Column) -> Column:
    """Same drawing on another paper size: numbers first, array work only behind them."""
    marks = has_mark(a["sheet_mark"]) & has_mark(b["sheet_mark"])
    conflict = marks & (mark_similarity(a["sheet_mark"], b["sheet_mark"]) == 0.0)
    sides = F.least(a["width_pt"], a["height_pt"], b["width_pt"], b["height_pt"])
    cheap = F.coalesce((sides > 0) & (_aspect_gap(a, b) <= C.MAX_ASPECT_DELTA) & ~conflict, F.lit(False))
    costly = (
        (shared_tokens(a, b) >= C.MIN_SHARED_TOKENS)
        & (text_similarity(a["tokens"], b["tokens"]) >= C.MIN_CROSS_TEXT)
        & (visual_similarity(a["thumb"], b["thumb"]) >= C.MIN_CROSS_VISUAL)
    )
    return F.when(cheap, costly).otherwise(False)


def pages_compatible(a: Column, b: Column) -> Column:
    return F.when(size_compatible(a, b), True).otherwise(cross_size_compatible(a, b))


def pair_score(a: Column, b: Column) -> Column:
    """Score of a compatible pair; marks on both sides add a bonus or a penalty."""
    visual = visual_similarity(a["thumb"], b["thumb"])
    with_text = (F.size(a["tokens"]) > 0) | (F.size(b["tokens"]) > 0)
    base = F.when(
        with_text, C.VISUAL_WEIGHT * visual + C.TEXT_WEIGHT * text_similarity(a["tokens"], b["tokens"])
    ).otherwise(visual)
    marks = mark_similarity(a["sheet_mark"], b["sheet_mark"])
    bonus = (
        F.when(~(has_mark(a["sheet_mark"]) & has_mark(b["sheet_mark"])), 0.0)
        .when(marks >= 0.99, C.MARK_SAME_BONUS)
        .when(marks >= 0.60, C.MARK_DIGITS_BONUS)
        .otherwise(-C.MARK_CONFLICT_PENALTY)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus))
