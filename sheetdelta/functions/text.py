"""Text and identity expressions. All are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetdelta import config as C

# (?U): word boundaries, digits and spaces follow Unicode; (?u): so does case folding
_ICASE = "(?iuU)"


def _blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def page_tokens(text: Column) -> Column:
    """Distinct upper-cased runs of three or more letters or digits."""
    found = F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, F.upper))


def normalize_mark(raw: Column) -> Column:
    bare = F.regexp_replace(F.upper(F.trim(raw)), r"(?U)[\s_]+", "")
    return F.replace(bare, F.lit("№"), F.lit(""))


def sheet_mark(text: Column) -> Column:
    """Sheet label of a page: Russian label, English label, then numerator of n/m."""
    first = [
        _blank_to_null(F.regexp_extract(text, flags + pattern, 1))
        for flags, pattern in (
            (_ICASE, C.SHEET_RU_PATTERN),
            (_ICASE, C.SHEET_EN_PATTERN),
            ("(?U)", C.SHEET_FRACTION_PATTERN),
        )
    ]
    return normalize_mark(F.coalesce(*first))


def mark_digits(mark: Column) -> Column:
    return F.regexp_replace(mark, "[^0-9]", "")


def mark_similarity(a: Column, b: Column) -> Column:
    """1 for equal marks, a fixed part for equal digits, else 0; a missing mark gives 0."""
    both = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    same_digits = (mark_digits(a) == mark_digits(b)) & (mark_digits(a) != "")
    return (
        F.when(~both, 0.0)
        .when(a == b, 1.0)
        .when(same_digits, C.MARK_DIGITS_SIMILARITY)
        .otherwise(0.0)
    )


def is_drawing_id(word: Column) -> Column:
    return F.upper(word).rlike(f"^(?:{C.DRAWING_ID_PATTERN})$")


def extract_revision(name: Column) -> Column:
    """Revision marker of a file name, prefix included, separators removed."""
    word = F.regexp_extract(name, _ICASE + C.REVISION_WORD_PATTERN, 1)
    tail = F.regexp_extract(name, _ICASE + C.REVISION_TAIL_PATTERN, 1)
    found = F.coalesce(_blank_to_null(word), _blank_to_null(tail))
    return F.upper(F.regexp_replace(found, "[-_ ]+", ""))


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(C.NAME_TOKEN_PATTERN), F.lit(0))


def name_prefix_tokens(left: Column, right: Column) -> Column:
    """Leading tokens of ``left`` that equal those of ``right`` ignoring case."""
    mine, other = name_tokens(left), name_tokens(right)
    same = F.zip_with(mine, other, lambda x, y: F.coalesce(F.lower(x) == F.lower(y), F.lit(False)))
    first_miss = F.array_position(same, F.lit(False))
    shared = F.when(first_miss == 0, F.size(same)).otherwise(first_miss - 1)
    return F.slice(mine, F.lit(1), shared.cast("int"))


def file_label(path: Column, fallback: str) -> Column:
    """Base name and trailing revision of a path, both falling back to a role name."""
    cleaned = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    name = F.when(cleaned == "", F.lit(fallback)).otherwise(F.substring_index(cleaned, "/", -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    revision = _blank_to_null(F.regexp_extract(stem, "(?iu)" + C.LABEL_REVISION_PATTERN, 1))
    return F.struct(name.alias("name"), F.coalesce(revision, F.lit(fallback)).alias("revision"))


def parse_progress(message: Column) -> Column:
    """``done / total`` of a status message; both null when the message has none."""
    pattern = r"(?U)(\d+)\s*/\s*(\d+)"
    return F.struct(
        _blank_to_null(F.regexp_extract(message, pattern, 1)).cast("long").alias("completed_pages"),
        _blank_to_null(F.regexp_extract(message, pattern, 2)).cast("long").alias("total_pages"),
    )
