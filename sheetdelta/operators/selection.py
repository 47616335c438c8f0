"""Which sheets go to review, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetdelta.operators.ordered import position
from sheetdelta.operators.ranges import seq_ranges


def skip_reason(row_excluded: Column) -> Column:
    """First rule that keeps a row out of review, null for an eligible one."""
    status = F.col("status")
    return (
        F.when(row_excluded, "excluded")
        .when(status == "added", "added")
        .when(status == "removed", "removed")
        .when(F.col("a_page").isNull() | F.col("b_page").isNull(), "one_sided")
        .when(status != "matched", "not_matched")
        .when(F.coalesce("change_level", F.lit("")) == "unchanged", "unchanged")
        .when(
            (F.coalesce("diff_percent", F.lit(0.0)) <= 0) & (F.coalesce("bboxes_count", F.lit(0)) <= 0), "no_diff"
        )
    )


def select_for_review(details: DataFrame, excluded: DataFrame, run: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Every numbered row with its skip reason; rows without a number drop out."""
    keys = [*run, "seq"]
    marked = excluded.select(*keys).distinct().withColumn("_excluded", F.lit(True))
    rows = details.filter("seq is not null").join(marked, keys, "left")
    return rows.withColumn("skip_reason", skip_reason(F.coalesce("_excluded", F.lit(False)))).drop("_excluded")


def skip_reason_counts(selected: DataFrame, run: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Sheets per run and reason, as ranges of numbers with the number of sheets (first, last, n)."""
    ranges = seq_ranges(selected.filter("skip_reason is not null"), [*run, "skip_reason"])
    return ranges.withColumn("n", F.col("last") - F.col("first") + 1)


def restrict_seqs(rows: DataFrame, wanted: DataFrame | None, run: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return rows if wanted is None else rows.join(wanted.select(*run, "seq").distinct(), [*run, "seq"], "left_semi")


def limit_sheets(rows: DataFrame, n: int, run: tuple[str, ...] = ("run_id",), bucket: int = 4096) -> DataFrame:
    """First ``n`` sheets of every run by number; 0 keeps all."""
    if n <= 0:
        return rows
    numbered = position(rows, list(run), F.floor(F.col("seq") / bucket), [F.col("seq")], "_n")
    return numbered.filter(F.col("_n") <= n).drop("_n")
