"""Settings per sheet: precedence, grouping and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.operators.ranges import seq_ranges


def resolve_settings(
    rows: DataFrame, overrides: DataFrame, run_defaults: DataFrame, call: dict[str, object] | None = None,
    run: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Settings of every sheet: its own, else those of the call, else of the run, else the fixed ones.

    Overrides are folded to one row per sheet first, doubles to the greatest value, so
    that reruns agree; ``override_problems`` lists them. Neither side is broadcast by hand: both grow with the sheets.
    """
    call = call or {}
    fixed = {"dpi": C.DEFAULT_DPI, "diff_strictness": C.DEFAULT_STRICTNESS, "stroke_tol": C.DEFAULT_TOLERANCE_PX}
    own = overrides.groupBy(*run, "seq").agg(*[F.max(n).alias(f"own_{n}") for n in fixed])
    defaults = run_defaults.select(*run, *[F.col(n).alias(f"run_{n}") for n in fixed])
    joined = rows.join(own, [*run, "seq"], "left").join(defaults, list(run), "left")
    resolved = {
        n: F.coalesce(F.col(f"own_{n}"), F.lit(call.get(n)), F.col(f"run_{n}"), F.lit(value)) for n, value in fixed.items()
    }
    return joined.withColumns(resolved).drop(*[f"own_{n}" for n in fixed], *[f"run_{n}" for n in fixed])


def override_problems(rows: DataFrame, overrides: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Overrides given twice for a sheet, and overrides for sheets the run does not have."""
    keys = [*run, "seq"]
    doubles = overrides.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(
        *keys, F.lit("page_settings_duplicate").alias("error_key")
    )
    unknown = overrides.select(*keys).distinct().join(rows.select(*keys), keys, "left_anti").select(
        *keys, F.lit("page_not_in_report").alias("error_key")
    )
    return doubles.unionByName(unknown)


def group_page_settings(overrides: DataFrame, names: Sequence[str], run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sheets of a run that share their settings, as ranges of numbers with the number of sheets (first, last, n)."""
    ranges = seq_ranges(overrides, [*run, *names])
    return ranges.withColumn("n", F.col("last") - F.col("first") + 1)
