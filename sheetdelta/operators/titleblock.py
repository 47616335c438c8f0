"""Drawing ids read from the title block corner of a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.functions.text import is_drawing_id


def drawing_ids(words: DataFrame, sheets: DataFrame) -> DataFrame:
    """Adds the drawing id of each sheet: the one distinct code inside its bottom right corner.

    The code pattern is tested first, so that only code words reach the shuffle.
    ``words`` carries the sheet size in points.
    """
    per_mm = C.POINTS_PER_INCH / C.MM_PER_INCH
    left = F.greatest(F.lit(0.0), F.col("width_pt") - C.TITLE_BLOCK_MM[0] * per_mm)
    top = F.greatest(F.lit(0.0), F.col("height_pt") - C.TITLE_BLOCK_MM[1] * per_mm)
    in_corner = (
        (F.col("x1") > left) & (F.col("y1") > top) & (F.col("x0") < F.col("width_pt")) & (F.col("y0") < F.col("height_pt"))
    )
    code = F.upper("word")
    found = (
        words.filter(is_drawing_id(F.col("word")) & in_corner)
        .groupBy("doc_pair", "rev", "idx").agg(F.min(code).alias("low"), F.max(code).alias("high"))
        .filter("low = high").select("doc_pair", "rev", "idx", F.col("low").alias("drawing_id"))
    )
    return sheets.join(found, ["doc_pair", "rev", "idx"], "left")
