"""Readers: sheets, run summaries, boxes, history stores and job event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetdelta.functions import text as T
from sheetdelta.functions.vectors import minmax_normalize
from sheetdelta.sources import schemas


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets from Parquet with tokens, mark and a normalised thumbnail as derived columns."""
    return describe_sheets(spark.read.parquet(path))


def describe_sheets(sheets: DataFrame) -> DataFrame:
    """Adds what the page text and raster imply: token set, sheet mark, normalised thumbnail."""
    return sheets.withColumns(
        {
            "tokens": T.page_tokens(F.col("text")),
            "sheet_mark": T.sheet_mark(F.col("text")),
            "thumb": minmax_normalize(F.col("thumb")),
        }
    )


def read_run_summaries(spark: SparkSession, root: str, inner: str = "_internal") -> DataFrame:
    """One summary per run folder: the ``inner`` folder wins over the older place beside it.

    Unreadable files are skipped.
    """
    found = None
    for priority, pattern in enumerate((f"*/{inner}/summary.json", "*/summary.json")):
        files = (
            spark.read.schema(schemas.RUN_SUMMARY + ", _corrupt_record string")
            .option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", False)
            .json(f"{root.rstrip('/')}/{pattern}")
            .withColumn("summary_path", F.input_file_name())
            .withColumn("priority", F.lit(priority))
        )
        found = files if found is None else found.unionByName(files)
    run_dir = F.regexp_replace("summary_path", rf"(/{inner})?/summary\.json$", "")
    readable = found.withColumn("run_dir", run_dir).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    newest = Window.partitionBy("run_dir").orderBy("priority")   # two rows at most
    return readable.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "priority")


def read_summary_lines(spark: SparkSession, path: str) -> DataFrame:
    """Summaries kept one per line, as a store of many runs has them; unreadable lines are skipped."""
    found = spark.read.schema(schemas.RUN_SUMMARY + ", _corrupt_record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return found.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def explode_pairs(summaries: DataFrame, pairs: str = "pairs", keys: tuple[str, ...] = ("run_dir",)) -> DataFrame:
    """Detail rows of the summaries; anything but a list counts as empty."""
    text = F.col(pairs)
    rows = F.from_json(F.when(F.ltrim(text).startswith("["), text), f"array<struct<{_as_struct(schemas.DETAIL)}>>")
    return summaries.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.*")


def _as_struct(ddl: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def read_boxes(df: DataFrame, boxes_json: str, keys: list[str]) -> DataFrame:
    """Boxes of a JSON list; malformed items and empty boxes drop out."""
    items = F.from_json(boxes_json, "array<struct<x:string,y:string,w:string,h:string>>")
    number = lambda name: F.col(f"item.{name}").try_cast("double").cast("long").alias(name)
    return (
        df.select(*keys, F.posexplode(items).alias("pos", "item"))
        .select(*keys, "pos", *[number(n) for n in ("x", "y", "w", "h")])
        .filter("x is not null and y is not null and w > 0 and h > 0")
    )


def read_history(spark: SparkSession, ui_path: str | None, agent_path: str | None) -> DataFrame:
    """Raw records of both stores with their source and append position.

    A store is a JSON document with a ``history`` list. A bad store is empty;
    list items that are not objects drop out.
    """
    parts = []
    for source, path in (("ui", ui_path), ("mcp", agent_path)):
        if path is None:
            continue
        raw = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", "struct<history:array<string>>")["history"]
        parts.append(
            raw.select(F.posexplode(listed).alias("append_pos", "raw"))
            .filter(F.ltrim("raw").startswith("{"))
            .select(
                F.lit(source).alias("source"), F.col("append_pos").cast("long").alias("append_pos"),
                F.from_json("raw", schemas.HISTORY_RECORD).alias("r"),
            )
            .filter("r is not null")
            .select("source", "append_pos", "r.*")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_job_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOB_EVENT).json(path)


def stream_job_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.JOB_EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)
