"""Review tables: analysis cache, zone verdicts, manual overrides, highlights, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.functions import review as V
from sheetdelta.operators.ordered import position

CACHE_KEYS = ("provider", "model", "lang", "prompt_version", "seq")


def _newest(rows: DataFrame, keys: Sequence[str], body: Sequence[str]) -> DataFrame:
    """One row per key: the one with the newest ``updated`` stamp if there is such a column, ties by content."""
    own = F.struct(*body)
    stamp = F.struct(F.col("updated"), own) if "updated" in rows.columns else own
    return rows.groupBy(*keys).agg(F.max_by(own, stamp).alias("_newest")).select(*keys, "_newest.*")


def reuse_cached(rows: DataFrame, analysis: DataFrame, keys: Sequence[str] = CACHE_KEYS) -> DataFrame:
    """Cache state of every row: ``hit``, ``stale`` (other inputs than then) or ``miss``.

    An entry without text never counts; of several entries for one key the newest does.
    """
    entries = analysis.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    usable = _newest(entries, keys, ["fingerprint", "text"]).withColumnRenamed("fingerprint", "cached_fingerprint")
    joined = rows.join(usable, list(keys), "left")
    state = (
        F.when(F.col("cached_fingerprint").isNull(), "miss")
        .when(F.col("cached_fingerprint") == F.col("fingerprint"), "hit").otherwise("stale")
    )
    return joined.withColumn("state", state).withColumn("text", F.when(state == "hit", F.col("text"))).drop("cached_fingerprint")


def apply_overrides(zones: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual class over the AI class; unknown classes are ignored, the AI value is kept.

    Of several overrides for one zone the newest counts.
    """
    known = overrides.filter(F.col("classification").isin(*C.ZONE_CLASSES))
    valid = _newest(known, ["zone_key"], ["classification"]).withColumnRenamed("classification", "manual_classification")
    joined = zones.withColumnRenamed("classification", "ai_classification").join(valid, "zone_key", "left")
    return joined.withColumn("classification", F.coalesce("manual_classification", "ai_classification"))


def import_overrides(incoming: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides to take, with a known key and class, and those to skip."""
    known = F.coalesce(F.col("classification").isin(*C.ZONE_CLASSES), F.lit(False))
    keys = zones.select("zone_key").distinct()
    taken = incoming.filter(known).join(keys, "zone_key", "left_semi")
    skipped = incoming.filter(~known).unionByName(incoming.filter(known).join(keys, "zone_key", "left_anti"))
    return taken, skipped


def latest_state_wins(states: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """State with the newest update stamp per scope; the stored one wins a tie."""
    body = [c for c in states.columns if c not in keys]
    stamp = F.struct(F.coalesce("updated", F.lit(0)), -F.col("origin_rank"))
    return states.groupBy(*keys).agg(F.max_by(F.struct(*body), stamp).alias("s")).select(*keys, "s.*")


def verdict_counts(zones: DataFrame, sheet: Sequence[str] = ("seq",)) -> DataFrame:
    """Zones per class and sheet, and what the sheet shows at most."""
    count = lambda name: F.count_if(F.col("classification") == name).alias(name)
    per_sheet = zones.groupBy(*sheet).agg(*[count(name) for name in C.ZONE_CLASSES])
    kind = F.when(F.col("real_change") > 0, "real").when(F.col("uncertain") > 0, "uncertain").otherwise("clean")
    return per_sheet.withColumn("sheet_kind", kind)


def verdict_totals(per_sheet: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Totals over the sheets; a sheet may count as real and as uncertain."""
    return per_sheet.groupBy(*run).agg(
        *[F.sum(name).alias(name) for name in C.ZONE_CLASSES],
        F.count_if(F.col("real_change") > 0).alias("sheets_real"), F.count_if(F.col("uncertain") > 0).alias("sheets_uncertain"),
        F.count_if((F.col("real_change") == 0) & (F.col("uncertain") == 0)).alias("sheets_clean"),
    )


def top_zones(zones: DataFrame, k: int, sheet: Sequence[str] = ("doc_pair", "seq"), block: int = 1024) -> DataFrame:
    """The ``k`` largest boxes of every sheet, numbered from 1; ``k`` is at least 1.

    Blocks of a sheet are cut to their own ``k`` largest first, so a sheet with
    very many zones never meets in one task.
    """
    k = max(1, int(k))
    area = F.col("w") * F.col("h")
    order = [area.desc(), F.col("y"), F.col("x"), F.col("zone_id")]
    blocks = Window.partitionBy(*sheet, F.pmod(F.xxhash64("zone_id"), F.lit(block))).orderBy(*order)
    short = zones.withColumn("_n", F.row_number().over(blocks)).filter(F.col("_n") <= k).drop("_n")
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy(*sheet).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def highlight_items(zones: DataFrame, sheet: Sequence[str] = ("seq",)) -> DataFrame:
    """Distinct labels of a sheet, real changes before uncertain ones, in zone order (column place)."""
    label = V.zone_label(F.col("object_ref"), F.col("description"))
    rank = F.when(F.col("classification") == "real_change", 0).when(F.col("classification") == "uncertain", 1)
    first = (
        zones.withColumns({"label": label, "class_rank": rank}).filter("class_rank is not null and label <> ''")
        .groupBy(*sheet, "class_rank", "label").agg(F.min("zone_id").alias("zone_id"))
    )
    bucket = F.struct("class_rank", F.floor(F.col("zone_id") / 4096).alias("z"))
    return position(first, list(sheet), bucket, [F.col("class_rank"), F.col("zone_id")], "place")


def highlights(zones: DataFrame, k: int = C.HIGHLIGHTS_SHOWN, sheet: Sequence[str] = ("seq",)) -> DataFrame:
    """First ``k`` labels of a sheet with the number left out; noise zones for sheets without any."""
    items = highlight_items(zones, sheet)
    shown = items.groupBy(*sheet).agg(
        F.sort_array(F.collect_list(F.when(F.col("place") <= k, F.struct("place", "class_rank", "label")))).alias("shown"),
        F.count_if(F.col("place") > k).alias("more"),
    )
    noise = zones.groupBy(*sheet).agg(
        F.count_if(F.col("classification") == "alignment_or_rendering_noise").alias("noise")
    )
    return noise.join(shown, list(sheet), "left").select(
        *sheet, F.coalesce(F.col("shown.label"), F.array().cast("array<string>")).alias("labels"),
        F.coalesce("more", F.lit(0)).alias("more"), F.when(F.col("shown").isNull(), F.col("noise")).alias("noise_only"),
    )


def top_labels(zones: DataFrame, k: int = C.LABELS_SHOWN, sheet: Sequence[str] = ("seq",)) -> DataFrame:
    items = highlight_items(zones, sheet).filter(F.col("place") <= k)
    return items.groupBy(*sheet).agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("l")).select(
        *sheet, F.col("l.label").alias("labels")
    )


def usage_totals(results: DataFrame, run: Sequence[str]) -> DataFrame:
    """Tokens and charge of the results that were not cached, and how many results there are of each kind."""
    fresh = ~F.col("cached") & ~F.col("failed")
    paid = lambda c: F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).alias(c)
    return results.groupBy(*run).agg(
        *[paid(c) for c in ("prompt_tokens", "completion_tokens", "cached_prompt_tokens")],
        F.coalesce(F.sum(F.when(fresh, F.col("charge_usd"))), F.lit(0.0)).alias("charge_usd"),
        F.count_if(~F.col("failed")).alias("processed_count"),
        F.count_if(F.col("cached") & ~F.col("failed")).alias("cached_count"),
        F.count_if(F.col("failed")).alias("failed_count"),
    )


def verdict_report(zones: DataFrame, texts: DataFrame, k: int = 8, sheet: Sequence[str] = ("doc_pair", "seq")) -> DataFrame:
    """Zones of the analysed sheets with the description written for their place.

    The n-th numbered line belongs to the n-th largest zone. A zone without a
    line gets a stock text and a low confidence; a sheet without zones is judged
    as a whole.
    """
    described = texts.select(
        *sheet, "text", V.zone_descriptions(F.col("text")).alias("lines"), V.confidence(F.col("text")).alias("confidence")
    )
    joined = described.join(top_zones(zones, k, sheet), list(sheet), "left")
    written = F.get("lines", F.col("rank") - 1)
    whole = F.col("rank").isNull()
    text = F.when(whole, F.col("text")).otherwise(
        F.coalesce(written, F.concat(F.lit("Zone "), F.col("rank").cast("string")))
    )
    sure = F.when(whole | written.isNotNull(), F.col("confidence")).otherwise(
        F.least("confidence", F.lit(C.CONFIDENCE_FALLBACK_CAP))
    )
    return joined.select(
        *sheet, F.coalesce("rank", F.lit(1)).alias("id"), V.classify_description(text).alias("classification"),
        sure.alias("confidence"), text.alias("description"), "x", "y", "w", "h",
    )


def sheet_fingerprints(details: DataFrame, words: DataFrame, version: str, sheet: Sequence[str] = ("doc_pair", "seq")) -> DataFrame:
    """Fingerprint of everything a sheet's analysis depends on."""
    from sheetdelta.plans.compare import cell_digest

    cells = cell_digest(words, sheet).groupBy(*sheet).agg(
        F.concat_ws(",", F.max(F.when(F.col("rev") == "A", F.col("digest"))), F.max(F.when(F.col("rev") == "B", F.col("digest")))).alias("cells")
    )
    row_json = F.to_json(F.struct(*sorted(details.columns)))
    return details.join(cells, list(sheet), "left").select(
        *sheet, V.input_fingerprint(version, row_json, F.col("cells")).alias("fingerprint")
    )
