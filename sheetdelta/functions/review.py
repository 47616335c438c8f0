"""Expressions over zone reviews, analysis texts and token costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetdelta import config as C


def zone_key(seq: Column, source: Column, zone_id: Column, description: Column, rect: Column) -> Column:
    """Stable key of a zone; built on the original rectangle so that edits do not move it."""
    body = F.to_json(
        F.struct(
            source.alias("source"), seq.alias("seq"), zone_id.alias("id"),
            description.alias("description"), rect.alias("rect"),
        )
    )
    return F.concat(seq.cast("string"), F.lit(":"), F.sha2(body, 256))


def input_fingerprint(version: str, row_json: Column, cells_digest: Column) -> Column:
    """Changes with any input of a sheet: version, detail row, cells."""
    return F.sha2(F.concat_ws("\n", F.lit(version), row_json, F.coalesce(cells_digest, F.lit(""))), 256)


def zone_descriptions(text: Column) -> Column:
    """Texts of numbered lines (``1. ...`` or ``1) ...``) in order."""
    pattern = r"(?U)^\s*\d+[.)]\s*(.+)"
    lines = F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    found = F.transform(lines, lambda line: F.trim(F.regexp_extract(line, pattern, 1)))
    return F.filter(found, lambda t: t != "")


def confidence(text: Column) -> Column:
    lowered = F.lower(text)
    explicit = F.nullif(F.regexp_extract(text, "(?iuU)" + C.CONFIDENCE_PATTERN, 1), F.lit("")).cast("int")
    return (
        F.when(explicit.isNotNull(), F.least(explicit, F.lit(100)))
        .when(lowered.contains("высок") | lowered.contains("high"), C.CONFIDENCE_HIGH)
        .when(lowered.contains("низк") | lowered.contains("low"), C.CONFIDENCE_LOW)
        .otherwise(C.CONFIDENCE_PLAIN)
    )


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def classify_description(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(_has_any(lowered, C.NOISE_WORDS), "alignment_or_rendering_noise")
        .when(_has_any(lowered, C.UNCERTAIN_WORDS), "uncertain")
        .otherwise("real_change")
    )


def zone_label(object_ref: Column, description: Column) -> Column:
    """Object name of a zone, else its text up to an early colon."""
    reference = F.trim(F.coalesce(object_ref, F.lit("")))
    text = F.trim(F.replace(F.coalesce(description, F.lit("")), F.lit("**"), F.lit("")))
    colon = F.instr(text, ":") - 1
    short = F.when((colon > 0) & (colon < C.MAX_LABEL_COLON), F.substring(text, F.lit(1), colon)).otherwise(text)
    return F.when(reference != "", reference).otherwise(F.trim(short))


def price_period(at: Column) -> Column:
    """``peak`` or ``off_peak``; ``at`` is a timestamp, read in UTC.

    From the rule's start on, weekends eight hours east of UTC are off peak.
    """
    seconds = F.unix_timestamp(at)
    start = F.unix_timestamp(F.lit(C.WEEKEND_RULE_START_UTC + " +0000"), "yyyy-MM-dd HH:mm:ss Z")
    # day 0 of the epoch was a Thursday: Saturday and Sunday are days 2 and 3 of that week
    local_day = F.pmod(F.floor((seconds + C.WEEKEND_OFFSET_HOURS * 3600) / 86400), F.lit(7))
    hour = F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    in_peak = reduce(lambda a, b: a | b, [(hour >= lo) & (hour < hi) for lo, hi in C.PEAK_HOURS_UTC])
    return (
        F.when((seconds >= start) & local_day.isin(2, 3), "off_peak")
        .when(in_peak, "peak").otherwise("off_peak")
    )


def _cost(cached: Column, uncached: Column, completion: Column, period: str) -> Column:
    hit, miss, output = C.TOKEN_RATES[period]
    return (cached * hit + uncached * miss + completion * output) / 1e6


def token_cost(prompt: Column, completion: Column, cached: Column, at: Column) -> Column:
    """Token counts floored and clamped, and their cost in both periods and with the credit fee."""
    zero = F.lit(0).cast("long")
    prompt = F.greatest(zero, prompt.cast("long"))
    completion = F.greatest(zero, completion.cast("long"))
    cached = F.least(prompt, F.greatest(zero, cached.cast("long")))
    off_peak = _cost(cached, prompt - cached, completion, "off_peak")
    peak = _cost(cached, prompt - cached, completion, "peak")
    period = price_period(at)
    direct = F.when(period == "peak", peak).otherwise(off_peak)
    fee = direct * C.CREDIT_FEE_RATE
    return F.struct(
        prompt.alias("prompt_tokens"), cached.alias("cached_prompt_tokens"),
        completion.alias("completion_tokens"), period.alias("period"),
        direct.alias("direct_usd"), fee.alias("fee_usd"), (direct + fee).alias("effective_usd"),
        off_peak.alias("off_peak_usd"), peak.alias("peak_usd"),
    )


def usage_tokens(usage_json: Column) -> Column:
    """Cached prompt tokens (direct field first, else nested) and reasoning tokens."""
    direct = F.get_json_object(usage_json, "$.prompt_cache_hit_tokens").try_cast("long")
    nested = F.get_json_object(usage_json, "$.prompt_tokens_details.cached_tokens").try_cast("long")
    reasoning = F.get_json_object(usage_json, "$.completion_tokens_details.reasoning_tokens").try_cast("long")
    floor = lambda v: F.greatest(F.lit(0).cast("long"), v)
    return F.struct(
        floor(F.coalesce(direct, nested, F.lit(0))).alias("cached_prompt_tokens"),
        floor(F.coalesce(reasoning, F.lit(0))).alias("reasoning_tokens"),
    )


def zone_coverage(text: Column, zones_shown: Column) -> Column:
    """Which of the zones 1..n the coverage block of a text names; missing, duplicate and unknown ids."""
    body = F.regexp_extract(text, r"(?s)<zone_coverage_json>\s*(\{.*?\})\s*</zone_coverage_json>", 1)
    parsed = F.from_json(body, "struct<zones:array<struct<zone_id:string>>>")
    raw = F.transform(F.coalesce(parsed["zones"], F.array()), lambda z: F.trim(z["zone_id"]).try_cast("double").cast("long"))
    seen = F.filter(raw, lambda v: v.isNotNull())
    last = F.greatest(zones_shown.cast("long"), F.lit(0).cast("long"))
    expected = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    unique = F.array_sort(F.array_distinct(seen))
    duplicates = F.filter(unique, lambda v: F.size(F.filter(seen, lambda s: s == v)) > 1)
    unknown = F.array_except(unique, expected)
    missing = F.array_except(expected, unique)
    complete = (F.size(missing) == 0) & (F.size(duplicates) == 0) & (F.size(unknown) == 0)
    return F.struct(
        complete.alias("complete"), missing.alias("missing"), duplicates.alias("duplicates"), unknown.alias("unknown")
    )
