"""Queries over zone reviews, caches and token costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import review as V
from sheetdelta.operators import cells as R
from sheetdelta.operators import review as O
from sheetdelta.plans.registry import query
from sheetdelta.sources.testviews import view_ctes

_T = view_ctes("zone_texts").rstrip()
_U = view_ctes("usage").rstrip()
_NOISE = " or ".join(f"contains(lower({{0}}), '{w}')" for w in ("шум", "сдвиг", "антиалиас", "идентич", "без измен", "не является"))
_UNSURE = " or ".join(f"contains(lower({{0}}), '{w}')" for w in ("неопредел", "неяс", "нельзя определить", "возможно", "предполож"))


def class_sql(text: str) -> str:
    return f"case when {_NOISE.format(text)} then 'alignment_or_rendering_noise' when {_UNSURE.format(text)} then 'uncertain' else 'real_change' end"


def label_sql() -> str:
    bare = "trim(replace(description, '**', ''))"
    return (
        f"case when trim(object_ref) <> '' then trim(object_ref) when strpos({bare}, ':') - 1 > 0 and strpos({bare}, ':') - 1 < 115 "
        f"then trim(substr({bare}, 1, strpos({bare}, ':') - 1)) else {bare} end"
    )


def zones_of(v):
    """Described zones of every conversation as one sheet each."""
    return v.view("zone_texts").withColumn("classification", V.classify_description(F.col("description")))


@query("p41_zone_key", _T + """ select distinct seq, zone_id, concat(seq, ':', sha256(concat('{"source":"s","seq":', seq, ',"id":', zone_id,
  ',"description":', to_json(description), ',"rect":{"x":1}}'))) as key from zone_texts""")
def p41(v):
    rect = F.struct(F.lit(1).alias("x"))
    key = V.zone_key(F.col("seq"), F.lit("s"), F.col("zone_id"), F.col("description"), rect)
    return v.view("zone_texts").select("seq", "zone_id", key.alias("key")).distinct()


@query("p42_input_fingerprint", view_ctes("cells", "dims").rstrip() + """,
lines as (select doc_pair, seq, rev, y, x // 64 as wx, sum((1::hugeint) << (x % 64)::integer) as raw from cells group by all),
words as (select doc_pair, seq, rev, md5(concat_ws(':', y, wx, case when raw >= 9223372036854775808::hugeint then raw - 18446744073709551616::hugeint else raw end)) as m from lines),
digests as (select doc_pair, seq, rev, concat_ws(':', sum(('0x' || substr(m, 1, 8))::bigint), sum(('0x' || substr(m, 9, 8))::bigint), count(*)) as digest from words group by all),
cells2 as (select doc_pair, seq, concat_ws(',', max(digest) filter (rev = 'A'), max(digest) filter (rev = 'B')) as c from digests group by all)
select doc_pair, seq, sha256(concat_ws(chr(10), '2', concat('{"doc_pair":"', doc_pair, '","height":', height, ',"seq":', seq, ',"width":', width, '}'), coalesce(c, ''))) as fingerprint
from dims left join cells2 using (doc_pair, seq)""")
def p42(v):
    details = v.view("dims").select("doc_pair", "seq", "width", "height")
    return O.sheet_fingerprints(details, R.pack(v.view("cells")), "2")


_LINES = r"""concat('Summary high', chr(10), ' 1. ', replace(text, chr(10), ' '), chr(10), '2) second ', role, chr(10), 'x 3. no', chr(10), '10.last')"""


def _answer():
    nl = F.lit("\n")
    return F.concat(
        F.lit("Summary high"), nl, F.lit(" 1. "), F.replace("text", nl, F.lit(" ")), nl, F.lit("2) second "), "role", nl,
        F.lit("x 3. no"), nl, F.lit("10.last"),
    )


@query("p43_zone_descriptions", r"""
select conv_id, turn, array_to_string(list_filter([trim(replace(text, chr(10), ' ')), concat('second ', role), 'last'], lambda s: s <> ''), '|') as lines from conversations""")
def p43(v):
    return v.table("conversations").select("conv_id", "turn", F.array_join(V.zone_descriptions(_answer()), "|").alias("lines"))


_CONF = "case turn % 5 when 0 then concat(text, ' Confidence: ', cast(turn * 30 as string)) when 1 then concat(text, ' УВЕРЕННОСТЬ : 55%') when 2 then concat('Высокая ', text) when 3 then concat('low ', text) else text end"


@query("p44_confidence", rf"""
select conv_id, turn, case when regexp_extract(t, '(?i)(?:уверенность|confidence)\s*:\s*(\d{{1,3}})', 1) <> ''
  then least(100, cast(regexp_extract(t, '(?i)(?:уверенность|confidence)\s*:\s*(\d{{1,3}})', 1) as integer))
  when contains(lower(t), 'высок') or contains(lower(t), 'high') then 90 when contains(lower(t), 'низк') or contains(lower(t), 'low') then 55 else 75 end as confidence
from (select conv_id, turn, {_CONF} as t from conversations)""")
def p44(v):
    return v.table("conversations").select("conv_id", "turn", V.confidence(F.expr(_CONF)).alias("confidence"))


@query("p45_classify_description", _T + f" select seq, zone_id, {class_sql('description')} as classification from zone_texts")
def p45(v):
    return zones_of(v).select("seq", "zone_id", "classification")


@query("p46_zone_label", _T + f" select seq, zone_id, {label_sql()} as label from zone_texts")
def p46(v):
    return v.view("zone_texts").select("seq", "zone_id", V.zone_label(F.col("object_ref"), F.col("description")).alias("label"))


_LATER = "case when event_id % 2 = 0 then at_ts + interval 971 days else at_ts end"
_PERIOD = f"""case when {_LATER} >= timestamp '2026-08-22 16:00:00' and isodow({_LATER} + interval 8 hours) >= 6 then 'off_peak'
  when hour({_LATER}) in (1, 2, 3, 6, 7, 8, 9) then 'peak' else 'off_peak' end"""


def _at():
    return F.when(F.col("event_id") % 2 == 0, F.col("at") + F.expr("interval 971 days")).otherwise(F.col("at"))


@query("p48_price_period", _U + f" select event_id, {_PERIOD} as period from usage")
def p48(v):
    return v.view("usage").select("event_id", V.price_period(_at()).alias("period"))


_COST = _U + f""", c as (select event_id, user_id, event_type, cached as was_cached, failed, greatest(0, prompt_tokens) as p, completion_tokens as o,
  least(greatest(0, prompt_tokens), cached_prompt_tokens) as h, {_PERIOD} as period from usage),
k as (select *, (h * 0.007e0 + (p - h) * 0.22e0 + o * 0.66e0) / 1e6 as off_peak_usd, (h * 0.014e0 + (p - h) * 0.44e0 + o * 1.32e0) / 1e6 as peak_usd from c),
cost as (select *, case when period = 'peak' then peak_usd else off_peak_usd end as direct_usd from k)"""


def _costs(v):
    usage = v.view("usage").withColumn("_at", _at())
    cost = V.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_prompt_tokens"), F.col("_at"))
    return usage.select("event_id", "user_id", "event_type", "cached", "failed", cost.alias("c"))


@query("p49_token_cost", _COST + """ select event_id, p as prompt_tokens, h as cached_prompt_tokens, o as completion_tokens, period, round(direct_usd, 9) as direct_usd,
  round(direct_usd * 0.055, 9) as fee_usd, round(direct_usd * 1.055, 9) as effective_usd, round(off_peak_usd, 9) as off_peak_usd, round(peak_usd, 9) as peak_usd from cost""")
def p49(v):
    rows = _costs(v).select("event_id", "c.*")
    return rows.select(*[F.round(c, 9).alias(c) if c.endswith("usd") else F.col(c) for c in rows.columns])


@query("a17_usage_totals", _COST + """ select user_id, cast(coalesce(sum(p) filter (not was_cached and not failed), 0) as bigint) as prompt_tokens,
  cast(coalesce(sum(o) filter (not was_cached and not failed), 0) as bigint) as completion_tokens, cast(coalesce(sum(h) filter (not was_cached and not failed), 0) as bigint) as cached_prompt_tokens,
  round(coalesce(sum(direct_usd) filter (not was_cached and not failed), 0), 6) as charge_usd, count(*) filter (not failed) as processed_count,
  count(*) filter (was_cached and not failed) as cached_count, count(*) filter (failed) as failed_count from cost group by user_id""")
def a17(v):
    rows = _costs(v).select(
        "user_id", "cached", "failed", "c.prompt_tokens", "c.completion_tokens", "c.cached_prompt_tokens", F.col("c.direct_usd").alias("charge_usd")
    )
    return O.usage_totals(rows, ["user_id"]).withColumn("charge_usd", F.round("charge_usd", 6))


@query("p50_usage_tokens", """
select event_id, case event_id % 4 when 0 then greatest(0, event_id - 50) when 1 then event_id % 77 else 0 end as cached_prompt_tokens,
  case when event_id % 3 = 0 then event_id % 11 else 0 end as reasoning_tokens from events""")
def p50(v):
    k = F.col("event_id")
    text = F.concat(
        F.lit('{"a":1'),
        F.when(k % 4 == 0, F.concat(F.lit(',"prompt_cache_hit_tokens":'), k - 50, F.lit(',"prompt_tokens_details":{"cached_tokens":5}')))
        .when(k % 4 == 1, F.concat(F.lit(',"prompt_tokens_details":{"cached_tokens":'), k % 77, F.lit("}")))
        .otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit(',"completion_tokens_details":{"reasoning_tokens":'), k % 11, F.lit("}"))).otherwise(""),
        F.lit("}"),
    )
    return v.table("events").select("event_id", V.usage_tokens(text).alias("u")).select("event_id", "u.*")


@query("a15_zone_coverage", """
select event_id, event_id % 3 = 1 and event_id % 5 = 3 or event_id % 3 = 0 and event_id % 5 = 0 as complete,
  case event_id % 3 when 0 then array_to_string(range(1, event_id % 5 + 1), ',') when 1 then array_to_string(list_filter(range(1, event_id % 5 + 1), lambda i: i > 3), ',')
    else array_to_string(list_filter(range(1, event_id % 5 + 1), lambda i: i <> 2), ',') end as missing,
  case event_id % 3 when 2 then '2' else '' end as duplicates,
  case event_id % 3 when 0 then '' when 1 then array_to_string(list_filter([1, 2, 3], lambda i: i > event_id % 5), ',')
    else array_to_string(list_filter([2, 9], lambda i: i > event_id % 5), ',') end as unknown
from events""")
def a15(v):
    k = F.col("event_id")
    block = lambda ids: F.lit("ok <zone_coverage_json> {\"zones\": [" + ",".join(f'{{"zone_id": {i}}}' for i in ids) + "]}\n</zone_coverage_json> end")
    text = F.when(k % 3 == 0, F.lit("no block")).when(k % 3 == 1, block(["1", '"2"', "3", "null"])).otherwise(block(["2", "2", "9", '"x"']))
    covered = v.table("events").select("event_id", V.zone_coverage(text, k % 5).alias("c")).select("event_id", "c.*")
    return covered.withColumns({n: F.array_join(n, ",") for n in ("missing", "duplicates", "unknown")})


_Z = _T + f""", zones as (select seq, zone_id, {class_sql('description')} as classification, {label_sql()} as label from zone_texts)"""
_COUNTS = """, per as (select seq, count(*) filter (classification = 'real_change') as real_change,
  count(*) filter (classification = 'alignment_or_rendering_noise') as alignment_or_rendering_noise, count(*) filter (classification = 'uncertain') as uncertain from zones group by seq)"""


@query("a16_verdict_counts", _Z + _COUNTS + " select *, case when real_change > 0 then 'real' when uncertain > 0 then 'uncertain' else 'clean' end as sheet_kind from per")
def a16(v):
    return O.verdict_counts(zones_of(v))


@query("a16_verdict_totals", _Z + _COUNTS + """ select cast(sum(real_change) as bigint) as real_change, cast(sum(alignment_or_rendering_noise) as bigint) as alignment_or_rendering_noise,
  cast(sum(uncertain) as bigint) as uncertain, count(*) filter (real_change > 0) as sheets_real, count(*) filter (uncertain > 0) as sheets_uncertain,
  count(*) filter (real_change = 0 and uncertain = 0) as sheets_clean from per""")
def a16b(v):
    return O.verdict_totals(O.verdict_counts(zones_of(v)))


_ITEMS = _Z + """, items as (select seq, case classification when 'real_change' then 0 else 1 end as r, label, min(zone_id) as z from zones
  where classification <> 'alignment_or_rendering_noise' and label <> '' group by all),
placed as (select *, row_number() over (partition by seq order by r, z) as place from items)"""


@query("w5_highlights", _ITEMS + """, s as (select seq, list(label order by place) filter (place <= 4) as l, count(*) filter (place > 4) as more from placed group by seq)
select z.seq, coalesce(array_to_string(any_value(l), '|'), '') as labels, coalesce(any_value(more), 0) as more,
  case when any_value(l) is null then count(*) filter (classification = 'alignment_or_rendering_noise') end as noise_only from zones z left join s using (seq) group by z.seq""")
def w5(v):
    return O.highlights(zones_of(v)).withColumn("labels", F.array_join("labels", "|"))


@query("w6_top_labels", _ITEMS + " select seq, array_to_string(list(label order by place) filter (place <= 3), '|') as labels from placed group by seq")
def w6(v):
    return O.top_labels(zones_of(v)).withColumn("labels", F.array_join("labels", "|"))


@query("w4_top_zones", view_ctes("zones") + """
select seq, zone_id, rank from (select seq, zone_id, row_number() over (partition by seq order by w * h desc, y, x, zone_id) as rank from zones) where rank <= 8""")
def w4(v):
    return O.top_zones(v.view("zones"), 8).select("seq", "zone_id", "rank")


@query("j9_reuse_cached", view_ctes("analysis").rstrip() + """
select d.doc_id as seq, case when a.fingerprint is null then 'miss' when a.fingerprint = sha256(d.text) then 'hit' else 'stale' end as state
from documents d left join analysis a on a.seq = d.doc_id and a.provider = 'prov' and a.model = 'main' and a.lang = 'en' and a.prompt_version = 2 and trim(a.text) <> ''""")
def j9(v):
    rows = v.table("documents").select(
        F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("fingerprint"), F.lit("prov").alias("provider"),
        F.lit("main").alias("model"), F.lit("en").alias("lang"), F.lit(2).alias("prompt_version"),
    )
    return O.reuse_cached(rows, v.view("analysis")).select("seq", "state")


_OVER = "select doc_id, case when quality = 0 then 'uncertain' when toxic = 1 then 'alignment_or_rendering_noise' when doc_id % 7 = 0 then 'nonsense' else 'real_change' end as classification from labels"


def _override_tables(v):
    labels = v.table("labels")
    value = (
        F.when(F.col("quality") == 0, "uncertain").when(F.col("toxic") == 1, "alignment_or_rendering_noise")
        .when(F.col("doc_id") % 7 == 0, "nonsense").otherwise("real_change")
    )
    zones = v.table("documents").select(
        F.col("doc_id").cast("string").alias("zone_key"), V.classify_description(F.col("text")).alias("classification")
    )
    return zones, labels.select(F.col("doc_id").cast("string").alias("zone_key"), value.alias("classification"))


@query("j12_apply_overrides", f"""
with o as ({_OVER}) select cast(d.doc_id as string) as zone_key, {class_sql('text')} as ai_classification, o.classification as manual_classification,
  coalesce(o.classification, {class_sql('text')}) as classification from documents d left join o on o.doc_id = d.doc_id and o.classification <> 'nonsense'""")
def j12(v):
    return O.apply_overrides(*_override_tables(v))


@query("j13_import_overrides", f"""
with o as ({_OVER} union all select doc_id + 10000000, 'real_change' from labels) select doc_id as zone_key, classification <> 'nonsense' and doc_id < 10000000 as taken from o""")
def j13(v):
    zones, overrides = _override_tables(v)
    strangers = v.table("labels").select(
        (F.col("doc_id") + 10000000).cast("string").alias("zone_key"), F.lit("real_change").alias("classification")
    )
    taken, skipped = O.import_overrides(overrides.unionByName(strangers), zones)
    return taken.withColumn("taken", F.lit(True)).unionByName(skipped.withColumn("taken", F.lit(False))).select(
        F.col("zone_key").cast("long").alias("zone_key"), "taken"
    )


@query("j14_latest_state_wins", """
select user_id as scope, arg_max(event_id, (epoch_us(ts) // 3600000000, -(event_id % 2), event_id)) as event_id from events group by user_id""".replace("(epoch_us(ts) // 3600000000, -(event_id % 2), event_id)", "[epoch_us(ts) // 3600000000, -(event_id % 2) * 1000000000 + event_id]"))
def j14(v):
    states = v.table("events").select(
        F.col("user_id").alias("scope"), F.floor(F.unix_timestamp("ts") / 3600).alias("updated"),
        ((F.col("event_id") % 2) * 1000000000 - F.col("event_id")).alias("origin_rank"), "event_id",
    )
    return O.latest_state_wins(states).select("scope", "event_id")


_TOP = view_ctes("zones", "zone_texts").rstrip() + f""",
texts as (select c.conv_id * 1000 + c.turn as k, c.conv_id % (select count(*) from supplier) as seq, {_LINES} as text, row_number() over (partition by c.conv_id % (select count(*) from supplier) order by c.conv_id, c.turn) as n, text as body, role from conversations c),
one as (select seq, text, list_filter([trim(replace(body, chr(10), ' ')), concat('second ', role), 'last'], lambda s: s <> '') as lines from texts where n = 1),
top as (select * from (select seq, zone_id, x, y, w, h, row_number() over (partition by seq order by w * h desc, y, x, zone_id) as rank from zones) where rank <= 8),
j as (select one.seq, coalesce(rank, 1) as id, rank, x, y, w, h, case when rank is null then text else coalesce(lines[rank], concat('Zone ', rank)) end as description, rank is null or lines[rank] is not null as written from one left join top using (seq))
select seq, id, x, y, w, h, description, {class_sql('description')} as classification, case when written then 90 else 60 end as confidence from j"""


@query("m15_verdict_report", _TOP)
def m15(v):
    v.table("supplier").createOrReplaceTempView("testview_supplier")
    v.table("conversations").createOrReplaceTempView("testview_conversations")
    spread = v.spark.sql("select *, conv_id % (select count(*) from testview_supplier) as seq from testview_conversations")
    first = (
        spread.withColumn("answer", _answer())
        .groupBy("seq").agg(F.min_by("answer", F.struct("conv_id", "turn")).alias("text"))
        .withColumn("doc_pair", F.lit("lattice"))
    )
    return O.verdict_report(v.view("zones"), first).drop("doc_pair")
