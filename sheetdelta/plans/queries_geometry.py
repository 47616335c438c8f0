"""Queries over sizes, regions and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import geometry as G
from sheetdelta.functions import records as H
from sheetdelta.plans.registry import query
from sheetdelta.sources.testviews import view_ctes

_R = view_ctes("regions")
_UNIT = "case when lower(unit) in ('px') then {px} when lower(unit) in ('mm') then {mm} when lower(unit) = 'percent' then {pc} else {ra} end"
_ANCHOR = """case when lower(replace(anchor, '-', '_')) in ('top_left', 'left_top', 'tl') then 'top_left'
  when lower(replace(anchor, '-', '_')) in ('top_right', 'right_top', 'tr') then 'top_right'
  when lower(replace(anchor, '-', '_')) in ('bottom_left', 'left_bottom', 'bl') then 'bottom_left'
  when lower(replace(anchor, '-', '_')) in ('bottom_right', 'right_bottom', 'br') then 'bottom_right' end"""


def _scaled_sql(value: str, extent: str, px: str, mm: str) -> str:
    return _UNIT.format(px=f"{value} * {px}", mm=f"{value} * {mm}", pc=f"{extent} * {value} * 0.01e0", ra=f"{extent} * {value}")


def _cols(*names: str):
    return [F.col(n) for n in names]


@query("p12_effective_dpi", view_ctes("sheets_base", "partners") + """
select p.doc_pair, p.k as idx, least(
  case when 600e0 * a.width_pt / 72 * (600e0 * a.height_pt / 72) / 1e6 <= 40 then 600e0 else 600e0 * sqrt(40 / (600e0 * a.width_pt / 72 * (600e0 * a.height_pt / 72) / 1e6)) end,
  case when 600e0 * b.width_pt / 72 * (600e0 * b.height_pt / 72) / 1e6 <= 40 then 600e0 else 600e0 * sqrt(40 / (600e0 * b.width_pt / 72 * (600e0 * b.height_pt / 72) / 1e6)) end) as dpi
from partners p join sheets_base a on a.doc_pair = p.doc_pair and a.idx = p.ka and a.rev = 'A' join sheets_base b on b.doc_pair = p.doc_pair and b.idx = p.kb and b.rev = 'B'""")
def p12(v):
    s = v.view("sheets_base")
    a = s.filter("rev = 'A'").select("doc_pair", F.col("idx").alias("ka"), F.col("width_pt").alias("wa"), F.col("height_pt").alias("ha"))
    b = s.filter("rev = 'B'").select("doc_pair", F.col("idx").alias("kb"), F.col("width_pt").alias("wb"), F.col("height_pt").alias("hb"))
    return v.view("partners").join(a, ["doc_pair", "ka"]).join(b, ["doc_pair", "kb"]).select(
        "doc_pair", F.col("k").alias("idx"), G.pair_dpi(*_cols("wa", "ha", "wb", "hb"), F.lit(600)).alias("dpi")
    )


@query("p13_px_to_mm", _R + "select region_no, 25.4e0 / dpi as mm, (25.4e0 / dpi) * (25.4e0 / dpi) as mm2 from regions")
def p13(v):
    return v.view("regions").select(
        "region_no", G.px_to_mm(F.col("dpi")).alias("mm"), G.px_to_mm2(F.col("dpi")).alias("mm2")
    )


@query("p14_region_to_px", _R.rstrip() + f""",
s as (select region_no, {_ANCHOR} as corner, width_px, height_px,
  {_scaled_sql('x', 'width_px', '1', 'dpi / 25.4e0')} as x, {_scaled_sql('w', 'width_px', '1', 'dpi / 25.4e0')} as w,
  {_scaled_sql('y', 'height_px', '1', 'dpi / 25.4e0')} as y, {_scaled_sql('h', 'height_px', '1', 'dpi / 25.4e0')} as h from regions),
e as (select *, case when corner like '%right' then round_even(width_px - x, 0) else round_even(x + w, 0) end as r,
  case when corner like '%right' then round_even(round_even(width_px - x, 0) - w, 0) else round_even(x, 0) end as l,
  case when corner like 'bottom%' then round_even(height_px - y, 0) else round_even(y + h, 0) end as b,
  case when corner like 'bottom%' then round_even(round_even(height_px - y, 0) - h, 0) else round_even(y, 0) end as t from s),
c as (select region_no, greatest(0, least(width_px, l)) as l, greatest(0, least(width_px, r)) as r,
  greatest(0, least(height_px, t)) as t, greatest(0, least(height_px, b)) as b from e)
select region_no, cast(l as bigint) as x, cast(t as bigint) as y, cast(r - l as bigint) as w, cast(b - t as bigint) as h
from c where r > l and b > t""")
def p14(v):
    box = G.region_to_px(*_cols("x", "y", "w", "h", "unit", "anchor", "width_px", "height_px", "dpi"))
    return v.view("regions").select("region_no", box.alias("b")).filter("b is not null").select("region_no", "b.*")


_MM = _R.rstrip() + f""",
s as (select region_no, unit, {_ANCHOR} as corner, 210e0 as sw, 297e0 as sh,
  {_scaled_sql('x', '210e0', '(25.4e0 / 96)', '1')} as x, {_scaled_sql('w', '210e0', '(25.4e0 / 96)', '1')} as w,
  {_scaled_sql('y', '297e0', '(25.4e0 / 96)', '1')} as y, {_scaled_sql('h', '297e0', '(25.4e0 / 96)', '1')} as h from regions),
m as (select region_no, unit, corner, case when corner like '%right' then sw - x - w else x end as l,
  case when corner like 'bottom%' then sh - y - h else y end as t, w, h, sw, sh from s)"""


def _mm(v):
    rect = G.region_to_mm(*_cols("x", "y", "w", "h", "unit", "anchor"), F.lit(210.0), F.lit(297.0))
    return v.view("regions").select("region_no", "unit", "anchor", rect.alias("m"))


@query("p15_region_to_mm", _MM + "select region_no, l as \"left\", t as top, w, h from m")
def p15(v):
    return _mm(v).select("region_no", "m.*")


_MODEL = _MM + """,
f as (select region_no, unit, corner, greatest(0, case when corner like '%left' then l else sw - l - w end) as x_mm,
  greatest(0, case when corner like 'top%' then t else sh - t - h end) as y_mm, w as w_mm, h as h_mm, sw, sh from m)"""


def _model(v):
    region = G.region_from_mm(*_cols("m.left", "m.top", "m.w", "m.h", "anchor"), F.lit(210.0), F.lit(297.0))
    return _mm(v).select("region_no", "unit", region.alias("r")).select("region_no", "unit", "r.*")


@query("p16_region_export", _MODEL + """
select region_no, corner as anchor, case when unit = 'percent' then 'percent' else 'mm' end as unit,
  case when unit = 'percent' then round_even(x_mm / sw * 100, 4) else round_even(x_mm, 2) end as x,
  case when unit = 'percent' then round_even(y_mm / sh * 100, 4) else round_even(y_mm, 2) end as y,
  case when unit = 'percent' then round_even(w_mm / sw * 100, 4) else round_even(w_mm, 2) end as w,
  case when unit = 'percent' then round_even(h_mm / sh * 100, 4) else round_even(h_mm, 2) end as h
from f where w_mm > 0 and h_mm > 0""")
def p16(v):
    shown = G.region_export(*_cols("x_mm", "y_mm", "w_mm", "h_mm", "unit"), F.lit(210.0), F.lit(297.0))
    return _model(v).select("region_no", "anchor", shown.alias("e")).filter("e is not null").select("region_no", "anchor", "e.*")


@query("p17_rescale_percent_regions", _MODEL + """
select region_no, unit, case when unit = 'percent' then x_mm * (841e0 / 210e0) else x_mm end as x_mm,
  case when unit = 'percent' then w_mm * (841e0 / 210e0) else w_mm end as w_mm,
  case when unit = 'percent' then y_mm * (1189e0 / 297e0) else y_mm end as y_mm,
  case when unit = 'percent' then h_mm * (1189e0 / 297e0) else h_mm end as h_mm from f""")
def p17(v):
    region = {n: F.col(n) for n in ("x_mm", "y_mm", "w_mm", "h_mm")}
    scaled = G.rescale_percent_region(region, F.col("unit"), F.lit(210.0), F.lit(297.0), F.lit(841.0), F.lit(1189.0))
    return _model(v).select("region_no", "unit", *[c.alias(n) for n, c in scaled.items()])


@query("p18_parse_regions", """
with t as (select o_orderkey as rule, o_orderkey % 90 as a, o_orderkey % 7 as b from orders),
raw as (
  select rule, 1 as region_no, cast(a as string) as x, cast(b as string) as y, '5' as w, '6.5' as h, 'percent' as unit, cast(null as string) as anchor, cast(null as string) as label from t where rule % 3 = 0
  union all select rule, 2, '1', '2', '3', cast(b as string), 'percent', null, null from t where rule % 3 = 0
  union all select rule, 1, cast(a as string), '1', '2', '3', 'mm', 'tr', 'region_1' from t where rule % 3 = 1
  union all select rule, 2, cast(b as string), '1', '2', '4', 'percent', null, 'stamp' from t where rule % 3 = 1
  union all select rule, 1, cast(a as string), '1', '2', cast(b as string), 'percent', null, null from t where rule % 3 = 2)
select rule, cast(region_no as bigint) as region_no, x, y, w, h, unit, anchor, label from raw""")
def p18(v):
    a, b = (F.col("o_orderkey") % 90).cast("string"), (F.col("o_orderkey") % 7).cast("string")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(a, F.lit(","), b, F.lit(", 5 ,6.5 ; (1 2 3 "), b, F.lit(");\n ")))
        .when(
            F.col("o_orderkey") % 3 == 1,
            F.concat(
                F.lit('[{"x":'), a, F.lit(',"y":1,"w":2,"h":3,"unit":" MM","anchor":" TR "},{"x":"'), b,
                F.lit('","y":1,"w":2,"h":4,"name":"stamp"}]'),
            ),
        )
        .otherwise(F.concat(F.lit("[["), a, F.lit(",1,2,"), b, F.lit("]]")))
    )
    rules = v.table("orders").select(F.col("o_orderkey").alias("rule"), text.alias("raw"))
    return G.parse_regions(rules, "raw", ["rule"])


@query("p19_validate_regions", """
with t as (select o_orderkey as rule, case when o_orderkey % 13 = 0 then 'abc' else cast((o_orderkey % 140) / 1.39e0 - 3 as string) end as x,
  cast((o_orderkey % 55) / 1e0 as string) as y, cast((o_orderkey % 77) - 1 as string) as w, cast(o_orderkey % 60 as string) as h,
  case o_orderkey % 6 when 0 then 'Percent' when 1 then 'mm' when 2 then 'cm' when 3 then '' when 4 then 'ratio' else '%' end as unit from orders),
n as (select rule, try_cast(x as double) as x, try_cast(y as double) as y, try_cast(w as double) as w, try_cast(h as double) as h,
  case lower(unit) when '' then 'percent' when '%' then 'percent' else lower(unit) end as unit from t),
e as (select *, case unit when 'percent' then 100e0 when 'ratio' then 1e0 end as lim from n),
r as (select *, case when x is null or y is null or w is null or h is null then 'zone_not_numbers'
  when unit not in ('percent', 'ratio', 'mm') then 'zone_bad_unit' when x < 0 or y < 0 or w <= 0 or h <= 0 then 'zone_negative'
  when lim is not null and (x > lim + 0.01 or y > lim + 0.01 or x + w > lim + 0.01 or y + h > lim + 0.01) then 'zone_out_of_range' end as error_key from e)
select rule, unit, error_key, case when error_key is null then x end as x, case when error_key is null then y end as y,
  case when error_key is null then case when lim is not null and x + w > lim then lim - x else w end end as w,
  case when error_key is null then case when lim is not null and y + h > lim then lim - y else h end end as h from r""")
def p19(v):
    k = F.col("o_orderkey")
    x = F.when(k % 13 == 0, "abc").otherwise(((k % 140) / F.lit(1.39) - 3).cast("string"))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("Percent", "mm", "cm", "", "ratio", "%")]), (k % 6 + 1).cast("int"))
    checked = G.validate_region(
        x, ((k % 55) / F.lit(1.0)).cast("string"), (k % 77 - 1).cast("string"), (k % 60).cast("string"), unit
    )
    return v.table("orders").select(k.alias("rule"), checked.alias("c")).select("rule", "c.*")


@query("p20_paper_format", """
with t as (select l_orderkey, l_linenumber, 200e0 + l_partkey % 700 as w, 290e0 + l_suppkey * 9 % 920 as h from lineitem),
f as (select * from (values ('A4', 210e0, 297e0, 0), ('A3', 297e0, 420e0, 1), ('A2', 420e0, 594e0, 2), ('A1', 594e0, 841e0, 3), ('A0', 841e0, 1189e0, 4)) as f(name, fw, fh, rank))
select l_orderkey, l_linenumber, w, h, min(case when abs(least(w, h) - fw) <= 8 and abs(greatest(w, h) - fh) <= 8 then name end) as exact,
  arg_min(name, abs(fw * fh - w * h) * 10 + rank / 100e0) as nearest
from t, f group by all""")
def p20(v):
    w, h = 200.0 + F.col("l_partkey") % 700, 290.0 + F.col("l_suppkey") * 9 % 920
    return v.table("lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h")).distinct().select(
        "l_orderkey", "l_linenumber", "w", "h", G.detect_format(F.col("w"), F.col("h")).alias("exact"),
        G.nearest_format(F.col("w"), F.col("h")).alias("nearest"),
    )


_RAW = "case event_id % 9 when 0 then '' when 1 then '-' when 2 then ' 12 ' when 3 then '7.0' when 4 then '7.5' when 5 then 'x' when 6 then 'On' when 7 then 'да' else cast(value as string) end"


@query("p25_coerce", f"""
select event_id, coalesce(try_cast(nullif(trim(raw), '') as double), -1) as as_float,
  cast(coalesce(trunc(try_cast(nullif(trim(raw), '') as double)), -1) as bigint) as as_int,
  case when try_cast(nullif(trim(raw), '') as double) = floor(try_cast(nullif(trim(raw), '') as double)) then cast(try_cast(nullif(trim(raw), '') as double) as bigint) end as as_page,
  lower(trim(coalesce(raw, ''))) in ('on', '1', 'true', 'yes', 'да') as as_bool
from (select event_id, {_RAW} as raw from events)""")
def p25(v):
    raw = F.expr(_RAW)
    return v.table("events").select(
        "event_id", H.coerce_float(raw, -1.0).alias("as_float"), H.coerce_int(raw, -1).alias("as_int"),
        H.coerce_page(raw).alias("as_page"), H.coerce_bool(raw).alias("as_bool"),
    )


@query("p26_validate_settings", """
with t as (select event_id, case event_id % 5 when 0 then cast(event_id % 1500 as string) when 1 then '300' when 2 then '72.5' when 3 then 'x' else ' 1200 ' end as dpi,
  case event_id % 4 when 0 then 'Strict ' when 1 then 'normal' when 2 then 'loose' else 'hard' end as strictness from events),
n as (select event_id, try_cast(trim(dpi) as double) as d, lower(trim(strictness)) as s from t),
e as (select *, case when d is null or d <> floor(d) then 'dpi_not_integer' when d < 72 or d > 1200 then 'dpi_out_of_range'
  when s not in ('strict', 'normal', 'loose') then 'strictness_invalid' end as error_key from n)
select event_id, case when error_key is null then cast(d as bigint) end as dpi, case when error_key is null then s end as strictness, error_key from e""")
def p26(v):
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*values), (k % n + 1).cast("int"))
    dpi = pick([(k % 1500).cast("string"), F.lit("300"), F.lit("72.5"), F.lit("x"), F.lit(" 1200 ")], 5)
    strictness = pick([F.lit(s) for s in ("Strict ", "normal", "loose", "hard")], 4)
    return v.table("events").select("event_id", H.validate_settings(dpi, strictness).alias("s")).select("event_id", "s.*")


@query("m9_harmonize", """
with t as (select l_orderkey, l_linenumber, l_partkey % 900 + 400 as wa, l_suppkey % 50 + 800 as ha,
  case l_linenumber % 4 when 0 then l_partkey % 900 + 400 when 1 then l_partkey % 900 + 402 when 2 then (l_partkey % 900 + 400) * 2 else l_partkey % 900 + 700 end as wb,
  case l_linenumber % 4 when 0 then l_suppkey % 50 + 800 when 1 then l_suppkey % 50 + 799 when 2 then (l_suppkey % 50 + 800) * 2 + 3 else l_suppkey % 50 + 800 end as hb from lineitem),
g as (select *, abs(ha - hb) <= 3 and abs(wa - wb) <= 3 as near, abs(wa / ha - wb / hb) / greatest(wa / ha, wb / hb) > 0.015 as other, ha * wa <= hb * wb as small from t)
select l_orderkey, l_linenumber, case when wa = wb and ha = hb then 'same' when near then 'pad' when other then 'size_mismatch' when small then 'scale_b' else 'scale_a' end as mode,
  case when near then greatest(wa, wb) when other then null when small then wa else wb end as width,
  case when near then greatest(ha, hb) when other then null when small then ha else hb end as height from g""")
def m9(v):
    t = v.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 900 + 400 as wa", "l_suppkey % 50 + 800 as ha"
    )
    n, wa, ha = F.col("l_linenumber") % 4, F.col("wa"), F.col("ha")
    wb = F.when(n == 0, wa).when(n == 1, wa + 2).when(n == 2, wa * 2).otherwise(wa + 300)
    hb = F.when(n == 1, ha - 1).when(n == 2, ha * 2 + 3).otherwise(ha)
    return t.select("l_orderkey", "l_linenumber", G.harmonize(wa, ha, wb, hb).alias("c")).select(
        "l_orderkey", "l_linenumber", "c.*"
    )
