"""Queries over raster cells, masks and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.operators import cells as R
from sheetdelta.operators import zones as Z
from sheetdelta.plans.registry import query
from sheetdelta.sources.testviews import view_ctes

REV = ("doc_pair", "seq", "rev")
SHEET = R.KEYS


def words_of(v):
    return R.pack(v.view("cells"))


def masks_of(v, radius: float = 1.0):
    return R.masks(R.side_by_side(words_of(v), SHEET, radius))


_CROSS = "(values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) as o(dx, dy)"
_SIDES = f"""
near as (select distinct seq, rev, x + dx as x, y + dy as y from cells, {_CROSS}),
removed as (select seq, x, y from cells c where rev = 'A' and not exists (select 1 from near n where n.rev = 'B' and n.seq = c.seq and n.x = c.x and n.y = c.y)),
added as (select seq, x, y from cells c where rev = 'B' and not exists (select 1 from near n where n.rev = 'A' and n.seq = c.seq and n.x = c.x and n.y = c.y)),
changed as (select * from removed union select * from added),
fg as (select distinct seq, x, y from cells)"""
_C = view_ctes("cells", "dims").rstrip() + "," + _SIDES


@query("j4_tolerance_anti_join", _C + " select seq, 'removed' as side, x, y from removed union all select seq, 'added', x, y from added")
def j4(v):
    sides = R.tolerance_anti_join(words_of(v), 1.0)
    return R.unpack(sides, "bits", ["seq", "side"]).select("seq", "side", "x", "y")


@query("x5_foreground_union", _C + " select seq, x, y from fg")
def x5(v):
    return R.unpack(masks_of(v), "foreground", ["seq"]).select("seq", "x", "y")


@query("x6_changed_union", _C + " select seq, x, y from changed")
def x6(v):
    return R.unpack(masks_of(v), "changed", ["seq"]).select("seq", "x", "y")


_MASKED = view_ctes("cells", "exclusions").rstrip() + """
select seq, rev, c.x, c.y from cells c where not exists (
  select 1 from exclusions e where e.seq = c.seq and c.x >= e.x and c.x < e.x + e.w and c.y >= e.y and c.y < e.y + e.h)"""


@query("j5_mask_regions", _MASKED)
def j5(v):
    kept = R.mask_regions(words_of(v), v.view("exclusions"), ["bits"])
    return R.unpack(kept, "bits", ["seq", "rev"]).select("seq", "rev", "x", "y")


@query("j6_zone_overlap_join", view_ctes("zones", "exclusions") + """
select e.seq, e.region_no as cand_id, z.zone_id, z.w * z.h as zone_area from exclusions e join zones z
  on e.seq = z.seq and e.x < z.x + z.w and z.x < e.x + e.w and e.y < z.y + z.h and z.y < e.y + e.h""")
def j6(v):
    candidates = v.view("exclusions").withColumnRenamed("region_no", "zone_id")
    return Z.zone_overlap_join(candidates, v.view("zones")).select("seq", "cand_id", "zone_id", "zone_area")


@query("a7_diff_metrics", _C + """
select d.seq, c as changed_px, a as added_px, r as removed_px, f as foreground_px, c / 4096e0 * 100 as diff_percent,
  case when f > 0 then least(100, c / f * 100) else 0 end as diff_foreground_percent, c * (25.4e0 / 72) * (25.4e0 / 72) as diff_area_mm2,
  a * (25.4e0 / 72) * (25.4e0 / 72) as added_area_mm2, r * (25.4e0 / 72) * (25.4e0 / 72) as removed_area_mm2, f < 4096 * 0.0005 as foreground_sparse
from (select d.seq, (select count(*) from changed x where x.seq = d.seq) as c, (select count(*) from added x where x.seq = d.seq) as a,
  (select count(*) from removed x where x.seq = d.seq) as r, (select count(*) from fg x where x.seq = d.seq) as f from dims d) d""")
def a7(v):
    return R.diff_metrics(masks_of(v), v.view("dims")).drop("doc_pair", "width", "height", "dpi")


@query("a8_max_region", view_ctes("cells", "zones").rstrip() + "," + _SIDES + """
select seq, max(n) as max_region_changed_px, count(*) as bboxes_count from (
  select z.seq, z.zone_id, count(c.x) as n from zones z left join changed c
    on c.seq = z.seq and c.x >= z.x and c.x < z.x + z.w and c.y >= z.y and c.y < z.y + z.h group by all) group by seq""")
def a8(v):
    return Z.max_region(v.view("zones"), masks_of(v)).drop("doc_pair")


# regions by walking from every cell to its smallest reachable cell, one step per round
_REGIONS = _C.rstrip().replace("with cells", "with recursive cells", 1) + """,
node as (select seq, x, y, y * 64 + x as id from changed),
edge as (select a.seq, a.id as u, b.id as w from node a, (values (-1), (0), (1)) ox(dx), (values (-1), (0), (1)) oy(dy), node b
  where b.seq = a.seq and b.x = a.x + dx and b.y = a.y + dy and b.id <> a.id),
reach(seq, id, label) using key (seq, id) as (
  select seq, id, id as label from node
  union all
  select e.seq, e.w, min(r.label) from reach r join edge e on e.seq = r.seq and e.u = r.id
    join recurring.reach k on k.seq = e.seq and k.id = e.w where r.label < k.label group by e.seq, e.w),
zone as (select r.seq, r.label, min(n.x) as x, min(n.y) as y, max(n.x) - min(n.x) + 1 as w, max(n.y) - min(n.y) + 1 as h, count(*) as area
  from reach r join node n using (seq, id) group by r.seq, r.label)
"""


@query("m6_connected_zones", _REGIONS + "select r.seq, n.x, n.y, r.label % 64 as label_x, r.label // 64 as label_y from reach r join node n using (seq, id)")
def m6(v):
    runs = Z.connected_zones(masks_of(v), "changed")
    return runs.select(
        "seq", F.explode(F.sequence("x0", "x1")).alias("x"), "y",
        F.expr("label & 4294967295L").alias("label_x"), F.expr("shiftright(label, 32)").alias("label_y"),
    )


def _zones(v, masks=None):
    return Z.zone_boxes(Z.connected_zones(masks_of(v) if masks is None else masks, "changed"))


@query("a9_zone_boxes", _REGIONS + "select seq, x, y, w, h, area from zone")
def a9(v):
    return _zones(v).select("seq", "x", "y", "w", "h", "area")


# free cells that see the frame along a line or hang together with such a cell over sides; what is left is filled, and its regions stand in no hole
_FILLED = """sheet as (select distinct seq from changed),
free as (select * from (select seq, x, y from sheet, range(-1, 65) t(x), range(-1, 65) u(y)) anti join changed using (seq, x, y)),
across as (select seq, y, min(x) as x0, max(x) as x1 from changed group by seq, y), down as (select seq, x, min(y) as y0, max(y) as y1 from changed group by seq, x),
outside as (select seq, x, y from free left join across using (seq, y) left join down using (seq, x)
    where x0 is null or x < x0 or x > x1 or y0 is null or y < y0 or y > y1
  union select f.seq, f.x, f.y from outside o, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) join free f on f.seq = o.seq and f.x = o.x + dx and f.y = o.y + dy),
filled as (select * from (select seq, x, y from sheet, range(0, 64) t(x), range(0, 64) u(y)) anti join outside using (seq, x, y)),
node as (select seq, x, y, y * 64 + x as id from filled),"""
_OUTER = _REGIONS.replace("node as (select seq, x, y, y * 64 + x as id from changed),", _FILLED) + """,
square as (select seq, x - dx as qx, y - dy as qy, count(*) as n, min(label) as label
  from node join reach using (seq, id), (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy) group by all having count(*) >= 3),
rated as (select seq, label, sum(case n when 4 then 1e0 else 0.5e0 end) as polygon from square group by seq, label)
select seq, x, y, w, h, coalesce(polygon, 0e0) as area, area as cells from zone left join rated using (seq, label)"""


@query("a9_outer_zones", _OUTER)
def a9_outer(v):
    return Z.outer_zones(masks_of(v), "changed").select("seq", "x", "y", "w", "h", "area", "cells")


@query("f6_min_area_zones", view_ctes("zones") + "select seq, zone_id, w * h as area from zones where w * h >= 80")
def f6(v):
    sized = v.view("zones").withColumn("area", F.col("w") * F.col("h"))
    return Z.min_area_zones(sized, "strict").select("seq", "zone_id", "area")


_BIG = """big as (select s_suppkey as seq, s_suppkey * 10 as zone_id, s_suppkey % 5 as x, s_suppkey % 3 as y, 20 + s_suppkey % 39 as w, 30 + s_suppkey % 31 as h from supplier),
few as (select seq, x, y from changed where (x + y) % 16 = 0 and seq % 2 = 0 or x < 3 and seq % 2 = 1)"""


@query("f7_drop_sparse_page_zones", _C.rstrip() + "," + _BIG + """
select b.seq, b.zone_id from big b left join few c on c.seq = b.seq and c.x >= b.x and c.x < b.x + b.w and c.y >= b.y and c.y < b.y + b.h
group by b.seq, b.zone_id, b.w, b.h having not (b.w * b.h >= 1024 and count(c.x) / (b.w * b.h) < 0.01)""")
def f7(v):
    big = v.table("supplier").selectExpr(
        "'lattice' as doc_pair", "s_suppkey as seq", "s_suppkey * 10 as zone_id", "s_suppkey % 5 as x", "s_suppkey % 3 as y",
        "20 + s_suppkey % 39 as w", "30 + s_suppkey % 31 as h",
    )
    few = R.unpack(masks_of(v), "changed", SHEET).filter("(x + y) % 16 = 0 and seq % 2 = 0 or x < 3 and seq % 2 = 1")
    return Z.drop_sparse_page_zones(big, R.pack(few, SHEET, ()), v.view("dims"), "bits").select("seq", "zone_id")


_STEPS = _REGIONS[_REGIONS.index("node as ("):].replace("zone as (", "zone0 as (")
_MERGED = _REGIONS.rstrip() + f""",
grown as (select distinct seq, x + dx as x, y + dy as y from changed, {_CROSS} where x + dx between 0 and 63 and y + dy between 0 and 63),
closed as (select g.seq, g.x, g.y from grown g, {_CROSS} where g.x + dx not between 0 and 63 or g.y + dy not between 0 and 63
  or exists (select 1 from grown h where h.seq = g.seq and h.x = g.x + dx and h.y = g.y + dy) group by all having count(*) = 5),
{_STEPS.replace("node", "node2").replace("edge", "edge2").replace("reach", "reach2").replace("zone0", "cand").replace("from changed", "from closed").rstrip()},
hit as (select c.seq, c.label as cand, z.label, z.w * z.h as zone_area from cand c join zone z
  on c.seq = z.seq and c.x < z.x + z.w and z.x < c.x + c.w and c.y < z.y + z.h and z.y < c.y + c.h),
src as (select seq, cand, sum(zone_area) as source_area from hit group by all having count(*) >= 2),
good as (select c.* from cand c join src s on s.seq = c.seq and s.cand = c.label where c.w * c.h <= 1024 and c.w * c.h / source_area <= 16
  and (select count(*) from changed m where m.seq = c.seq and m.x >= c.x and m.x < c.x + c.w and m.y >= c.y and m.y < c.y + c.h) / (c.w * c.h) >= 0.01)
select seq, x, y, w, h, true as merged from good
union all select z.seq, z.x, z.y, z.w, z.h, false from zone z where not exists (
  select 1 from hit join good g on g.seq = hit.seq and g.label = hit.cand where hit.seq = z.seq and hit.label = z.label)"""


@query("m7_merge_zones", _MERGED)
def m7(v):
    from sheetdelta.session import cut

    masks = cut(masks_of(v))
    merged = Z.merge_zones(cut(_zones(v, masks)), masks, v.view("dims"), 1)
    return merged.select("seq", "x", "y", "w", "h", "merged")


# middles of runs of at most nine cells; where both revisions have one within a cell, a round stencil of reach four
_ENVELOPE = """,
across as (select seq, rev, y, (min(x) + max(x)) // 2 as x from (select *, x - row_number() over (partition by seq, rev, y order by x) as island from cells)
  group by seq, rev, y, island having max(x) - min(x) < 9),
down as (select seq, rev, x, (min(y) + max(y)) // 2 as y from (select *, y - row_number() over (partition by seq, rev, x order by y) as island from cells)
  group by seq, rev, x, island having max(y) - min(y) < 9),
axes as (select seq, rev, x, y from across union select seq, rev, x, y from down),
nearby(dx, dy) as (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
shared as (select distinct a.seq, a.x, a.y from axes a cross join nearby join axes b on a.seq = b.seq and a.rev <> b.rev and b.x = a.x + dx and b.y = a.y + dy),
stencil as (select dx, dy from (select unnest(range(-4, 5)) as dx) cross join (select unnest(range(-4, 5)) as dy) where abs(dx) <= round(sqrt(16 - dy * dy))),
envelope as (select distinct seq, x + dx as x, y + dy as y from shared cross join stencil)
select seq, x, y from (select seq, x, y from removed union select seq, x, y from added) anti join envelope using (seq, x, y)"""


@query("m10_ignore_line_weight", _C + _ENVELOPE)
def m10(v):
    words = words_of(v)
    masks = R.masks(R.side_by_side(words, SHEET, 1.0))
    kept = Z.ignore_line_weight(masks, Z.line_weight_envelope(words, v.view("dims"), 1.0, 72.0))
    return R.unpack(kept, "changed", ["seq"]).select("seq", "x", "y")


_RUNS = view_ctes("cells") + """
select seq, rev, y as line, min(x) as "first", max(x) as "last" from (
  select *, x - row_number() over (partition by seq, rev, y order by x) as island from cells) group by seq, rev, y, island"""


@query("w10_stroke_runs", _RUNS)
def w10(v):
    return Z.stroke_runs(v.view("cells")).drop("doc_pair")


_G = view_ctes("gray", "dims").rstrip() + """,
hist as (select seq, rev, v, sum(n) as n from (select seq, rev, v, count(*) as n from gray group by all
  union all select seq, rev, 255, 4096 - count(*) from gray group by seq, rev) group by all),
cum as (select *, sum(n) over w as cl, sum(n * v) over w as sl, sum(n) over (partition by seq, rev) as ca, sum(n * v) over (partition by seq, rev) as sa
  from hist window w as (partition by seq, rev order by v))"""


@query("a10_histogram", _G + " select seq, rev, v, cast(n as bigint) as n from hist")
def a10(v):
    return R.histogram(v.view("gray"), v.view("dims")).drop("doc_pair")


@query("w9_cumulative_histogram", _G + """ select seq, rev, v, cast(n as bigint) as n, cast(cl as bigint) as count_low, cast(sl as bigint) as sum_low,
  cast(ca as bigint) as count_all, cast(sa as bigint) as sum_all from cum""")
def w9(v):
    return R.cumulative_histogram(R.histogram(v.view("gray"), v.view("dims"))).drop("doc_pair")


@query("a10_otsu_threshold", _G + """ select seq, rev, arg_max(v, (s, -v)) as threshold from (
  select *, round(case when ca > cl then (cl / ca) * ((ca - cl) / ca) * (sl / cl - (sa - sl) / (ca - cl)) * (sl / cl - (sa - sl) / (ca - cl)) else 0 end, 6) as s from cum)
  group by seq, rev""")
def a10b(v):
    return R.otsu_threshold(R.histogram(v.view("gray"), v.view("dims"))).drop("doc_pair")


@query("a11_thumbnail", view_ctes("gray") + """
select seq, rev, round(sum(darkness), 6) as total, round(max(darkness), 6) as darkest, count(*) as inked, min(place) as first_place from (
  select seq, rev, (y // 4) * 16 + x // 4 as place, sum(255 - v) / 16e0 as darkness from gray group by all) where darkness > 0 group by seq, rev""")
def a11(v):
    thumbs = R.thumbnail(v.view("gray"), v.view("dims"), 16)
    dark = F.transform("thumb", lambda t: 255.0 - t)
    inked = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at("d", i + 1) > 0)
    return thumbs.select("seq", "rev", dark.alias("d")).select(
        "seq", "rev", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("d"), 6).alias("darkest"), F.size(inked).cast("long").alias("inked"),
        F.array_min(inked).cast("long").alias("first_place"),
    )


@query("m11_blur", view_ctes("gray") + """
select seq, rev, x, y, (255 * 16 + s + 8) // 16 as v from (
  select seq, rev, x + dx as x, y + dy as y, cast(sum((v - 255) *
    (case when dx = 0 then 2 when x + dx = 0 and x = 1 or x + dx = 63 and x = 62 then 2 else 1 end) *
    (case when dy = 0 then 2 when y + dy = 0 and y = 1 or y + dy = 63 and y = 62 then 2 else 1 end)) as bigint) as s
  from gray, (values (-1), (0), (1)) ox(dx), (values (-1), (0), (1)) oy(dy)
  where v <> 255 and x + dx between 0 and 63 and y + dy between 0 and 63 group by all) where (255 * 16 + s + 8) // 16 <> 255""")
def m11(v):
    return R.blur(v.view("gray"), v.view("dims")).drop("doc_pair")


def _opening_sql(offsets: str, n: int) -> str:
    return view_ctes("cells").rstrip() + f""",
fat as (select distinct seq, rev, x + a as x, y + b as y from cells, (values (0), (1)) oa(a), (values (0), (1)) ob(b)),
kept as (select t.seq, t.rev, t.x, t.y from fat t, {offsets} where exists (select 1 from fat c where c.seq = t.seq and c.rev = t.rev and c.x = t.x + dx and c.y = t.y + dy)
    or t.x + dx not between 0 and 63 or t.y + dy not between 0 and 63 group by all having count(*) = {n})
select distinct seq, rev, x + dx as x, y + dy as y from kept, {offsets} where x between 0 and 63 and y between 0 and 63 and x + dx between 0 and 63 and y + dy between 0 and 63"""


def _fat(v):
    return R.clip(R.dilate(words_of(v), R.square(2)), v.view("dims"))


_FAT_CLIP = "fat as (select distinct seq, rev, x + a as x, y + b as y from cells, (values (0), (1)) oa(a), (values (0), (1)) ob(b) where x + a < 64 and y + b < 64)"


def _fat_opening(offsets: str, n: int) -> str:
    sql = _opening_sql(offsets, n)
    start, end = sql.index("fat as ("), sql.index(",\nkept")
    return sql[:start] + _FAT_CLIP + sql[end:]


@query("m11_opening_square", _fat_opening("(values (0, 0), (1, 0), (0, 1), (1, 1)) as o(dx, dy)", 4))
def m11b(v):
    return R.unpack(R.opening(_fat(v), R.square(2), v.view("dims"))).drop("doc_pair")


@query("m11_opening_cross", _fat_opening(_CROSS, 5))
def m11c(v):
    return R.unpack(R.opening(_fat(v), R.CROSS, v.view("dims"))).drop("doc_pair")


@query("m8_register_shift", view_ctes("cells").rstrip() + """,
votes as (select a.seq, b.x - a.x as dx, b.y - a.y as dy, count(*) as n from cells a join cells b on a.seq = b.seq and a.rev = 'A' and b.rev = 'B'
  and b.x between a.x - 6 and a.x + 6 and b.y between a.y - 6 and a.y + 6 group by all),
best as (select seq, max((n, -(abs(dx) + abs(dy)), -abs(dy), -dy, -dx)) as k, coalesce(max(n) filter (dx = 0 and dy = 0), 0) as still from votes group by seq),
pick as (select seq, k[1] as n, -k[5] as dx, -k[4] as dy, still from best),
total as (select seq, count(*) as t from cells group by seq)
select t.seq, case when t - 2 * coalesce(still, 0) = 0 then 'IDENTITY' when n is null then 'SHIFT_FAILED' when dx = 0 and dy = 0 then 'ALREADY_ALIGNED'
    when t - 2 * n <= (t - 2 * still) * 0.9e0 then 'SHIFT' else 'SHIFT_FAILED' end as method,
  case when n > still and t - 2 * n <= (t - 2 * still) * 0.9e0 and t <> 2 * still then dx else 0 end as shift_x,
  case when n > still and t - 2 * n <= (t - 2 * still) * 0.9e0 and t <> 2 * still then dy else 0 end as shift_y,
  t - 2 * coalesce(still, 0) as residual_before,
  case when n > still and t - 2 * n <= (t - 2 * still) * 0.9e0 and t <> 2 * still then t - 2 * n else t - 2 * coalesce(still, 0) end as residual_after
from total t left join pick using (seq)""".replace("max((n, -(abs(dx) + abs(dy)), -abs(dy), -dy, -dx))", "max([n, -(abs(dx) + abs(dy)), -abs(dy), -dy, -dx])"))
def m8(v):
    return R.register_shift(words_of(v), v.view("dims")).drop("doc_pair", "ok")


@query("o1_zones_in_order", view_ctes("zones") + "select seq, zone_id, x, y, w * h as area from zones order by seq, y, x, area, zone_id")
def o1(v):
    sized = v.view("zones").withColumn("area", F.col("w") * F.col("h"))
    return sized.orderBy("seq", "y", "x", "area", "zone_id").select("seq", "zone_id", "x", "y", "area")
