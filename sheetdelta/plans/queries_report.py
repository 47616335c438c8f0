"""Queries over detail rows: grades, status, counts, orders, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import severity as V
from sheetdelta.operators import report as R
from sheetdelta.operators import selection as S
from sheetdelta.operators import settings as P
from sheetdelta.plans.registry import query
from sheetdelta.session import scratch_path
from sheetdelta.sources import readers, writers
from sheetdelta.sources.testviews import view_ctes

_D = view_ctes("details")
ARGS = ("diff_foreground_percent", "foreground_sparse", "max_region_area_mm2", "bboxes_count")


def grade_sql(value: str, low: str, mid: str, high: str) -> str:
    return f"case when {value} >= {high} then 3 when {value} >= {mid} then 2 when {value} >= {low} then 1 else 0 end"


_FG = grade_sql("diff_foreground_percent", "1", "8", "20")
_RG = grade_sql("max_region_area_mm2", "100", "2500", "10000")
_ZN = grade_sql("coalesce(bboxes_count, 0)", "1", "15", "40")
_NAME = "(['unchanged', 'minor', 'moderate', 'major'])[1 + {}]"
_CLASS = _NAME.format(f"""case when diff_foreground_percent is null then
    case when diff_percent >= 5 then 3 when diff_percent >= 1 then 2 when diff_percent >= 0.15 or coalesce(bboxes_count, 0) > 0 then 1 else 0 end
  else greatest(case when coalesce(foreground_sparse, false) then 0 else {_FG} end, case when max_region_area_mm2 is null then 0 else {_RG} end, {_ZN}) end""")
_LEVEL = f"coalesce(change_level, case when diff_percent is not null then {_CLASS} end, 'unchanged')"
_STATUS = f"""case when status = 'added' then 'ADDED' when status = 'removed' then 'REMOVED' when status = 'size_mismatch' then 'CHANGED'
  when {_LEVEL} = 'unchanged' then 'UNCHANGED' else 'CHANGED' end"""
_MOVED = "coalesce(a_page <> 0 and b_page <> 0 and a_page <> b_page, false) and status not in ('added', 'removed')"
_SIMPLE = f"case when status = 'added' then 'NEW' when status = 'removed' then 'CHANGED' when {_STATUS} = 'UNCHANGED' then 'UNCHANGED' else 'CHANGED' end"
_BAR = """case when status = 'added' then 'ADDED' when status = 'removed' then 'REMOVED'
  when coalesce(change_level, 'unchanged') = 'unchanged' then 'UNCHANGED' else 'CHANGED' end"""
_DIST = f"case when {_BAR} = 'CHANGED' then upper(change_level) else {_BAR} end"
_RANK = f"case {_DIST} when 'UNCHANGED' then 0 when 'MINOR' then 1 when 'MODERATE' then 2 when 'MAJOR' then 3 when 'SIZE_MISMATCH' then 4 when 'REMOVED' then 5 when 'ADDED' then 6 end"


@query("p29_signal_levels", _D + f"""
select seq, array_to_string(list_filter([
  case when diff_foreground_percent is not null and not coalesce(foreground_sparse, false) then concat('fg=', {_NAME.format(_FG)}) end,
  case when diff_foreground_percent is not null and max_region_area_mm2 is not null then concat('region=', {_NAME.format(_RG)}) end,
  case when diff_foreground_percent is not null then concat('zones=', {_NAME.format(_ZN)}) end], lambda s: s is not null), ',') as signals from details""")
def p29(v):
    signals = V.signal_levels(*[F.col(a) for a in ARGS])
    text = F.transform(signals, lambda s: F.concat(s["signal"], F.lit("="), s["level"]))
    return v.view("details").select("seq", F.array_join(text, ",").alias("signals"))


@query("p30_classify", _D + f"select seq, {_CLASS} as level from details")
def p30(v):
    level = V.classify(F.col("diff_percent"), F.col("bboxes_count"), *[F.col(a) for a in ARGS[:3]])
    return v.view("details").select("seq", level.alias("level"))


@query("p31_report_tags", _D + """
select seq, case when coalesce(change_level, 'unchanged') = 'unchanged' then 'UNCHANGED' else 'CHANGED' end as status_tag,
  upper(coalesce(change_level, 'unchanged')) as level_tag from details""")
def p31(v):
    return v.view("details").select("seq", V.report_tags(F.col("change_level")).alias("t")).select("seq", "t.*")


@query("p32_status_and_confidence", _D + f"""
select seq, {_STATUS} as page_status, {_STATUS} as content_status, {_MOVED} as moved,
  case when status in ('added', 'removed', 'size_mismatch') then 'NONE' when score >= 0.98 then 'EXACT' when score >= 0.75 then 'PROBABLE' else 'NONE' end as confidence
from details""")
def p32(v):
    return v.view("details").select("seq", V.status_and_confidence(V.detail_columns()).alias("s")).select("seq", "s.*")


@query("p33_page_notes", _D + f"""
select seq, array_to_string(list_filter([
  case when status = 'added' then 'summary:new_only' when status = 'removed' then 'summary:removed_in_new' when status = 'size_mismatch' then 'warn:size_mismatch'
    when {_STATUS} = 'UNCHANGED' then 'summary:no_significant'
    when coalesce(foreground_sparse, false) or diff_foreground_percent is null then 'summary:visual_changes_sparse' else 'summary:visual_changes' end,
  case when ecc_failed then 'info:registration_failed' when sqrt(alignment_shift_x_mm * alignment_shift_x_mm + alignment_shift_y_mm * alignment_shift_y_mm) >= 0.2 then 'info:alignment_shift' end
  ], lambda s: s is not null), ';') as notes from details""")
def p33(v):
    row = V.detail_columns()
    notes = V.page_notes(row, V.status_and_confidence(row)["content_status"])
    text = F.transform(notes, lambda n: F.concat(n["kind"], F.lit(":"), n["key"]))
    return v.view("details").select("seq", F.array_join(text, ";").alias("notes"))


@query("p35_live_status", _D + """
select seq, case when status in ('added', 'removed') then status when status = 'size_mismatch' or change_level = 'size_mismatch' then 'changed'
  when coalesce(change_level, 'unchanged') = 'unchanged' then 'unchanged' else 'changed' end as live_status,
  case when status in ('added', 'removed') then status when status = 'size_mismatch' or change_level = 'size_mismatch' then 'major'
  else coalesce(change_level, 'unchanged') end as level_class from details""")
def p35(v):
    return v.view("details").select("seq", V.live_status(F.col("status"), F.col("change_level")).alias("l")).select("seq", "l.*")


@query("p36_simple_status", _D + f"select seq, {_SIMPLE} as simple_status from details")
def p36(v):
    content = V.status_and_confidence(V.detail_columns())["content_status"]
    return v.view("details").select("seq", V.simple_status(F.col("status"), content).alias("simple_status"))


@query("a1_summarize_pairs", _D + """
select run_id, count(*) as total, count(*) filter (status = 'matched') as matched, count(*) filter (status = 'added') as added,
  count(*) filter (status = 'removed') as removed, count(*) filter (change_level = 'unchanged') as unchanged, count(*) filter (change_level = 'minor') as minor,
  count(*) filter (change_level = 'moderate') as moderate, count(*) filter (change_level = 'major') as major from details group by run_id""")
def a1(v):
    return R.summarize_pairs(v.view("details"))


@query("a2_summary_counts", _D + """
select run_id, count(*) filter (status not in ('added', 'removed')) as matched, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed,
  count(*) filter (status not in ('added', 'removed') and not (status = 'matched' and coalesce(change_level, '') = 'unchanged')) as changed,
  count(*) filter (status = 'matched' and change_level = 'unchanged') as unchanged from details group by run_id""")
def a2(v):
    return R.summary_counts(v.view("details"))


@query("a3_engineer_counts", _D + """
select run_id, count(*) filter (status = 'matched') as matched, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed,
  count(*) filter (status = 'size_mismatch') as size_mismatch, count(*) filter (status = 'matched' and change_level = 'unchanged') as unchanged,
  count(*) filter (status = 'matched' and change_level = 'minor') as minor, count(*) filter (status = 'matched' and change_level = 'moderate') as moderate,
  count(*) filter (status = 'matched' and change_level = 'major') as major from details group by run_id""")
def a3(v):
    return R.engineer_counts(v.view("details"))


@query("a4_report_counts", _D + f"""
select run_id, count(*) filter ({_SIMPLE} = 'UNCHANGED') as unchanged, count(*) filter ({_SIMPLE} = 'CHANGED') as changed, count(*) filter ({_SIMPLE} = 'NEW') as "new",
  count(*) filter (status = 'removed') as removed, count(*) filter ({_MOVED}) as moved from details group by run_id""")
def a4(v):
    return R.report_counts(v.view("details"))


@query("a5_dashboard_counts", _D + f"""
select run_id, count(*) filter ({_BAR} = 'CHANGED') as changed, count(*) filter ({_BAR} = 'ADDED') as added, count(*) filter ({_BAR} = 'REMOVED') as removed,
  count(*) filter ({_BAR} = 'UNCHANGED') as unchanged from details group by run_id""")
def a5(v):
    return R.dashboard_counts(v.view("details"))


@query("a5_severity_distribution", _D + f"""
select run_id, dist_key, list_position(['MAJOR', 'MODERATE', 'MINOR', 'SIZE_MISMATCH', 'ADDED', 'REMOVED', 'UNCHANGED'], dist_key) as place, n,
  100e0 * n / sum(n) over (partition by run_id) as percent
from (select run_id, {_DIST} as dist_key, count(*) as n from details group by all)""")
def a5b(v):
    return R.severity_distribution(v.view("details"))


_PENDING = "o_orderdate >= timestamp '2000-06-01'"


def _live(v):
    orders = v.table("orders")
    pages = orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"))
    done = v.view("details").join(orders.filter(F.col("o_orderdate") < "2000-06-01").select(F.col("o_orderkey").alias("seq")), "seq")
    return pages, done


_LIVE = _D.rstrip() + f""",
live as (select d.run_id, d.seq, case when {_PENDING} then 'pending' when status in ('added', 'removed') then status
  when status = 'size_mismatch' or change_level = 'size_mismatch' then 'changed' when coalesce(change_level, 'unchanged') = 'unchanged' then 'unchanged' else 'changed' end as live_status
  from details d join orders on o_orderkey = seq)"""


@query("j7_attach_details", _LIVE + "select run_id, seq, live_status from live")
def j7(v):
    return R.attach_details(*_live(v))


@query("a6_live_counts", _LIVE + """
select run_id, count(*) filter (live_status = 'changed') as changed, count(*) filter (live_status = 'unchanged') as unchanged, count(*) filter (live_status = 'added') as added,
  count(*) filter (live_status = 'removed') as removed, count(*) filter (live_status = 'pending') as pending from live group by run_id""")
def a6(v):
    return R.live_counts(*_live(v))


@query("a18_elapsed_and_eta", _D + f"""
select run_id, total, done, elapsed_sec, mean_sec, elapsed_sec / done * (total - done) as remaining_sec from (
  select run_id, count(*) as total, count(*) filter (not {_PENDING}) as done, sum(elapsed_sec) filter (not {_PENDING}) as elapsed_sec,
    avg(elapsed_sec) filter (not {_PENDING}) as mean_sec from details join orders on o_orderkey = seq group by run_id) where done > 0""")
def a18(v):
    pages, done = _live(v)
    return R.elapsed_and_eta(done, pages.groupBy("run_id").agg(F.count("*").alias("total")))


def _listed(ranges, keys):
    """Ranges written out as the numbers they hold, for the check."""
    numbers = F.flatten(F.sort_array(F.collect_list(F.sequence("first", "last"))))
    return ranges.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_join(numbers, ",").alias("seqs"))


@query("a20_group_page_settings", view_ctes("overrides") + """
select run_id, dpi, diff_strictness, stroke_tol, count(*) as n, array_to_string(list_sort(list(seq)), ',') as seqs from overrides group by run_id, dpi, diff_strictness, stroke_tol""")
def a20(v):
    names = ["dpi", "diff_strictness", "stroke_tol"]
    return _listed(P.group_page_settings(v.view("overrides"), names), ["run_id", *names])


_SEL = _D.rstrip() + """,
sel as (select run_id, seq, case when seq % 37 = 0 then 'excluded' when status = 'added' then 'added' when status = 'removed' then 'removed'
  when a_page is null or b_page is null then 'one_sided' when status <> 'matched' then 'not_matched' when change_level = 'unchanged' then 'unchanged'
  when coalesce(diff_percent, 0) <= 0 and coalesce(bboxes_count, 0) <= 0 then 'no_diff' end as skip_reason from details)"""


def _selected(v):
    details = v.view("details")
    return S.select_for_review(details, details.filter("seq % 37 = 0"))


@query("f4_select_for_review", _SEL + "select run_id, seq, skip_reason from sel")
def f4(v):
    return _selected(v).select("run_id", "seq", "skip_reason")


@query("a21_skip_reason_counts", _SEL + """
select run_id, skip_reason, count(*) as n, array_to_string(list_sort(list(seq)), ',') as seqs from sel where skip_reason is not null group by all""")
def a21(v):
    return _listed(S.skip_reason_counts(_selected(v)), ["run_id", "skip_reason"])


@query("f5_limit_sheets", _SEL.rstrip() + """
select run_id, seq from (select run_id, seq, row_number() over (partition by run_id order by seq) as n from sel
  where skip_reason is null and run_id in (select c_custkey from customer where c_mktsegment <> 'BUILDING')) where n <= 2""")
def f5(v):
    eligible = _selected(v).filter("skip_reason is null")
    wanted = v.table("customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("run_id"))
    listed = eligible.join(wanted, "run_id").select("run_id", "seq")
    return S.limit_sheets(S.restrict_seqs(eligible, listed), 2).select("run_id", "seq")


@query("a22_mixed_precision_flags", _D + """
select run_id, bool_or(mixed_settings) as is_mixed, count(*) filter (mixed_settings) as mixed_count,
  coalesce(array_to_string(list_sort(list(seq) filter (mixed_settings)), ','), '') as mixed_seqs from details group by run_id""")
def a22(v):
    details = v.view("details")
    mixed = _listed(R.mixed_ranges(details).withColumn("n", F.lit(0)), ["run_id"]).select("run_id", F.col("seqs").alias("mixed_seqs"))
    return R.mixed_precision_flags(details).join(mixed, "run_id", "left").fillna("", ["mixed_seqs"])


@query("w2_view_order", _D + """
select run_id, seq, row_number() over (partition by run_id order by b_page is null, b_page, seq) as view_order from details""")
def w2(v):
    return R.view_order(v.view("details")).select("run_id", "seq", "view_order")


_E = "coalesce(nullif(diff_foreground_percent, 0), nullif(diff_percent, 0), 0)"


@query("o2_engineer_order", _D + f"select seq, {_E} as sort_value from details where status = 'matched' and change_level <> 'unchanged' order by sort_value desc, seq")
def o2(v):
    changed = v.view("details").filter("status = 'matched' and change_level <> 'unchanged'")
    return R.engineer_order(changed).select("seq", "sort_value")


@query("o3_matrix_order", _D + """
select seq, case when not coalesce(foreground_sparse, false) then diff_foreground_percent end as fg from details order by fg desc nulls last, seq""")
def o3(v):
    rows = R.matrix_order(v.view("details"), "diff_foreground_percent")
    return rows.select("seq", F.expr("case when not coalesce(foreground_sparse, false) then diff_foreground_percent end").alias("fg"))


@query("o4_level_rank_order", _D + f"select run_id, seq, {_RANK} as level_rank from details order by level_rank desc, seq")
def o4(v):
    ranked = R.with_status(v.view("details")).withColumn("level_rank", R.level_rank(F.col("dist_key")))
    return ranked.orderBy(F.col("level_rank").desc(), "seq").select("run_id", "seq", "level_rank")


@query("o7_details_by_seq", _D + "select run_id, seq, status from details order by run_id, seq")
def o7(v):
    return v.view("details").select("run_id", "seq", "status").orderBy("run_id", "seq")


_FIRST = """own as (select run_id, seq, max(dpi) as dpi, max(diff_strictness) as diff_strictness, max(stroke_tol) as stroke_tol from overrides group by all)"""


@query("j8_resolve_settings", view_ctes("details", "overrides", "run_defaults").rstrip() + f""",
{_FIRST}
select d.run_id, d.seq, coalesce(o.dpi, 450, r.dpi, 250) as dpi, coalesce(o.diff_strictness, r.diff_strictness, 'normal') as diff_strictness,
  coalesce(o.stroke_tol, r.stroke_tol, 2) as stroke_tol
from details d left join own o using (run_id, seq) left join run_defaults r on r.run_id = d.run_id""")
def j8(v):
    rows = v.view("details").select("run_id", "seq")
    return P.resolve_settings(rows, v.view("overrides"), v.view("run_defaults"), {"dpi": 450})


@query("j8_override_problems", view_ctes("details", "overrides") + """
select run_id, seq, 'page_not_in_report' as error_key from (select distinct run_id, seq from overrides) o anti join details d using (run_id, seq)
union all select run_id, seq, 'page_settings_duplicate' from (select * from overrides union all select * from overrides where seq % 3 = 0) group by run_id, seq having count(*) > 1""")
def j8b(v):
    overrides = v.view("overrides")
    twice = overrides.unionByName(overrides.filter("seq % 3 = 0"))
    return P.override_problems(v.view("details"), twice)


@query("x2_missing_seqs", view_ctes("details", "overrides") + "select distinct run_id, seq from overrides o anti join details d using (run_id, seq)")
def x2(v):
    return v.view("overrides").select("run_id", "seq").exceptAll(
        v.view("details").select("run_id", "seq")
    ).distinct()


@query("s7_replace_rows", _D + """
select run_id, seq, case when seq % 9 = 0 then 'major' else change_level end as change_level, case when seq % 9 = 0 then 99e0 else diff_percent end as diff_percent from details""")
def s7(v):
    details = v.view("details").select("run_id", "seq", "change_level", "diff_percent")
    updates = details.filter("seq % 9 = 0").withColumns({"change_level": F.lit("major"), "diff_percent": F.lit(99.0)})
    return R.replace_rows(details, updates)


@query("s5_page_map_rows", _D + """
select run_id, seq, a_page, b_page, status, score, diff_percent, change_level, bboxes_count, diff_strictness, high_dpi, diff_area_mm2, foreground_sparse, elapsed_sec, cast(null as string) as width_px from details""")
def s5(v):
    details = v.view("details")
    path = scratch_path(v.spark, "page-map")
    writers.page_map_rows(details, ["run_id"]).write.option("header", True).csv(path)
    read = v.spark.read.option("header", True).schema(
        "run_id bigint, seq bigint, a_page bigint, b_page bigint, status string, score double, diff_percent double, change_level string, "
        "bboxes_count bigint, excluded_regions_count bigint, diff_strictness string, high_dpi bigint, stroke_tol_px double, bbox_merge_gap_mm double, "
        "bbox_merge_max_area_ratio double, ignore_line_weight boolean, ecc_failed boolean, width_px string, height_px bigint, pixel_count bigint, "
        "diff_area_px bigint, diff_area_mm2 double, diff_foreground_percent double, foreground_px bigint, added_px bigint, removed_px bigint, "
        "added_area_mm2 double, removed_area_mm2 double, max_region_area_mm2 double, foreground_sparse boolean, elapsed_sec double"
    ).csv(path)
    return read.select(
        "run_id", "seq", "a_page", "b_page", "status", "score", "diff_percent", "change_level", "bboxes_count", "diff_strictness",
        "high_dpi", "diff_area_mm2", "foreground_sparse", "elapsed_sec", "width_px",
    )


@query("s6_report_model", _D + f"""
select run_id, count(*) as n_pages, arg_min(seq, (b_page is null, b_page, seq)) as first_seq, count(*) filter ({_SIMPLE} = 'CHANGED') as changed,
  count(*) filter (mixed_settings) as mixed from details group by run_id""")
def s6(v):
    documents = writers.report_documents(v.view("details"), v.view("run_defaults"))
    # a run is read from its parts again; ranges of sheets with settings of their own stand in the first one
    mixed = F.aggregate("settings.mixed_precision", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    head = F.col("part") == 0
    return documents.groupBy("run_id").agg(
        F.sum(F.size("pages")).alias("n_pages"), F.max(F.when(head, F.col("pages")[0]["seq"])).alias("first_seq"),
        F.max(F.when(head, F.col("summary.counts.changed"))).alias("changed"), F.sum(mixed).alias("mixed"),
    )


@query("s3_explode_pairs", """
select o_custkey as run_dir, o_orderkey as seq, 'matched' as status, o_totalprice as diff_percent from orders where o_orderpriority <> '5-LOW'""")
def s3(v):
    pair = F.to_json(
        F.struct(F.col("o_orderkey").alias("seq"), F.lit("matched").alias("status"), F.col("o_totalprice").alias("diff_percent"))
    )
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit('{"pairs": 1}')).otherwise(F.concat(F.lit("["), pair, F.lit("]")))
    summaries = v.table("orders").select(F.col("o_custkey").alias("run_dir"), text.alias("pairs"))
    return readers.explode_pairs(summaries).select("run_dir", "seq", "status", "diff_percent")


@query("s4_read_boxes", """
select l_orderkey, l_linenumber, l_partkey % 50 as x, l_suppkey % 60 as y, cast(l_quantity as bigint) - 3 as w, l_linenumber as h from lineitem where l_quantity > 3 and l_linenumber <> 5
union all select l_orderkey, l_linenumber, 1, 2, 3, 4 from lineitem""")
def s4(v):
    bad = F.when(F.col("l_linenumber") == 5, F.lit('"oops"')).otherwise((F.col("l_partkey") % 50).cast("string"))
    text = F.concat(
        F.lit('[{"x":'), bad, F.lit(',"y":'), F.col("l_suppkey") % 60, F.lit(',"w":'), F.col("l_quantity").cast("long") - 3,
        F.lit(',"h":'), F.col("l_linenumber"), F.lit('},{"x":1,"y":2,"w":3},{"x":1,"y":2,"w":3,"h":4}]'),
    )
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", text.alias("boxes"))
    return readers.read_boxes(rows, "boxes", ["l_orderkey", "l_linenumber"]).drop("pos")

