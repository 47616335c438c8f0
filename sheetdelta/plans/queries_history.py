"""Queries over run history and earlier runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import records as H
from sheetdelta.operators import history as O
from sheetdelta.plans.queries_text import revision_sql
from sheetdelta.plans.registry import query
from sheetdelta.session import scratch_path
from sheetdelta.sources import readers, writers
from sheetdelta.sources.testviews import view_ctes

_R = view_ctes("runs").rstrip()
_RESULT = """case lower(trim(coalesce(result, ''))) when 'ok' then 'done' when 'done' then 'done' when 'completed' then 'done' when 'cancelled' then 'cancelled'
  when 'canceled' then 'cancelled' when 'error' then 'failed' when 'failed' then 'failed' when 'snapshot' then 'snapshot' when '' then 'unknown' else lower(trim(result)) end"""
_ID = """case when source = 'mcp' and trim(job_id) <> '' then concat('mcp:', trim(job_id))
  else concat(source, ':', substr(sha1(concat_ws('|', ts, old_pdf, new_pdf, out_dir, run_dir, result)), 1, 8)) end"""
_INT = lambda c, d: f"cast(coalesce(trunc(try_cast(nullif(trim({c}), '') as double)), {d}) as bigint)"
_NUM = lambda c, d: f"coalesce(try_cast(nullif(trim({c}), '') as double), {d})"
_YES = lambda c: f"lower(trim({c})) in ('on', '1', 'true', 'yes', 'да')"
_NAME = "case when run_name <> '' then run_name else regexp_extract(run_dir, '[^/]*$') end"


def runs_of(v):
    return O.normalize_records(v.view("runs"))


@query("p38_normalize_result", _R + f" select append_pos, {_RESULT} as result from runs")
def p38(v):
    return v.view("runs").select("append_pos", H.normalize_result(F.col("result")).alias("result"))


@query("p39_stable_id", _R + f" select append_pos, {_ID} as id from runs")
def p39(v):
    runs = v.view("runs")
    return runs.select("append_pos", H.stable_id(F.col("source"), {c: F.col(c) for c in runs.columns}).alias("id"))


@query("p40_replay_settings", _R + f""" select append_pos, {_INT('dpi', 250)} as dpi, {_NUM('stroke_tol', '2e0')} as stroke_tol,
  coalesce(nullif(diff_strictness, ''), 'normal') as diff_strictness, exclude_regions,
  case when source = 'ui' then case when {_YES('bbox_merge')} then {_NUM('bbox_merge_gap', '5e0')} else 0 end else {_NUM('bbox_merge_gap_mm', '0e0')} end as bbox_merge_gap_mm,
  case when source = 'ui' then {_NUM('bbox_merge_max_ratio', '16e0')} else {_NUM('bbox_merge_max_area_ratio', '16e0')} end as bbox_merge_max_area_ratio,
  case when source = 'ui' then {_YES('keep_debug')} else {_YES('keep_debug_images')} end as keep_debug_images, {_YES('ignore_line_weight')} as ignore_line_weight from runs""")
def p40(v):
    return runs_of(v).select("append_pos", "replay.*")


@query("x1_union_sources", _R + f" select {_ID} as id, source, {_RESULT} as result, {_NAME} as run_name from runs")
def x1(v):
    runs = v.view("runs")
    both = O.union_sources(runs.filter("source = 'ui'"), runs.filter("source = 'mcp'"))
    return O.normalize_records(both).select("id", "source", "result", "run_name")


_NUMBERED = _R + f""", numbered as (select {_ID} as id, ts as "date", {_RESULT} as result, {_NAME} as run_name, append_pos,
  row_number() over (order by ts desc, case source when 'ui' then 0 else 1 end, append_pos) as "index" from runs)"""


@query("w1_number_runs", _NUMBERED + ' select id, "index" from numbered')
def w1(v):
    return O.number_runs(runs_of(v)).select("id", "index")


@query("o6_latest_runs", _NUMBERED + ' select id, "date", "index" from numbered where "index" <= 50')
def o6(v):
    return O.latest_runs(runs_of(v), 50).select("id", "date", "index")


_REFS = "select case when event_id % 3 = 0 then concat(' #', cast(event_id + 1 as string)) when event_id % 3 = 1 then concat('mcp:job-', cast(event_id as string)) else '#none' end as ref from {}"


@query("j11_find_run", _NUMBERED + f""", refs as (select distinct trim(ref) as ref from ({_REFS.format('events')})),
hits as (select r.ref, n.*, 0 as way from refs r join numbered n on n.id = r.ref
  union all select r.ref, n.*, 1 from refs r join numbered n on cast(n."index" as string) = ltrim(r.ref, '# '))
select ref, id, "index", "date", result, run_name from (select *, row_number() over (partition by ref order by way, "index") as n from hits) where n = 1""")
def j11(v):
    v.table("events").createOrReplaceTempView("testview_events")
    return O.find_run(runs_of(v), v.spark.sql(_REFS.format("testview_events")))


@query("w7_retain_last", _R + " select append_pos from (select append_pos, row_number() over (partition by source order by append_pos desc) as n from runs) where n <= 300")
def w7(v):
    return O.retain_last(v.view("runs")).select("append_pos")


@query("w7_retained_jobs", """
with jobs as (select user_id as job_id, max(ts) as touched, arg_max(event_type, (ts, event_id)) in ('view', 'click') as active from events group by user_id),
idle as (select job_id, row_number() over (order by touched desc, job_id desc) as n from jobs where not active and touched >= timestamp '2024-01-30 00:00:00' - interval 30 days)
select job_id, true as active from jobs where active union all select job_id, false from idle where n <= 50""")
def w7b(v):
    jobs = v.table("events").groupBy(F.col("user_id").alias("job_id")).agg(
        F.max("ts").alias("touched"),
        F.max_by("event_type", F.struct("ts", "event_id")).isin("view", "click").alias("active"),
    )
    return O.retained_jobs(jobs, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("job_id", "active")


@query("f8_search_runs", _R + " select append_pos from runs where upper(result) in ('DONE', 'OK') and contains(lower(concat_ws(' ', old_pdf, new_pdf, out_dir, run_dir)), 'ab')")
def f8(v):
    return O.search_runs(v.view("runs"), " AB", "done").select("append_pos")


_TAIL = r"(?i)[-_ ]*(?:rev(?:ision)?|r|рев|ревизия|р)?[-_ ]*[A-Za-zА-Яа-я]?\d+[A-Za-zА-Яа-я]*$"


@query("w8_revision_chain", view_ctes("catalog").rstrip() + f""", r as (select doc, name, {revision_sql('name')} as revision from catalog),
b as (select doc, revision, case when revision is null then name else regexp_replace(name, '{_TAIL}', '') end as base,
  coalesce(try_cast(nullif(regexp_extract(revision, '(\\d+)', 1), '') as bigint), -1) as number from r)
select base, doc, revision, lag(doc) over w as previous_doc, lag(revision) over w as previous_revision from b window w as (partition by base order by number, doc)""")
def w8(v):
    return O.revision_chain(v.view("catalog"))


@query("s9_read_history", _R + f" select source, append_pos, ts, {_RESULT} as result, {_ID} as id from runs")
def s9(v):
    runs = v.view("runs")
    paths = {}
    for source in ("ui", "mcp"):
        rows = runs.filter(F.col("source") == source)
        # stores are capped documents; these are written one per block of appends to stay small
        block = rows.groupBy(F.floor(F.col("append_pos") / 500).alias("b")).agg(
            F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("append_pos", *[c for c in runs.columns if c not in ("append_pos", "source")]))).alias("history"))).alias("value")
        )
        paths[source] = scratch_path(v.spark, f"history-{source}")
        block.repartition(F.col("b")).select("value", "b").write.partitionBy("b").text(paths[source])
    read = readers.read_history(v.spark, paths["ui"] + "/*", paths["mcp"] + "/*")
    # the place in the block is not the place in the store; names carry the event number
    number = F.regexp_extract("run_dir", r"(\d+)$", 1).cast("long")
    return read.withColumn("append_pos", number).select(
        "source", "append_pos", "ts", H.normalize_result(F.col("result")).alias("result"),
        H.stable_id(F.col("source"), {c: F.col(c) for c in read.columns}).alias("id"),
    )


@query("s10_append_history", _R + """ select append_pos from (select append_pos, row_number() over (partition by source order by append_pos desc) as n from runs) where n <= 300""")
def s10(v):
    runs = v.view("runs")
    path = scratch_path(v.spark, "history")
    writers.append_history(runs.filter("append_pos % 2 = 0"), path)
    writers.append_history(runs.filter("append_pos % 2 = 1"), path)
    return O.retain_last(v.spark.read.schema(runs.schema).json(path)).select("append_pos")


@query("s2_read_run_summaries", """
select concat('run_', o_custkey) as run, count(*) as n_pairs, min(o_orderkey) as first_seq from orders group by o_custkey""")
def s2(v):
    pair = F.struct(F.col("o_orderkey").alias("seq"), F.lit("matched").alias("status"))
    body = v.table("orders").groupBy("o_custkey").agg(
        F.to_json(F.struct(F.concat(F.lit("a"), F.first("o_custkey").cast("string")).alias("file_a"), F.sort_array(F.collect_list(pair)).alias("pairs"))).alias("value")
    )
    root = scratch_path(v.spark, "summaries")
    # summaries of many runs are kept one per line in the run store; each line is one run's document
    body.select("value").write.text(root)
    pairs = readers.explode_pairs(readers.read_summary_lines(v.spark, root), keys=("file_a",))
    return pairs.groupBy(F.concat(F.lit("run_"), F.substring("file_a", 2, 20)).alias("run")).agg(F.count("*").alias("n_pairs"), F.min("seq").alias("first_seq"))


def _matches(v):
    runs = v.view("runs").select(
        F.col("append_pos").alias("run_id"), F.col("ts").alias("created_at"), F.col("old_pdf").alias("file_a"), F.col("new_pdf").alias("file_b")
    )
    pairs = v.view("runs").groupBy("old_pdf", "new_pdf").agg(F.min("append_pos").alias("pair_id")).select(
        "pair_id", F.col("old_pdf").alias("old_path"), F.regexp_replace("new_pdf", "C:/in", "D:/new").alias("new_path")
    )
    return O.match_existing_runs(pairs, runs)


_STEM = r"regexp_replace(regexp_extract({}, '[^/]*$'), '\.[^.]*$', '')"
# all name pairs against all runs, without any blocking
_FOUND = _R + f""", p as (select min(append_pos) as pair_id, old_pdf as o, replace(new_pdf, 'C:/in', 'D:/new') as n from runs group by old_pdf, new_pdf),
names as (select distinct lower(concat_ws(' ', {_STEM.format('o')}, {_STEM.format('n')})) as asked from p),
stems as (select distinct lower(concat_ws(' ', {_STEM.format('old_pdf')}, {_STEM.format('new_pdf')})) as s, lower(concat_ws(' ', {_STEM.format('new_pdf')}, {_STEM.format('old_pdf')})) as r from runs),
near as (select * from (select asked, s, greatest(1 - levenshtein(asked, s) / greatest(len(asked), len(s)), 1 - levenshtein(asked, r) / greatest(len(asked), len(r))) as ratio from names, stems) where ratio >= 0.72),
hit as (select pair_id, append_pos as run_id, ts as created_at,
    case when lower(o) = lower(old_pdf) and lower(n) = lower(new_pdf) then 1e0 when lower(o) = lower(new_pdf) and lower(n) = lower(old_pdf) then 0.98e0
      when lower(regexp_extract(o, '[^/]*$')) = lower(regexp_extract(old_pdf, '[^/]*$')) and lower(regexp_extract(n, '[^/]*$')) = lower(regexp_extract(new_pdf, '[^/]*$')) then 0.95e0
      when lower(regexp_extract(o, '[^/]*$')) = lower(regexp_extract(new_pdf, '[^/]*$')) and lower(regexp_extract(n, '[^/]*$')) = lower(regexp_extract(old_pdf, '[^/]*$')) then 0.93e0 end as named, ratio
  from p join near on asked = lower(concat_ws(' ', {_STEM.format('o')}, {_STEM.format('n')}))
    join runs on s = lower(concat_ws(' ', {_STEM.format('old_pdf')}, {_STEM.format('new_pdf')}))),
found as (select pair_id, run_id, created_at, round(coalesce(named, ratio), 9) as similarity,
  case named when 1 then 'exact_paths' when 0.98 then 'exact_paths_reversed' when 0.95 then 'exact_file_names' when 0.93 then 'exact_file_names_reversed' else 'similar_file_names' end as reason from hit)"""


@query("j10_match_existing_runs", _FOUND + " select * from found")
def j10(v):
    return _matches(v).withColumn("similarity", F.round("similarity", 9))


@query("f10_o5_similar_runs", _FOUND + """ select * from (select *, row_number() over (partition by pair_id order by similarity desc, created_at desc, run_id desc) as place from found) where place <= 10""")
def o5(v):
    return O.similar_runs(_matches(v).withColumn("similarity", F.round("similarity", 9)), 10)


@query("o8_jobs_newest_first", """
select concat('job-', event_id) as job_id, strftime(case when event_id % 3 = 0 then null else ts end, '%Y-%m-%d %H:%M:%S') as created_at, strftime(ts, '%Y-%m-%d %H:%M:%S') as started_at
from events order by strftime(ts, '%Y-%m-%d %H:%M:%S') desc, job_id""")
def o8(v):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    jobs = v.table("events").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.when(F.col("event_id") % 3 != 0, text).alias("created_at"), text.alias("started_at"),
    )
    return O.jobs_newest_first(jobs)
