"""Input tables of the operators, derived from the shared test tables.

Each view is one SQL text that Spark and the checking engine both read, so that
a query and its check start from the same rows. ``$name`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.sources.readers import describe_sheets

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Two revisions of one document: every eighth sheet is missing on either side,
# some move, some are edited, some change their mark or their paper size.
SHEETS_BASE = """
select doc_pair, rev, cast(row_number() over (partition by doc_pair, rev order by okey, doc_id) - 1 as bigint) as idx,
  doc_id, k, text, width_pt, height_pt, drawing_id
from (
  select doc_pair, 'A' as rev, doc_id, k, doc_id as okey,
    concat(case when k % 3 = 1 then concat('SHEET ', cast(k as string), ' ')
                when k % 3 = 2 then concat('Лист № ', cast(k as string), ' ') else '' end, text) as text,
    case when k % 5 = 0 then 842e0 else 595e0 end as width_pt,
    case when k % 5 = 0 then 1191e0 else 842e0 end as height_pt,
    case when k % 4 = 3 then concat('P1-AA-BB-CC-DD-DWG-', cast(100000 + doc_id as string)) end as drawing_id
  from (select concat(source, '/', cast(cast(floor(doc_id / 2000) as bigint) as string)) as doc_pair, doc_id,
          cast(floor(doc_id / 20) as bigint) as k, text from $documents) d
  where k % 8 <> 1
  union all
  select doc_pair, 'B' as rev, doc_id, k, doc_id + case when k % 8 = 5 then 300 else 0 end as okey,
    concat(case when k % 3 = 1 then concat('SHEET ', cast(k + case when k % 7 = 3 then 1 else 0 end as string), ' ')
                when k % 3 = 2 then concat('Лист № ', cast(k as string), ' ') else '' end, text,
           case when k % 4 = 2 then concat(' REVISED NOTE ALPHA BRAVO ', cast(doc_id as string)) else '' end) as text,
    case when k % 16 = 3 then 1191e0 when k % 16 = 7 then 842e0 when k % 5 = 0 then 842e0 else 595e0 end as width_pt,
    case when k % 16 = 3 then 1684e0 when k % 16 = 7 then 595e0 when k % 5 = 0 then 1191e0 else 842e0 end as height_pt,
    case when k % 4 = 3 then concat('P1-AA-BB-CC-DD-DWG-', cast(100000 + doc_id as string)) end as drawing_id
  from (select concat(source, '/', cast(cast(floor(doc_id / 2000) as bigint) as string)) as doc_pair, doc_id,
          cast(floor(doc_id / 20) as bigint) as k, text from $documents) d
  where k % 8 <> 0
) s
"""

# The same with long revisions: all sheets of a language are one document pair.
SHEETS_BASE_LONG = SHEETS_BASE.replace(
    "concat(source, '/', cast(cast(floor(doc_id / 2000) as bigint) as string))", "coalesce(lang, 'none')"
)

# Every sheet of the longer revision with a partner; those of the shorter one come round again.
PARTNERS = f"""
select s.doc_pair, s.idx as k, s.idx % c.n_a as ka, s.idx % c.n_b as kb
from ({SHEETS_BASE}) s join (
  select doc_pair, count(case when rev = 'A' then 1 end) as n_a, count(case when rev = 'B' then 1 end) as n_b
  from ({SHEETS_BASE}) t group by doc_pair
) c on s.doc_pair = c.doc_pair
where c.n_a > 0 and c.n_b > 0 and s.rev = case when c.n_a >= c.n_b then 'A' else 'B' end
"""

CELLS = """
select distinct 'lattice' as doc_pair, l_suppkey as seq, case when l_linenumber % 2 = 0 then 'A' else 'B' end as rev,
  l_partkey % 64 as x, l_orderkey % 64 as y
from $lineitem
"""

GRAY = """
select 'lattice' as doc_pair, l_suppkey as seq, case when l_linenumber % 2 = 0 then 'A' else 'B' end as rev,
  l_partkey % 64 as x, l_orderkey % 64 as y, min(cast(floor(l_extendedprice) as bigint) % 256) as v
from $lineitem
group by l_suppkey, case when l_linenumber % 2 = 0 then 'A' else 'B' end, l_partkey % 64, l_orderkey % 64
"""

DIMS = """
select distinct 'lattice' as doc_pair, l_suppkey as seq, cast(64 as bigint) as width, cast(64 as bigint) as height, 72e0 as dpi
from $lineitem
"""

DETAILS = """
select o_custkey as run_id, o_orderkey as seq,
  case when o_orderkey % 11 = 1 then null else o_orderkey % 200 + 1 end as a_page,
  case when o_orderkey % 11 = 2 or o_orderkey % 97 = 5 then null
       else o_orderkey % 200 + 1 + case when o_orderkey % 13 = 0 then 1 else 0 end end as b_page,
  case when o_orderkey % 11 = 1 then 'added' when o_orderkey % 11 = 2 then 'removed'
       when o_orderkey % 11 = 3 then 'size_mismatch' else 'matched' end as status,
  (o_orderkey % 101) / 100e0 as score,
  case when o_orderkey % 11 in (1, 2, 3) then null when o_orderkey % 5 = 0 then 0e0
       when o_orderkey % 5 = 1 then (o_orderkey % 100) / 1000e0 else o_totalprice / 100000e0 end as diff_percent,
  case when o_orderkey % 11 in (1, 2, 3) or o_orderkey % 17 = 0 then null when o_orderkey % 5 = 0 then 0e0
       when o_orderkey % 5 = 1 then 0.5e0 else o_totalprice / 20000e0 end as diff_foreground_percent,
  case when o_orderkey % 11 in (1, 2, 3) then null else o_orderkey % 19 = 0 end as foreground_sparse,
  case when o_orderkey % 23 = 0 then null when o_orderkey % 5 > 1 then o_totalprice / 30e0 else 0e0 end as max_region_area_mm2,
  case when o_orderkey % 11 in (1, 2, 3) then null when o_orderkey % 5 = 0 then 0
       when o_orderkey % 5 = 1 then o_orderkey % 3 else o_orderkey % 60 end as bboxes_count,
  case when o_orderkey % 11 in (1, 2, 3) then null else o_totalprice / 10e0 end as diff_area_mm2,
  case when o_orderkey % 11 in (1, 2) or o_orderkey % 29 = 0 then null when o_orderkey % 11 = 3 then 'size_mismatch'
       when cast(floor(o_orderkey / 7) as bigint) % 4 = 0 then 'unchanged'
       when cast(floor(o_orderkey / 7) as bigint) % 4 = 1 then 'minor'
       when cast(floor(o_orderkey / 7) as bigint) % 4 = 2 then 'moderate' else 'major' end as change_level,
  o_orderkey % 31 = 0 as ecc_failed,
  (o_orderkey % 9) / 20e0 as alignment_shift_x_mm, (o_orderkey % 4) / 10e0 as alignment_shift_y_mm,
  (o_orderkey % 50) / 10e0 as elapsed_sec,
  case when o_orderkey % 3 = 0 then 250 when o_orderkey % 3 = 1 then 300 else 400 end as high_dpi,
  2e0 as stroke_tol_px, case when o_orderkey % 4 = 0 then 'strict' else 'normal' end as diff_strictness,
  o_orderpriority in ('1-URGENT', '2-HIGH') as mixed_settings
from $orders
"""

# settings named for single pages, with doubles and pages that do not exist
OVERRIDES = """
select o_custkey as run_id, o_orderkey + case when o_orderkey % 43 = 0 then 100000000 else 0 end as seq,
  case when o_orderpriority = '1-URGENT' then 600 end as dpi,
  case when o_orderpriority = '2-HIGH' then 'loose' end as diff_strictness,
  (o_orderkey % 5) / 2e0 as stroke_tol
from $orders where o_orderpriority in ('1-URGENT', '2-HIGH')
"""

RUN_DEFAULTS = """
select c_custkey as run_id, case when c_mktsegment = 'BUILDING' then null else 200 + c_nationkey end as dpi,
  case when c_nationkey % 2 = 0 then 'strict' end as diff_strictness,
  case when c_nationkey % 3 = 0 then 1.5e0 end as stroke_tol
from $customer
"""

RUNS = """
select case when user_id % 2 = 0 then 'ui' else 'mcp' end as source, event_id as append_pos,
  concat('2024-', cast(10 + event_id % 90 as string), ' ', cast(event_id % 7 as string)) as ts,
  case event_type when 'signup' then 'OK' when 'view' then 'completed' when 'error' then 'error'
    when 'click' then 'Canceled' else case when event_id % 3 = 0 then '' else 'snapshot' end end as result,
  case when user_id % 2 = 1 and event_id % 4 <> 0 then concat('job-', cast(event_id as string)) else '' end as job_id,
  concat('C:/in/', substr(translate(md5(cast(user_id as string)), '0123456789', 'ghijklmnop'), 1, 12), '_R', cast(event_id % 9 as string), '.pdf') as old_pdf,
  concat('C:/in/', substr(translate(md5(cast(user_id as string)), '0123456789', 'ghijklmnop'), 1, 12), '_R', cast(event_id % 9 + 1 as string), '.pdf') as new_pdf,
  'C:/out' as out_dir, concat('C:/out/run_', cast(event_id as string)) as run_dir,
  case when event_id % 2 = 0 then '' else concat('run ', cast(event_id as string)) end as run_name,
  case when event_id % 5 = 0 then '' when event_id % 5 = 1 then 'abc' else cast(100 + event_id % 300 as string) end as dpi,
  case when event_id % 6 = 0 then '' else cast(value as string) end as stroke_tol,
  case when event_id % 7 = 0 then '' else 'strict' end as diff_strictness, '' as exclude_regions,
  case when event_id % 2 = 0 then 'on' else 'off' end as bbox_merge,
  case when event_id % 3 = 0 then '' else '7.5' end as bbox_merge_gap,
  '12' as bbox_merge_max_ratio, cast(event_id % 4 as string) as bbox_merge_gap_mm, '' as bbox_merge_max_area_ratio,
  case when event_id % 2 = 0 then 'да' else 'no' end as keep_debug, 'TRUE' as keep_debug_images,
  case when event_id % 3 = 0 then '1' else '' end as ignore_line_weight
from $events
"""

# a job is one day of one user; its last event decides how it ends
JOB_EVENTS = """
select concat(cast(user_id as string), '-', cast(ts as date)) as job_id, ts as at_ts, event_id,
  case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running'
    when 'purchase' then 'completed' else 'failed' end as state,
  value as progress, concat('page ', cast(event_id % 40 as string), ' / ', cast(event_id % 40 + 5 as string)) as message,
  case when event_id % 10 = 0 then 'rerender' else 'compare' end as operation
from $events
"""

USAGE = """
select event_id, user_id, event_type, cast(floor(value * 100) as bigint) - 50 as prompt_tokens,
  event_id % 3000 as completion_tokens, event_id % 2000 as cached_prompt_tokens,
  ts as at_ts, event_id % 4 = 0 as cached, event_id % 41 = 0 as failed
from $events
"""

CATALOG = """
select p_partkey as doc,
  case p_partkey % 5 when 0 then concat(p_name, '_R', cast(p_size as string))
    when 1 then concat(p_name, ' rev ', cast(p_size as string), 'b') when 2 then concat(p_name, '-Ревизия ', cast(p_size as string))
    when 3 then concat(p_name, 'A', cast(p_size as string)) else p_name end as name,
  concat('C:\\\\docs\\\\', p_brand, '\\\\', p_name, '_r', cast(p_size as string), '.pdf') as path,
  concat(p_name, '_', p_type, '_R', cast(p_size + 1 as string)) as other,
  p_name, p_size
from $part
"""

REGIONS = """
select o_orderkey as region_no, u.unit, a.anchor,
  case when u.unit in ('mm', 'px') then (o_orderkey % 300) / 3e0 else (o_orderkey % 60) / case when u.unit = 'ratio' then 100e0 else 1e0 end end as x,
  case when u.unit in ('mm', 'px') then (o_orderkey % 170) / 7e0 else (o_orderkey % 50) / case when u.unit = 'ratio' then 100e0 else 1e0 end end as y,
  case when u.unit in ('mm', 'px') then 1e0 + (o_orderkey % 40) / 3e0 else (1 + o_orderkey % 39) / case when u.unit = 'ratio' then 100e0 else 1e0 end end as w,
  case when u.unit in ('mm', 'px') then 1e0 + (o_orderkey % 30) / 7e0 else (1 + o_orderkey % 47) / case when u.unit = 'ratio' then 100e0 else 1e0 end end as h,
  200 + o_orderkey % 1000 as width_px, 300 + o_orderkey % 900 as height_px, 72e0 + o_orderkey % 300 as dpi
from $orders
join (select 0 as uk, 'percent' as unit union all select 1, 'ratio' union all select 2, 'mm' union all select 3, 'px') u
  on u.uk = o_orderkey % 4
join (select 0 as ak, 'top_left' as anchor union all select 1, 'top-right' union all select 2, 'BL' union all select 3, 'right_bottom') a
  on a.ak = cast(floor(o_orderkey / 4) as bigint) % 4
"""

ZONES = """
select 'lattice' as doc_pair, l_suppkey as seq, l_orderkey * 10 + l_linenumber as zone_id,
  min(l_partkey) % 50 as x, l_orderkey % 50 as y, 1 + cast(min(l_quantity) as bigint) % 14 as w, cast(1 + l_linenumber as bigint) as h
from $lineitem group by l_suppkey, l_orderkey, l_linenumber
"""

EXCLUSIONS = """
select 'lattice' as doc_pair, s_suppkey as seq, b.region_no, 5 + s_suppkey % 20 + 20 * b.region_no as x, 3 + s_suppkey % 30 as y,
  cast(12 as bigint) as w, cast(15 as bigint) as h
from $supplier
join (select cast(0 as bigint) as region_no, 1 as one union all select cast(1 as bigint), 1) b on b.one = 1
"""

ZONE_TEXTS = """
select conv_id as seq, turn + 1 as zone_id, text,
  case when turn % 5 = 1 then concat('Возможно: ', text) when turn % 5 = 2 then concat('Сдвиг линии: ', text)
       when turn % 5 = 3 then concat('**Object ', cast(conv_id % 7 as string), '**: ', text) else text end as description,
  case when turn % 6 = 5 then concat('REF ', cast(turn as string)) else '' end as object_ref
from $conversations
"""

ANALYSIS = """
select doc_id as seq, case when doc_id % 3 = 0 then 'other' else 'main' end as model, 'prov' as provider, 'en' as lang,
  case when doc_id % 7 = 0 then 1 else 2 end as prompt_version,
  sha256(case when doc_id % 5 = 0 then concat('old', text) else text end) as fingerprint, text
from $documents
"""

VIEWS = {
    "cells": CELLS, "gray": GRAY, "dims": DIMS, "details": DETAILS, "overrides": OVERRIDES, "run_defaults": RUN_DEFAULTS,
    "runs": RUNS, "job_events": JOB_EVENTS, "usage": USAGE, "catalog": CATALOG, "regions": REGIONS, "zones": ZONES,
    "exclusions": EXCLUSIONS, "zone_texts": ZONE_TEXTS, "analysis": ANALYSIS, "sheets_base": SHEETS_BASE, "sheets_base_long": SHEETS_BASE_LONG,
    "partners": PARTNERS,
}


def view_sql(name: str) -> str:
    """The view's text over plain table names."""
    return re.sub(r"\$(\w+)", r"\1", VIEWS[name]).strip()


class Views:
    """Loads the test tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for field in df.schema:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name].replace("sha256(", "sha2(").replace("text end) as fingerprint", "text end, 256) as fingerprint")
        for table in set(re.findall(r"\$(\w+)", sql)):
            self.table(table).createOrReplaceTempView(f"testview_{table}")
        # "at" is a reserved word in the checking engine, so the shared text names it at_ts
        return self.spark.sql(re.sub(r"\$(\w+)", r"testview_\1", sql)).withColumnRenamed("at_ts", "at")

    def sheets(self, base: str = "sheets_base") -> DataFrame:
        """Both revisions of all sheets with text, tokens, mark and normalised thumbnail."""
        base = self.view(base)
        vectors = self.table("embeddings").select(
            F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
        )
        turned = F.transform("embedding", lambda x, i: F.when(i % 16 == 0, -x).otherwise(x))
        edited = (F.col("rev") == "B") & (F.col("k") % 4 == 2)
        count = vectors.agg(F.max("vec_id") + 1).first()[0] or 1
        joined = base.join(vectors, base["doc_id"] % count == vectors["vec_id"], "left").withColumn(
            "thumb", F.when(edited, turned).otherwise(F.col("embedding"))
        )
        return describe_sheets(joined.drop("vec_id", "embedding"))


# The same sheets for the checking engine, with tokens, mark and thumbnail written in its own dialect.
_RU = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ЛИСТ(?:\s*№)?|Л\.)\s*[:№#-]?\s*([A-ZА-Я]{0,3}\d{1,4}[A-ZА-Я]{0,3})"
_EN = r"(?i)(?:^|[^\p{L}\p{N}_])SHEET\s*[:#-]?\s*([A-Z]{0,3}\d{1,4}[A-Z]{0,3})(?:$|[^\p{L}\p{N}_])"
_FR = r"(?:^|[^\p{L}\p{N}_])(\d{1,3})\s*/\s*(\d{1,3})(?:$|[^\p{L}\p{N}_])"


def mark_sql(text: str) -> str:
    raw = f"coalesce(nullif(regexp_extract({text}, '{_RU}', 1), ''), nullif(regexp_extract({text}, '{_EN}', 1), ''), nullif(regexp_extract({text}, '{_FR}', 1), ''))"
    return f"replace(regexp_replace(upper(trim({raw})), '[\\s_]+', '', 'g'), '№', '')"


def tokens_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-zА-Яа-я0-9]{{3,}}'), lambda t: upper(t)))"


def sheets_cte(base: str = "sheets_base") -> str:
    return f"""
sheets0 as ({view_sql(base)}),
sheets1 as (
  select s.*, list_transform(e.embedding, lambda x, i: case when s.rev = 'B' and s.k % 4 = 2 and (i - 1) % 16 = 0
      then -cast(x as double) else cast(x as double) end) as raw
  from sheets0 s cross join (select max(vec_id) + 1 as vectors from embeddings) c
    left join embeddings e on e.vec_id = s.doc_id % c.vectors),
sheets as (
  select doc_pair, rev, idx, doc_id, text, width_pt, height_pt, drawing_id,
    {tokens_sql('text')} as tokens, {mark_sql('text')} as sheet_mark,
    list_transform(raw, lambda v: (v - list_min(raw)) * 255e0 / (list_max(raw) - list_min(raw))) as thumb
  from sheets1)"""


def view_ctes(*names: str) -> str:
    """``with`` clause over the named views; ``sheets`` and ``sheets_long`` add a full sheet table named sheets."""
    bases = {"sheets": "sheets_base", "sheets_long": "sheets_base_long"}
    parts = [sheets_cte(bases[n]).strip() if n in bases else f"{n} as ({view_sql(n)})" for n in names]
    return "with " + ",\n".join(parts) + "\n"
