"""Queries over text, identity and severity expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import text as T
from sheetdelta.plans.registry import query
from sheetdelta.sources.testviews import mark_sql, tokens_sql, view_ctes


@query("s1_read_sheets", view_ctes("sheets") + """
select doc_pair, rev, idx, len(text) as n_chars, width_pt, height_pt, drawing_id, sheet_mark, len(tokens) as n_tokens,
  len(thumb) as thumb_size, round(list_sum(thumb), 4) as thumb_sum from sheets""")
def s1(v):
    total = F.aggregate("thumb", F.lit(0.0), lambda a, x: a + x)
    return v.sheets().select(
        "doc_pair", "rev", "idx", F.length("text").cast("long").alias("n_chars"), "width_pt", "height_pt", "drawing_id",
        "sheet_mark", F.size("tokens").cast("long").alias("n_tokens"), F.size("thumb").cast("long").alias("thumb_size"),
        F.round(total, 4).alias("thumb_sum"),
    )


@query("p1_page_tokens", f"""
select doc_id, len(t) as n_tokens, array_to_string(list_sort(t), ' ') as tokens
from (select doc_id, {tokens_sql('text')} as t from documents)""")
def p1(v):
    tokens = T.page_tokens(F.col("text"))
    return v.table("documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens")
    )


@query("p2_sheet_mark", view_ctes("sheets_base") + f"""
select doc_pair, rev, idx, {mark_sql('text')} as mark from sheets_base""")
def p2(v):
    return v.view("sheets_base").select("doc_pair", "rev", "idx", T.sheet_mark(F.col("text")).alias("mark"))


@query("p3_normalize_mark", """
select p_partkey, replace(regexp_replace(upper(trim(raw)), '[\\s_]+', '', 'g'), '№', '') as mark
from (select p_partkey, concat('  № ', p_name, '_', p_type, ' ', cast(p_size as string), ' ') as raw from part)""")
def p3(v):
    raw = F.concat(F.lit("  № "), "p_name", F.lit("_"), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))
    return v.table("part").select("p_partkey", T.normalize_mark(raw).alias("mark"))


WORDS_SQL = """
lines as (select doc_pair, rev, idx, width_pt, height_pt, doc_id, drawing_id,
    unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from sheets_base),
words as (
  select doc_pair, rev, idx, width_pt, height_pt, x as x0, y as y0, x + 30 as x1, y + 10 as y1, word from (
    select *, (word_no * 37) % cast(width_pt as bigint) as x, (line_no * 12) % cast(height_pt as bigint) as y from (
      select *, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) as word_no from lines))
  where word <> ''
  union all
  select doc_pair, rev, idx, width_pt, height_pt, width_pt - 100, height_pt - 50, width_pt - 70, height_pt - 40, lower(drawing_id)
  from sheets_base where drawing_id is not null
  union all
  select doc_pair, rev, idx, width_pt, height_pt, width_pt - 100, height_pt - 80, width_pt - 70, height_pt - 70, concat(drawing_id, '9')
  from sheets_base where drawing_id is not null and doc_id % 3 = 0)"""


def words_of(v):
    """Positioned words of all sheets; drawing codes stand in the title block, some of them twice."""
    base = v.view("sheets_base")
    lines = base.select(
        "doc_pair", "rev", "idx", "width_pt", "height_pt", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    placed = lines.select(
        "doc_pair", "rev", "idx", "width_pt", "height_pt", "line_no",
        F.posexplode(F.split("line", " ")).alias("word_no", "word"),
    ).filter("word <> ''")
    x = ((F.col("word_no") + 1) * 37) % F.col("width_pt").cast("long")
    y = ((F.col("line_no") + 1) * 12) % F.col("height_pt").cast("long")
    words = placed.select(
        "doc_pair", "rev", "idx", "width_pt", "height_pt", x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 30).cast("double").alias("x1"), (y + 10).cast("double").alias("y1"), "word",
    )

    def code(up: int, word, rows):
        w, h = F.col("width_pt"), F.col("height_pt")
        return rows.select(
            "doc_pair", "rev", "idx", "width_pt", "height_pt", (w - 100).alias("x0"), (h - up).alias("y0"),
            (w - 70).alias("x1"), (h - up + 10).alias("y1"), word.alias("word"),
        )

    coded = base.filter("drawing_id is not null")
    return words.unionByName(code(50, F.lower("drawing_id"), coded)).unionByName(
        code(80, F.concat("drawing_id", F.lit("9")), coded.filter("doc_id % 3 = 0"))
    )


@query("p4_drawing_id", view_ctes("sheets_base").rstrip() + "," + WORDS_SQL + """
select s.doc_pair, s.rev, s.idx, d.drawing_id from sheets_base s left join (
  select doc_pair, rev, idx, min(upper(word)) as drawing_id from words
  where x1 > greatest(0, width_pt - 220 * 72 / 25.4e0) and y1 > greatest(0, height_pt - 90 * 72 / 25.4e0)
    and x0 < width_pt and y0 < height_pt and regexp_full_match(upper(word), '[A-Z0-9]+(?:-[A-Z0-9]+){4,}-DWG-\\d{4,}')
  group by all having count(distinct upper(word)) = 1) d using (doc_pair, rev, idx)""")
def p4(v):
    from sheetdelta.operators.titleblock import drawing_ids

    return drawing_ids(words_of(v), v.view("sheets_base").drop("drawing_id")).select("doc_pair", "rev", "idx", "drawing_id")


@query("p5_mark_similarity", view_ctes("sheets", "partners") + """
select a.doc_pair, p.k as idx, case when coalesce(a.sheet_mark, '') = '' or coalesce(b.sheet_mark, '') = '' then 0e0
  when a.sheet_mark = b.sheet_mark then 1e0
  when regexp_replace(a.sheet_mark, '[^0-9]', '', 'g') <> '' and
    regexp_replace(a.sheet_mark, '[^0-9]', '', 'g') = regexp_replace(b.sheet_mark, '[^0-9]', '', 'g') then 0.65e0
  else 0e0 end as similarity
from partners p join sheets a on a.doc_pair = p.doc_pair and a.idx = p.ka and a.rev = 'A' join sheets b on b.doc_pair = p.doc_pair and b.idx = p.kb and b.rev = 'B'""")
def p5(v):
    s = v.sheets()
    a = s.filter("rev = 'A'").select("doc_pair", F.col("idx").alias("ka"), F.col("sheet_mark").alias("ma"))
    b = s.filter("rev = 'B'").select("doc_pair", F.col("idx").alias("kb"), F.col("sheet_mark").alias("mb"))
    return v.view("partners").join(a, ["doc_pair", "ka"]).join(b, ["doc_pair", "kb"]).select(
        "doc_pair", F.col("k").alias("idx"), T.mark_similarity(F.col("ma"), F.col("mb")).alias("similarity")
    )


_REV = r"(?i)(?:^|[^A-Za-zА-Яа-я0-9])((?:rev(?:ision)?|r|рев|ревизия|р)[-_ ]*[A-Za-zА-Яа-я]*\d+[A-Za-zА-Яа-я]*)(?:$|[^\p{L}\p{N}_])"
_TAIL = r"(?i)([A-Za-zА-Яа-я]{1,3}\d{1,4}[A-Za-zА-Яа-я]{0,2})$"


def revision_sql(name: str) -> str:
    return (
        f"upper(regexp_replace(coalesce(nullif(regexp_extract({name}, '{_REV}', 1), ''), "
        f"nullif(regexp_extract({name}, '{_TAIL}', 1), '')), '[-_ ]+', '', 'g'))"
    )


@query("p6_extract_revision", view_ctes("catalog") + f"select doc, name, {revision_sql('name')} as revision from catalog")
def p6(v):
    return v.view("catalog").select("doc", "name", T.extract_revision(F.col("name")).alias("revision"))


@query("p7_name_prefix_tokens", view_ctes("catalog") + """
select doc, array_to_string(case when m is null then l[1:least(len(l), len(r))] else l[1:m - 1] end, '_') as prefix from (
  select doc, l, r, list_position(list_transform(range(1, least(len(l), len(r)) + 1), lambda i: lower(l[i]) = lower(r[i])), false) as m from (
    select doc, regexp_extract_all(name, '[A-Za-zА-Яа-я0-9]+') as l, regexp_extract_all(other, '[A-Za-zА-Яа-я0-9]+') as r from catalog))""")
def p7(v):
    prefix = T.name_prefix_tokens(F.col("name"), F.col("other"))
    return v.view("catalog").select("doc", F.array_join(prefix, "_").alias("prefix"))


@query("p9_file_label", view_ctes("catalog") + r"""
select doc, case when cleaned = '' then 'OLD' else regexp_extract(cleaned, '[^/]*$') end as name,
  coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(cleaned, '[^/]*$'), '\.[^.]*$', ''),
    '(?i)(?:^|[-_])(r?[A-Za-zА-Яа-я]\d+)$', 1), ''), 'OLD') as revision
from (select doc, replace(case when doc % 10 = 0 then '' else path end, chr(92), '/') as cleaned from catalog)""")
def p9(v):
    path = F.when(F.col("doc") % 10 == 0, "").otherwise(F.col("path"))
    return v.view("catalog").select("doc", T.file_label(path, "OLD").alias("l")).select("doc", "l.name", "l.revision")


@query("p11_parse_progress", view_ctes("job_events") + r"""
select event_id, cast(nullif(regexp_extract(message, '(\d+)\s*/\s*(\d+)', 1), '') as bigint) as completed_pages,
  cast(nullif(regexp_extract(message, '(\d+)\s*/\s*(\d+)', 2), '') as bigint) as total_pages from job_events""")
def p11(v):
    return v.view("job_events").select("event_id", T.parse_progress(F.col("message")).alias("p")).select("event_id", "p.*")
