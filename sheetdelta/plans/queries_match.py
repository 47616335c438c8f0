"""Queries over sheet matching and whole comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.functions import pairs as Q
from sheetdelta.functions.vectors import minmax_normalize, text_similarity, visual_similarity
from sheetdelta.operators import cells as R
from sheetdelta.operators import matching as M
from sheetdelta.operators import similarity as S
from sheetdelta.plans import compare
from sheetdelta.plans import queries_cells  # noqa: F401  its shift check is reused below
from sheetdelta.plans.registry import CHECKS, query
from sheetdelta.session import cut
from sheetdelta.sources.testviews import view_ctes

_S = view_ctes("sheets").rstrip()
_LONG = view_ctes("sheets_long").rstrip()

# score of two sheets, written out per pair
_PAIR = """
scored as (
  select *, tn_a + tn_b - shared as joint, case when tn_a = 0 and tn_b = 0 then 1e0 when tn_a = 0 or tn_b = 0 then 0e0 else shared / (tn_a + tn_b - shared) end as txt,
    greatest(0e0, 1 - mse / 65025e0) as vis, abs(wa / ha - wb / hb) / greatest(wa / ha, wb / hb) as gap, least(wa * ha, wb * hb) / greatest(wa * ha, wb * hb) as ratio,
    case when ma = '' or mb = '' then 'none' when ma = mb then 'same' when da <> '' and da = db then 'digits' else 'conflict' end as mk
  from (select a.doc_pair, a.idx as a_idx, b.idx as b_idx, a.width_pt as wa, a.height_pt as ha, b.width_pt as wb, b.height_pt as hb,
      coalesce(a.sheet_mark, '') as ma, coalesce(b.sheet_mark, '') as mb, regexp_replace(coalesce(a.sheet_mark, ''), '[^0-9]', '', 'g') as da,
      regexp_replace(coalesce(b.sheet_mark, ''), '[^0-9]', '', 'g') as db, len(a.tokens) as tn_a, len(b.tokens) as tn_b, a.drawing_id as ia, b.drawing_id as ib,
      len(list_intersect(a.tokens, b.tokens)) as shared, list_sum(list_transform(list_zip(a.thumb, b.thumb), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(a.thumb) as mse
    from sheets a join sheets b on a.doc_pair = b.doc_pair and a.rev = 'A' and b.rev = 'B' {on})),
judged as (select *, ratio >= 0.96 and gap <= 0.015 as same_size, gap <= 0.015 and mk <> 'conflict' and shared >= 20 and txt >= 0.85 and vis >= 0.9 as cross_size,
    greatest(0e0, least(1e0, case when tn_a > 0 or tn_b > 0 then 0.72 * vis + 0.28 * txt else vis end
      + case mk when 'same' then 0.20 when 'digits' then 0.08 when 'conflict' then -0.22 else 0 end)) as score from scored)"""
_DIAGONAL = view_ctes("sheets", "partners").rstrip() + "," + _PAIR.format(
    on="join partners p on p.doc_pair = a.doc_pair and p.ka = a.idx and p.kb = b.idx")
_CAND = "," + _PAIR.format(on="") + """,
ids as (select doc_pair, rev, drawing_id from sheets where drawing_id is not null group by all having count(*) = 1),
cand as (select j.doc_pair, a_idx, b_idx, same_size or cross_size or (x.drawing_id is not null and y.drawing_id is not null and ia = ib and shared >= 20) as ok,
    round(case when x.drawing_id is not null and y.drawing_id is not null and ia = ib and shared >= 20 then greatest(score, 0.95) else score end, 9) as sim
  from judged j left join ids x on x.doc_pair = j.doc_pair and x.rev = 'A' and x.drawing_id = ia
    left join ids y on y.doc_pair = j.doc_pair and y.rev = 'B' and y.drawing_id = ib)"""
_ALL = _S + _CAND

# edges by falling score; an edge is taken when none of its sheets is taken yet
_GREEDY = """,
sorted_edges as (select doc_pair, list({'a': a_idx, 'b': b_idx, 's': sim} order by sim desc, a_idx, b_idx) as l
  from cand where ok and sim >= 0.55 group by doc_pair),
picked as (select doc_pair, unnest(list_reduce(list_transform(l, lambda e: [e]), lambda took, e:
    case when len(list_filter(took, lambda t: t.a = e[1].a or t.b = e[1].b)) > 0 then took else took || e end)) as e from sorted_edges),
greedy as (select doc_pair, e.a as a_idx, e.b as b_idx, e.s as sim from picked)"""

# heaviest chain: row by row the best weight of every prefix; the way back prefers to leave out a sheet of A, then one of B
_CHAIN = """,
lines as (select doc_pair, a_idx, list(sim order by b_idx) as s, list(case when ok and sim >= 0.58 then sim - 0.14 else -1e9 end order by b_idx) as w
  from cand group by doc_pair, a_idx),
extent as (select doc_pair, max(a_idx) + 1 as n, any_value(len(w)) as m from lines group by doc_pair),
best(doc_pair, r, v) as (
  select doc_pair, 0::bigint, list_transform(range(m + 1), lambda j: 0e0) from extent
  union all
  select doc_pair, r + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) from (
    select b.doc_pair, b.r, list_transform(range(1, len(b.v) + 1), lambda j: case when j = 1 then b.v[1] else greatest(b.v[j], b.v[j - 1] + l.w[j - 1]) end) as c
    from best b join lines l on l.doc_pair = b.doc_pair and l.a_idx = b.r)),
walk(doc_pair, r, c, hit) as (
  select doc_pair, n, m, false from extent
  union all
  select w.doc_pair, case when here.v[w.c + 1] = up.v[w.c + 1] or here.v[w.c + 1] <> here.v[w.c] then w.r - 1 else w.r end,
    case when here.v[w.c + 1] = up.v[w.c + 1] then w.c else w.c - 1 end,
    here.v[w.c + 1] <> up.v[w.c + 1] and here.v[w.c + 1] <> here.v[w.c]
  from walk w join best here on here.doc_pair = w.doc_pair and here.r = w.r join best up on up.doc_pair = w.doc_pair and up.r = w.r - 1
  where w.r > 0 and w.c > 0),
chain as (select w.doc_pair, w.r as a_idx, w.c as b_idx, l.s[w.c + 1] as sim from walk w join lines l on l.doc_pair = w.doc_pair and l.a_idx = w.r where w.hit)"""


def _recursive(sql):
    return sql.replace("with ", "with recursive ", 1)


def _quality(name):
    """Quality of a map, with 0 for document pairs without a match."""
    return f"""
{name}_q as (select doc_pair, coalesce(mean, 0) - 0.38 * (n_a + n_b - 2 * coalesce(k, 0)) / greatest(1, n_a + n_b)
    - case when k > 1 then 0.10 * (i / (k * (k - 1) / 2)) else 0 end as q
  from counts left join (select doc_pair, avg(sim) as mean, count(*) as k from {name} group by doc_pair) using (doc_pair)
  left join (select f.doc_pair, count(g.a_idx) as i from {name} f left join {name} g on f.doc_pair = g.doc_pair and f.a_idx < g.a_idx and f.b_idx > g.b_idx group by f.doc_pair) using (doc_pair))"""


_VERDICT = """,
counts as (select doc_pair, count(*) filter (rev = 'A') as n_a, count(*) filter (rev = 'B') as n_b from sheets group by doc_pair),""" + _quality("greedy") + "," + _quality("chain") + """,
verdict as (select doc_pair, g.q as q_global, c.q as q_ordered, case when round(c.q - g.q + 0.04, 9) >= 0 then 'ordered' else 'global' end as strategy
  from greedy_q g join chain_q c using (doc_pair))"""

_PAGES = """,
chosen as (select * from greedy join verdict using (doc_pair) where strategy = 'global' union all select * from chain join verdict using (doc_pair) where strategy = 'ordered'),
place as (select s.doc_pair, s.rev, s.idx, coalesce(v.strategy, 'global') as strategy, f.a_idx, f.b_idx, f.sim from sheets s left join verdict v using (doc_pair)
  left join chosen f on f.doc_pair = s.doc_pair and ((s.rev = 'A' and f.a_idx = s.idx) or (s.rev = 'B' and f.b_idx = s.idx))),
page as (
  select doc_pair, strategy, a_idx, b_idx, 'matched' as status, sim as score, a_idx as k1,
    case strategy when 'global' then 1 else 2 end as k2, 0 as k3 from place where rev = 'A' and a_idx is not null
  union all
  select p.doc_pair, p.strategy, idx, null, 'removed', 0e0,
    case p.strategy when 'global' then idx else coalesce((select min(a_idx) from chosen f where f.doc_pair = p.doc_pair and f.a_idx > p.idx), 1000000) end, 1, idx
  from place p where rev = 'A' and a_idx is null
  union all
  select p.doc_pair, p.strategy, null, idx, 'added', 0e0,
    coalesce((select min(a_idx) from chosen f where f.doc_pair = p.doc_pair and f.b_idx > p.idx), 1000000), 0, idx
  from place p where rev = 'B' and a_idx is null)
select doc_pair, row_number() over (partition by doc_pair order by k1, k2, k3) as seq, a_idx, b_idx, status, score, strategy from page"""


def diagonal(v):
    """All sheets of both revisions, each with one partner, as structs a and b beside the index of a."""
    s = v.sheets()
    body = F.struct("thumb", "tokens", "sheet_mark", "width_pt", "height_pt")
    side = lambda rev, at, name: s.filter(F.col("rev") == rev).select("doc_pair", F.col("idx").alias(at), body.alias(name))
    paired = v.view("partners").join(side("A", "ka", "a"), ["doc_pair", "ka"]).join(side("B", "kb", "b"), ["doc_pair", "kb"])
    return paired.withColumnRenamed("ka", "idx")


def _pair_query(column, alias):
    return lambda v: diagonal(v).select("doc_pair", F.col("idx").alias("a_idx"), column(F.col("a"), F.col("b")).alias(alias))


query("p22_visual_similarity", _DIAGONAL + " select doc_pair, a_idx, round(vis, 9) as visual from judged")(
    _pair_query(lambda a, b: F.round(visual_similarity(a["thumb"], b["thumb"]), 9), "visual")
)
query("p23_text_similarity", _DIAGONAL + " select doc_pair, a_idx, round(txt, 9) as text_sim from judged")(
    _pair_query(lambda a, b: F.round(text_similarity(a["tokens"], b["tokens"]), 9), "text_sim")
)
query("p24_pair_score", _DIAGONAL + " select doc_pair, a_idx, round(score, 9) as score from judged")(
    _pair_query(lambda a, b: F.round(Q.pair_score(a, b), 9), "score")
)
query("f1_size_compatible", _DIAGONAL + " select doc_pair, a_idx, same_size as ok from judged")(
    _pair_query(Q.size_compatible, "ok")
)
query("f2_cross_size_compatible", _DIAGONAL + " select doc_pair, a_idx, cross_size as ok from judged")(
    _pair_query(Q.cross_size_compatible, "ok")
)
query("f3_pages_compatible", _DIAGONAL + " select doc_pair, a_idx, same_size or cross_size as ok from judged")(
    _pair_query(Q.pages_compatible, "ok")
)
query("x3_token_sets", _DIAGONAL + " select doc_pair, a_idx, shared, joint from judged")(
    lambda v: diagonal(v).select(
        "doc_pair", F.col("idx").alias("a_idx"), F.size(F.array_intersect("a.tokens", "b.tokens")).cast("long").alias("shared"),
        F.size(F.array_union("a.tokens", "b.tokens")).cast("long").alias("joint"),
    )
)


@query("p21_minmax_normalize", """
select vec_id, round(list_sum(t), 6) as total, list_min(t) as low, list_max(t) as high from (
  select vec_id, list_transform(embedding, lambda x: (cast(x as double) - list_min(embedding)) * 255e0 / (cast(list_max(embedding) as double) - list_min(embedding))) as t from embeddings)""")
def p21(v):
    t = minmax_normalize(F.col("embedding"))
    return v.table("embeddings").select("vec_id", t.alias("t")).select(
        "vec_id", F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.array_min("t").alias("low"), F.array_max("t").alias("high"),
    )


def edges_of(v, base="sheets_base"):
    return cut(S.similarity_edges(cut(v.sheets(base).drop("text"))))


@query("j1_candidate_pairs", _ALL + """
select doc_pair, a_idx, count(*) filter (ok) as compatible, count(*) filter (ok and sim >= 0.55) as above,
  arg_min(b_idx, b_idx) filter (ok and sim = top) as best_b, max(sim) filter (ok) as best_sim
from (select *, max(case when ok then sim end) over (partition by doc_pair, a_idx) as top from cand) group by doc_pair, a_idx""")
def j1(v):
    sheets = cut(v.sheets().drop("text"))
    return S.candidate_summary(sheets, cut(S.similarity_edges(sheets)))


@query("j2_token_block_join", _S + """,
sets as (select doc_pair, rev, array_to_string(list_sort(tokens), ' ') as k, any_value(tokens) as tokens, min(idx) as first_idx, count(*) as pages
  from sheets where len(tokens) >= 20 group by all)
select * from (select a.doc_pair, a.first_idx as first_a, b.first_idx as first_b, a.pages as pages_a, b.pages as pages_b, len(list_intersect(a.tokens, b.tokens)) as shared,
  len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) as text_sim
from sets a join sets b on a.doc_pair = b.doc_pair and a.rev = 'A' and b.rev = 'B') where shared >= 20 and text_sim >= 0.85""")
def j2(v):
    return S.token_block_join(v.sheets())


@query("j3_unique_id_join", _S + """,
ids as (select doc_pair, rev, drawing_id, min(idx) as idx from sheets where drawing_id is not null group by doc_pair, rev, drawing_id having count(*) = 1)
select * from (select x.doc_pair, x.drawing_id, x.idx as a_idx, y.idx as b_idx, len(list_intersect(a.tokens, b.tokens)) as shared
  from ids x join ids y on x.doc_pair = y.doc_pair and x.drawing_id = y.drawing_id and x.rev = 'A' and y.rev = 'B'
  join sheets a on a.doc_pair = x.doc_pair and a.rev = 'A' and a.idx = x.idx join sheets b on b.doc_pair = y.doc_pair and b.rev = 'B' and b.idx = y.idx) where shared >= 20""")
def j3(v):
    return S.unique_id_join(v.sheets())


@query("a14_duplicate_ids", _S + " select doc_pair, rev, drawing_id, count(*) as n from sheets where drawing_id is not null group by all")
def a14(v):
    return v.sheets().filter("drawing_id is not null").groupBy("doc_pair", "rev", "drawing_id").agg(F.count("*").alias("n"))


@query("m1_match_global", _ALL + _GREEDY + " select * from greedy")
def m1(v):
    return M.match_global(edges_of(v))


@query("m1_match_global_long", _LONG + _CAND + _GREEDY + " select * from greedy")
def m1_long(v):
    return M.match_sheets(cut(v.sheets("sheets_base_long").drop("text")))


@query("m2_match_ordered", _recursive(_ALL + _CHAIN + " select * from chain"))
def m2(v):
    sheets = cut(v.sheets().drop("text"))
    return M.match_ordered(cut(S.similarity_edges(sheets)), S.sheet_counts(sheets))


# a fixed one-to-one map on which the map operators can be checked: equal text digest keys
_MAP = _S + """,
fixed as (select a.doc_pair, a.idx as a_idx, b.idx as b_idx, (a.idx % 40 + 60) / 100e0 as sim from sheets a join sheets b
  on a.doc_pair = b.doc_pair and a.rev = 'A' and b.rev = 'B' and a.doc_id = b.doc_id)"""


def fixed_map(v):
    s = v.view("sheets_base").select("doc_pair", "rev", "idx", "doc_id")
    a = s.filter("rev = 'A'").select("doc_pair", "doc_id", F.col("idx").alias("a_idx"))
    b = s.filter("rev = 'B'").select("doc_pair", "doc_id", F.col("idx").alias("b_idx"))
    sim = (F.col("a_idx") % 40 + 60) / F.lit(100.0)
    return cut(a.join(b, ["doc_pair", "doc_id"]).select("doc_pair", "a_idx", "b_idx", sim.alias("sim"))), s


_INV = "inv as (select f.doc_pair, count(g.a_idx) as inversions from fixed f left join fixed g on f.doc_pair = g.doc_pair and f.a_idx < g.a_idx and f.b_idx > g.b_idx group by f.doc_pair)"


@query("a13_inversions", _MAP + "," + _INV + " select doc_pair, inversions from inv")
def a13(v):
    return M.inversions(fixed_map(v)[0])


@query("a12_alignment_quality", _MAP + "," + _INV + """,
n as (select doc_pair, count(*) filter (rev = 'A') as n_a, count(*) filter (rev = 'B') as n_b from sheets group by doc_pair),
t as (select doc_pair, avg(sim) as mean, count(*) as matched from fixed group by doc_pair)
select doc_pair, matched, inversions, (n_a + n_b - 2 * matched) / (n_a + n_b) as gap_ratio, inversions / (matched * (matched - 1) / 2) as crossing_ratio,
  mean - 0.38 * (n_a + n_b - 2 * matched) / (n_a + n_b) - 0.10 * inversions / (matched * (matched - 1) / 2) as quality from n join t using (doc_pair) join inv using (doc_pair)""")
def a12(v):
    found, s = fixed_map(v)
    return M.alignment_quality(found, S.sheet_counts(s))


@query("x4_unmatched", _MAP + """
select doc_pair, idx as a_idx, null as b_idx, 'removed' as status from sheets s where rev = 'A' and not exists (select 1 from fixed f where f.doc_pair = s.doc_pair and f.a_idx = s.idx)
union all select doc_pair, null, idx, 'added' from sheets s where rev = 'B' and not exists (select 1 from fixed f where f.doc_pair = s.doc_pair and f.b_idx = s.idx)""")
def x4(v):
    return M.unmatched(*fixed_map(v))


@query("w11_assign_seq", _MAP + """,
gone as (select doc_pair, idx from sheets s where rev = 'A' and not exists (select 1 from fixed f where f.doc_pair = s.doc_pair and f.a_idx = s.idx)),
extra as (select doc_pair, idx from sheets s where rev = 'B' and not exists (select 1 from fixed f where f.doc_pair = s.doc_pair and f.b_idx = s.idx)),
lines as (select doc_pair, a_idx, b_idx, 'matched' as status, a_idx as k1, 1 as k2, 0 as k3 from fixed
  union all select doc_pair, idx, null, 'removed', idx, 1, 0 from gone
  union all select e.doc_pair, null, e.idx, 'added', coalesce((select min(a_idx) from fixed f where f.doc_pair = e.doc_pair and f.b_idx > e.idx), 1000000), 0, e.idx from extra e)
select doc_pair, a_idx, b_idx, status, row_number() over (partition by doc_pair order by k1, k2, k3) as seq from lines""")
def w11(v):
    found, s = fixed_map(v)
    verdict = S.sheet_counts(s).select("doc_pair", F.lit("global").alias("strategy"))
    return M.emit_page_map(found, s, verdict).drop("score", "strategy")


@query("m3_choose_map", _recursive(_ALL + _GREEDY + _CHAIN + _VERDICT + " select * from verdict"))
def m3(v):
    sheets = cut(v.sheets().drop("text"))
    edges, counts = cut(S.similarity_edges(sheets)), S.sheet_counts(sheets)
    return M.choose_map(M.match_global(edges), M.match_ordered(edges, counts), counts)


@query("m4_emit_page_map", _recursive(_ALL + _GREEDY + _CHAIN + _VERDICT + _PAGES))
def m4(v):
    return compare.page_map(v.sheets())


@query("m5_force_single_pair", _S + """
select doc_pair, 1 as seq, case when n_a = 1 and n_b = 1 then 0 end as a_idx, case when n_a = 1 and n_b = 1 then 0 end as b_idx,
  case when n_a = 1 and n_b = 1 then 'matched' else 'error' end as status, case when n_a = 1 and n_b = 1 then 1e0 end as score,
  case when not (n_a = 1 and n_b = 1) then 'single_pair_needs_one_page' end as error_key
from (select concat(doc_pair, '-', doc_id) as doc_pair, count(*) filter (rev = 'A') as n_a, count(*) filter (rev = 'B') as n_b from sheets group by 1)""")
def m5(v):
    alone = v.view("sheets_base").withColumn("doc_pair", F.concat_ws("-", "doc_pair", F.col("doc_id").cast("string")))
    return M.force_single_pair(S.sheet_counts(alone))


def sheet_words(v):
    """Text drawn row by row: every visible character is a cell, a raster row holds width_pt of them."""
    base = v.view("sheets_base").select("doc_pair", "rev", "idx", "text", F.col("width_pt").cast("long").alias("w"))
    rows = F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / F.col("w")))
    lines = base.filter("length(text) > 0").select(
        "doc_pair", "rev", "idx", "w", F.posexplode(F.transform(rows, lambda y: F.substring(F.col("text"), y * F.col("w") + 1, F.col("w"))))
        .alias("y", "line"),
    )
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.length("line") - 1) / 64))
    words = lines.select(
        "doc_pair", "rev", "idx", F.col("y").cast("long").alias("y"),
        F.posexplode(F.transform(pieces, lambda p: F.substring(F.col("line"), p * 64 + 1, F.lit(64)))).alias("wx", "piece"),
    )
    marks = F.translate(F.regexp_replace("piece", r"[^ \n\r\t]", "1"), " \n\r\t", "0000")
    half = lambda start: F.coalesce(F.conv(F.reverse(F.substring(marks, start, 32)), 2, 10).cast("long"), F.lit(0).cast("long"))
    bits = half(1).bitwiseOR(F.shiftleft(half(33), 32))
    return words.select("doc_pair", "rev", "idx", "y", F.col("wx").cast("long").alias("wx"), bits.alias("bits")).filter("bits <> 0")


@query("cells_text_grid", view_ctes("sheets_base").rstrip() + """,
chars as (select doc_pair, rev, idx, cast(width_pt as bigint) as w, unnest(range(0, len(text))) as p, text from sheets_base)
select doc_pair, rev, idx, p // w as y, count(*) as n, sum(p % w) as x_sum from chars where substr(text, p + 1, 1) not in (' ', chr(10), chr(13), chr(9)) group by all""")
def text_grid(v):
    cells = R.unpack(sheet_words(v), "bits", ["doc_pair", "rev", "idx"])
    return cells.groupBy("doc_pair", "rev", "idx", "y").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"))


def _lattice_sizes(v):
    return v.view("dims").selectExpr(
        "doc_pair", "seq", "width as width_a", "height as height_a", "width as width_b", "height as height_b", "dpi"
    )


_LATTICE = compare.DiffSettings(dpi=72.0, tolerance_px=1.0, strictness="strict", clean=False)


_SHIFTED = CHECKS["m8_register_shift"].replace("\nselect t.seq,", ",\nshift as (select t.seq,", 1).rstrip() + """),
moved as (select seq, rev, x, y from cells where rev = 'A' union all select c.seq, c.rev, c.x - shift_x, c.y - shift_y from cells c join shift using (seq)
  where rev = 'B' and c.x - shift_x between 0 and 63 and c.y - shift_y between 0 and 63),
sides as (select seq, x, y, bool_or(rev = 'A') as in_a, bool_or(rev = 'B') as in_b from moved group by all)
select s.seq, any_value(method) as alignment_method, cast(any_value(shift_x) as double) as alignment_shift_x_px, cast(any_value(shift_y) as double) as alignment_shift_y_px,
  count(*) filter (in_a <> in_b) as diff_area_px, count(*) filter (in_b and not in_a) as added_px, count(*) filter (in_a and not in_b) as removed_px,
  count(*) as foreground_px, count(*) filter (in_a <> in_b) / 4096e0 * 100 as diff_percent, 'matched' as status
from sides s join shift using (seq) group by s.seq"""


@query("m12_diff_sheets", _SHIFTED)
def m12(v):
    details, _ = compare.diff_sheets(R.pack(v.view("cells")), _lattice_sizes(v), _LATTICE)
    return details.select(
        "seq", "status", "alignment_method", "alignment_shift_x_px", "alignment_shift_y_px", "diff_area_px", "added_px",
        "removed_px", "foreground_px", "diff_percent",
    )


@query("m13_compare_documents")
def m13(v):
    settings = compare.DiffSettings(dpi=72.0, merge_gap_mm=0.0)
    details, _ = compare.compare_documents(v.sheets(), cut(sheet_words(v)), settings)
    return details


@query("m14_rerender")
def m14(v):
    words, sizes = cut(R.pack(v.view("cells"))), _lattice_sizes(v)
    details, _ = compare.diff_sheets(words, sizes, _LATTICE)
    details = cut(details.withColumns({"a_page": F.col("seq"), "b_page": F.col("seq"), "score": F.lit(1.0)}))
    loose = compare.DiffSettings(dpi=72.0, tolerance_px=1.0, strictness="loose", clean=False)
    return compare.rerender(details, words, sizes, details.filter("diff_percent > 10"), loose)
