"""The corpus queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.llm import bpe, collocations, covertree, languages, licences, lines, mixing, pages, quality, ranking, simhash, substring, vptree
from sheetdelta.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_vptree_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return vptree.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


CHECKS["op1_vptree_search"] = """
with usable as (
  select vec_id, embedding::double[] as v from embeddings
  where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), gaps as (
  select q.vec_id as query_id, r.vec_id, list_distance(q.v, r.v) as score
  from usable q join usable r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score, vec_id) as rank from gaps
) where rank <= 10
"""


@query
def op2_site_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages"))


@query
def op3_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_mixtures(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("lane0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_covertree_components(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicate_vectors(table(spark, folder, "embeddings"), cosine=0.93)


CHECKS["op5_covertree_components"] = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a
), counted as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, root::bigint as component_id, root = vec_id as kept
from embeddings join (select a, min(b) as root from reach group by a) r on r.a = vec_id
left join counted c on c.a = vec_id
"""


@query
def op6_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"), F.array("source"))
    own = F.col("sources")[0]
    return found.select("doc_id", "size", own["size"].alias("source_size"), own["target"].alias("target"), "taken")


@query
def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest_documents(table(spark, folder, "documents"), path)


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, folder, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


CHECKS["op9_substring_dedup"] = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select doc_id, p, array_to_string(ws[p:p + 49], ' ') as w
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as p from words)
), earliest as (
  select w, min(doc_id) as first_id from windows group by w
), covered as (
  select distinct doc_id, unnest(generate_series(p, p + 49)) as pos
  from windows join earliest using (w) where first_id < doc_id
), placed as (
  select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as pos from words
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as text
  from placed anti join covered using (doc_id, pos) group by doc_id
)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (doc_id)
"""


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


@query
def op11_bitsliced_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


CHECKS["op11_bitsliced_ranking"] = r"""
with terms as (
  select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
), split as (
  select kind, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from terms
), counted as (
  select id, t, count(*) as tf from split where kind = 'd' group by id, t
), sizes as (
  select id, sum(tf)::bigint as n from counted group by id
), facts as (
  select count(*) as docs, sum(n)::bigint as len from sizes
), weights as (
  select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from counted, facts group by t
), scored as (
  select i.id as item_id, c.id as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))))::bigint as score
  from (select distinct id, t from split where kind = 'i') i join counted c using (t) join weights using (t)
  join sizes s on s.id = c.id cross join facts group by i.id, c.id
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""


@query
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, folder, "documents"), least_chars=20, least_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


CHECKS["op12_line_dedup"] = r"""
with lines as (
  select doc_id, pos, line,
    translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (
    select doc_id, unnest(ls) as line, unnest(generate_series(1, len(ls))) as pos
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
  )
), common as (
  select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), marked as (
  select doc_id, pos, line, coalesce(doc_id < keeper, false) as gone from lines left join common using (k)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


CHECKS["op13_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces
), grams as (
  select lang, k, w[i:i + k - 1] as p from (
    select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i
    from (select lang, w, unnest(generate_series(1, 4)) as k from words)
  )
), counted as (
  select lang, k, p, count(*) as f from grams group by all
), totals as (
  select lang, sum(f) as n from counted where k = 1 group by lang
), cuts as (
  select c.lang, c.k, c.p, c.f as a, c.j, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
  from (select *, unnest(generate_series(1, k - 1)) as j from counted where k > 1 and f >= 30) c
  join counted x on x.lang = c.lang and x.p = c.p[1:c.j] join counted y on y.lang = c.lang and y.p = c.p[c.j + 1:c.k]
), scored as (
  select *, array_to_string(p, ' ') as phrase from cuts
  qualify row_number() over (partition by lang, p order by score, j) = 1
), inner_parts as (
  select c.lang, c.p[i:i + m - 1] as p, max(c.f) as around
  from (
    select *, unnest(generate_series(1, k - m + 1)) as i
    from (select *, unnest(generate_series(2, k - 1)) as m from counted where k > 2 and f >= 30)
  ) c group by all
), kept as (
  select s.* from scored s left join inner_parts q on q.lang = s.lang and q.p = s.p
  where around is null or 100 * around < 80 * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000
"""
