"""Language mixtures, quality, mixing, pages, vectors and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetdelta.llm import covertree, languages, mixing, pages, quality, queries, vptree
from sheetdelta.llm.common import held_out, table
from sheetdelta.llm.graph import components

SMALL = "/root/testdata/sf0.001"


# languages


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op3_language_mixture"](spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    row = found.join(docs, "doc_id").filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 0.98 and found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_mixtures_and_texts_without_letters(spark):
    words = {"aa": "karu lomi tesa", "bb": "xyph qwor zzut"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=80)), lang) for k in range(60) for lang in ("aa", "bb")[k % 2 : k % 2 + 1]]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !?", None), (103, rows[0][1] + " " + rows[1][1], None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))
    found = {r.doc_id: r for r in languages.language_mixtures(docs).collect()}
    assert [found[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and found[100].score == 0
    assert set(found[103].mixture) == {"aa", "bb"} and abs(found[103].mixture["aa"] - 0.5) < 0.1
    assert found[None].lang_pred == "aa" and found[None].held_out is False
    assert all(found[k].lang_pred == lang for k, _, lang in rows[:60])


def test_nothing_learned_gives_und(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in languages.language_mixtures(docs).collect()] == ["und"]
    assert languages.language_mixtures(docs.filter("false")).collect() == []


# quality


def test_held_out_rows_are_scored_well(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op6_quality_scores"](spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").toPandas()
    good, poor = found[found.quality == 1].score, found[found.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > poor.to_numpy()[None, :]) > 0.9
    assert ((found.score >= 0.3).astype(int) == found.predicted).all() and found.score.between(0, 1).all()


def test_quality_learns_from_no_held_out_label(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} other" if k % 2 else "###!! | |") for k in range(200)] + [(900, None), (None, "")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(quality.score_quality(docs, x).collect(), key=str) for x in (labels, turned))
    assert one == two and len(one) == 202
    by = {r.doc_id: r.predicted for r in one}
    assert by[1] == 1 and by[2] == 0


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(None, 0), (2, None)]])
def test_quality_without_both_labels(spark, labelled):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == 2 and quality.without_poor(docs, labels).count() == 2
    assert quality.score_quality(docs.filter("false"), labels).collect() == []


# mixing


def test_targets_stop_and_share_the_excess():
    targets = mixing.share_out(1000, {"a": 10, "b": 490, None: 500}, {"a": 5, "b": 2, None: 1}, 3)
    assert targets["a"] == 30 and abs(sum(targets.values()) - 1000) < 1e-6 and abs(targets["b"] / targets[None] - 2) < 1e-9
    assert mixing.share_out(0, {"a": 0}, {"a": 5}, 3) == {"a": 0.0}
    assert mixing.cycling_weights([None, "b", "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}


def test_flow_meets_quotas_with_the_fewest_repeats():
    flows = mixing.route([100, 50, 10], [100, 60], [[0, 1], [1], [0]], 3)
    assert sum(f.get(0, 0) for f in flows) == 100 and sum(f.get(1, 0) for f in flows) == 60
    assert sum(flows[0].values()) <= 100 and sum(flows[1].values()) <= 50 and sum(flows[2].values()) <= 10


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(2)
    rows = [(k, "w " * draw.randrange(60), draw.choice(["a"] * 8 + ["b", "c", None])) for k in range(900)] + [(900, None, "a"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    found = mixing.mix(docs, F.array("source")).collect()
    assert len(found) == len(rows) and sorted(found, key=str) == sorted(mixing.mix(docs, F.array("source")).collect(), key=str)
    by = {}
    for r in found:
        own = r.sources[0]
        assert r.members == [own["name"]] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(own["name"], [own["target"], 0, 0])
        by[own["name"]][1] += r.taken
        by[own["name"]][2] += r["size"]
    assert all(abs(taken - target) <= 60 for target, taken, _ in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(s for _, _, s in by.values())) < 1e-6


def test_overlapping_members_and_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", ["x", "y"]), (2, "a b", ["y", "x", "x"]), (3, "a", []), (4, "a", None)], "doc_id long, text string, m array<string>"
    )
    found = {r.doc_id: r for r in mixing.mix(docs, F.col("m"), weigh=lambda names: dict.fromkeys(names, 1.0)).collect()}
    assert found[1].members == found[2].members == ["x", "y"] and found[3].copies == found[4].copies == 0
    assert mixing.mix(docs.filter("false"), F.col("m")).collect() == []
    drawn = mixing.mixed_rows(docs.drop("m"), F.array(F.lit("s")))
    assert drawn.columns == ["doc_id", "text"] and drawn.count() == 4


# pages


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a>menu</a></nav>"
    "<header>Site</header><div class='ad'>Buy</div><article><header><h1>Head &amp; line</h1></header>{site}<p><b>One<br>two\n three"
    "<p>Four &lt;five&gt;&nbsp;six</p><ul><li>a<li>b</ul><!-- <p>no</p> --><form><input>no</form>"
    "<div id=comments><p>no</p></div></article><aside>no</aside><footer>no"
)


def test_text_of_a_page_with_broken_markup(spark):
    rows = [(1, "http://h/1", PAGE.format(site="")), (2, None, None), (None, "", ""), (3, "http://h/1", "plain &amp; text"), (3, "http://h/1", "plain &amp; text")]
    found = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 5 and by[1].text == "Head & line\nOne two three\nFour <five> six\na\nb" and by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[None].n_chars == 0 and by[3].text == "plain & text"


def test_site_templates_go_and_copied_articles_stay(spark):
    site = "<div><p>Follow us today</p><p>All stories</p></div>"
    rows = [(k, f"https://Site.example/{k}?x", PAGE.format(site=site).replace("One", f"One {k}")) for k in range(12)]
    rows += [(100 + k, f"https://copies.example/{k}", PAGE.format(site="")) for k in range(20)]
    found = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # within one host, what all articles share is its template; a copied article counts once
    assert all("Follow" not in found[k] and f"One {k} two" in found[k] for k in range(12))
    assert all(found[100 + k].startswith("Head & line\nOne two three") for k in range(20))


@pytest.mark.parametrize("wrapper", [
    "class='content has-sidebar'", "class=no-sidebar", "class='search-page'", "id='post-form'", "class='site header'",
])
def test_marks_on_a_wrapper_do_not_lose_the_article(wrapper):
    article = "<article><div class='entry-header'><h1>Head</h1></div><p>One two three four</p><div id=comments>no</div></article>"
    ads = "<div class=ad>Buy</div><div class=sidebar>Side</div>"
    for inner in (article, article.replace("article>", "main>"), f"<main>{article}</main>", "<p>One two three four five six</p>"):
        for page in (f"<div {wrapper}>{inner}</div>{ads}", f"<div role=main><div {wrapper}>{inner}</div>{ads}</div>"):
            text = " ".join(b.text for b in pages.main_blocks(page))
            assert "One two three four" in text and not any(w in text for w in ("no", "Buy", "Side"))
            assert "article" not in inner or text.startswith("Head")


def test_marks_beside_the_article_still_count():
    page = "<article><p>One two three four five six</p></article><div id=comments><article>so true</article></div>"
    assert [b.text for b in pages.main_blocks(f"<div role=main>{page}</div>")] == ["One two three four five six"]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    long = "<article>" + "<p>word &eacute;</p>" * 20000
    found = {r.page_id: r.text for r in pages.extract_pages(
        spark.createDataFrame([(1, "http://a", deep), (2, "http://a", long)], "page_id long, url string, html string")).collect()}
    assert found[1] == "deep" and found[2].count("word é") == 20000


# vectors


BAD = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [None, 1.0, 1.0], [1.0, 1.0]]


@pytest.mark.parametrize("shard_rows, block_queries", [(16, 3), (64, 1000)])
def test_neighbours_equal_brute_force(spark, shard_rows, block_queries):
    draw = np.random.default_rng(1)
    good = np.concatenate([draw.normal(size=(150, 3)), np.repeat(draw.normal(size=(1, 3)), 90, axis=0)]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(good)] + [(300 + k, v) for k, v in enumerate(BAD)] + [(None, [1.0, 2.0, 3.0]), (0, good[0].tolist())]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).withColumn("id", F.lit("x"))
    found = vptree.nearest(base, base.filter("vec_id % 4 = 0"), k=10, shard_rows=shard_rows, block_queries=block_queries).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    points = good.astype(float)
    for q in range(0, len(points), 4):
        gap = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(gap)), gap)) if i != q][:10]
        assert [g[0] for g in got[q]] == order and np.allclose([g[1] for g in got[q]], gap[order])
    assert set(got) - set(range(len(points))) <= {306 - 306 % 4, 304, 308} and 304 not in got


def test_relaxed_pruning_keeps_most_neighbours(spark):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(4000, 16))
    tree = vptree.VPTree(points, np.arange(4000))
    exact, _ = tree.search(points[:100], np.arange(100), 10)
    relaxed, _ = tree.search(points[:100], np.arange(100), 10, relax=1.5)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact, relaxed)]) >= 9


def test_few_or_no_candidates(spark):
    base = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (100, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in vptree.nearest(base, base.filter("vec_id = 100")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vptree.nearest(base.filter("false"), base.filter("false")).collect() == []


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_vector_links_equal_brute_force(spark, block_rows):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 6))
    good = np.concatenate([centres[draw.integers(12, size=120)] + draw.normal(size=(120, 6)) * 0.12, np.repeat(centres[:1], 25, axis=0)])
    label = [int(x) if x < 3 else None for x in draw.integers(0, 4, len(good))]
    rows = [(k, v.tolist(), label[k]) for k, v in enumerate(good)] + [(500 + k, v, 1) for k, v in enumerate(BAD)] + [(None, good[0].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("first", F.lit(1)).withColumn("v", F.lit("x"))
    found = {r.vec_id: r for r in covertree.near_duplicate_vectors(frame, block_rows=block_rows).collect()}
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in label] for a in label])
    link = (unit @ unit.T >= 0.93) & same & ~np.eye(len(good), dtype=bool)
    reach = np.linalg.matrix_power((link | np.eye(len(good), dtype=bool)).astype(float), 200) > 0
    for k in range(len(good)):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (link[k].sum(), reach[k].argmax(), reach[k].argmax() == k)
    assert all(found[500 + k].n_links == 0 and found[500 + k].kept for k in range(len(BAD))) and len(found) == len(rows)


def test_close_pairs_equal_brute_force():
    draw = np.random.default_rng(9)
    points = draw.normal(size=(300, 8))
    points[:100] = points[100:200] + draw.normal(size=(100, 8)) * 0.05
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = covertree.CoverTree(points)
    for level, (centres, reach) in enumerate(zip(tree.centres, tree.reach)):
        assert set(tree.centres[0]) <= set(centres) and len(centres) == len(reach), level
    i, j = covertree.close_pairs(tree, tree, 0.374)
    want = {tuple(p) for p in np.argwhere(np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.374)}
    assert {p for p in want if p[0] <= p[1]} == {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    i, j = covertree.close_pairs(tree, covertree.CoverTree(points[:150]), 0.374)
    assert {p for p in want if p[1] < 150} == set(zip(i.tolist(), j.tolist()))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 400)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7), (None, 3), (5000, 4999)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 401)} | {k: 1000 for k in range(1001, 1300)} | {5000: 4999}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# pipeline


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, SMALL, "documents").cache()
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL).cache()
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[-1] == counts[-2]
    row = docs.first()
    assert set(docs.columns) == {"doc_id", "ids", "decoded"} and row.decoded is not None


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == []


def test_of_rows_with_one_id_the_smallest_vector_counts(spark):
    rows = [(1, [0.0, 1.0], "a"), (2, [5.0, 0.0], "a"), (2, [0.0, 2.0], "a"), (3, [1.0, 0.0], "a"), (2, None, "a")]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for turn in (base, base.orderBy(F.desc("vec_id")), base.orderBy("embedding")):
        found = vptree.nearest(turn, turn.filter("vec_id = 1"), k=2).collect()
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 1.0), (3, pytest.approx(2**0.5))]
        linked = sorted(map(tuple, covertree.near_duplicate_vectors(turn).collect()))
        # the vector that counts links 2 with 1; a row without a vector links with nothing
        assert (2, 1, 1, False) in linked and (1, 1, 1, True) in linked and (3, 0, 3, True) in linked
        first = linked if turn is base else first
        assert linked == first
