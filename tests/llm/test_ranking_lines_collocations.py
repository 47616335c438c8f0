"""Ranked search, line dedup and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheetdelta.llm import collocations, lines, ranking

WORDS = ["the", "of", "naïve", "A1", "b-c", "Zoë", "x", "data", "spark", "İx", "run", "row", "日本"]
ODD = [None, "", " ", "\n\n", ".,;", "a" * 3000, "The the THE", "x\ty\x0bz\x00w"]


def texts(seed, n, low=0, high=60):
    draw = random.Random(seed)
    return [" ".join(draw.choice(WORDS) + draw.choice(["", "", ".", ",", "\n"]) for _ in range(draw.randrange(low, high))) for _ in range(n)]


# ranked search


def brute_terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_ranking(rows, items, k):
    bags = [(key, Counter(brute_terms(text))) for key, text in rows]
    bags = [(key, bag) for key, bag in bags if bag]
    count, length = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = {}
    for item, text in items:
        scores = []
        for key, bag in bags:
            n = sum(bag.values())
            m = 100 - 50 + (50 * n * count) // length
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(brute_terms(text)) if t in bag
            )
            if score > 0:
                scores.append((-score, key))
        out[item] = [(key, -s) for s, key in sorted(scores)[:k]]
    return out


def ranked(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r["item_id"]]) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return out


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "item_id long, text string, doc_id int, score string")


def test_ranking_equals_brute_force(docs, items):
    rows = list(enumerate([*ODD, *texts(1, 250), *(["same words of data"] * 70), "data " * 5000]))
    asked = list(enumerate(["spark data", "the of naïve x", "日本 İx zoë", None, "", "unknown words only", "a1 b c run row data same words"]))
    found = ranked(ranking.rank_documents(docs(rows), items(asked), k=20))
    want = brute_ranking(rows, asked, 20)
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


def test_passes_and_small_shards_change_nothing(docs, items, monkeypatch):
    rows, asked = list(enumerate(texts(2, 200, 1, 90))), list(enumerate(texts(3, 12, 1, 12)))
    want = brute_ranking(rows, asked, 5)
    monkeypatch.setattr(ranking, "PASS_TERMS", 10)
    assert ranked(ranking.rank_documents(docs(rows), items(asked), k=5)) == {k: v for k, v in want.items() if v}


def test_bounds_are_never_below_the_score_and_exclude_documents():
    rows, asked = list(enumerate(texts(4, 600, 5, 60))), list(enumerate(["spark", "naïve 日本", "x y z"]))
    bags = [Counter(brute_terms(t)) for _, t in rows]
    count, length = len(bags), sum(sum(b.values()) for b in bags)
    shard = ranking._Shard(512)
    for (key, _), bag in zip(rows, bags):
        pairs = sorted((ranking.xxhash.xxh64_intdigest(t.encode()), n) for t, n in bag.items())
        shard.keys.append(key)
        shard.n.append(sum(bag.values()))
        shard.sets.append((np.array([h for h, _ in pairs], np.uint64), np.array([n for _, n in pairs])))
    row = shard.row()
    wanted = [(k, sorted({ranking.xxhash.xxh64_intdigest(w.encode()) for w in brute_terms(t)})) for k, t in asked]
    signed = [(k, np.array(t, np.uint64).view(np.int64).tolist(), [100 + i for i in range(len(t))]) for k, t in wanted]
    query = ranking.Query([(k, t, [7000] * len(t)) for k, t, _ in signed])
    searcher = ranking.Searcher(query, count, length, 5)
    n = np.array(row["n"])
    m = 50 + 50 * n * count // length
    bound = searcher.bounds(np.frombuffer(row["slices"], np.uint8).reshape(512, -1), 512, n, m)
    part = {"hashes": np.frombuffer(row["hashes"], "<u8"), "tf": np.frombuffer(row["tf"], "<u4").astype(np.int64), "ends": np.concatenate([[0], row["ends"]])}
    item, doc = np.nonzero(np.ones(bound.shape, bool))
    exact = searcher.scores(item, doc, part, m).reshape(bound.shape)
    assert (bound >= exact).all() and (bound == exact).mean() > 0.7
    searcher = ranking.Searcher(query, count, length, 5)
    searcher.add(row)
    assert searcher.scored < searcher.pairs / 2


def test_ranking_of_empty_tables_and_null_keys(docs, items):
    assert ranking.rank_documents(docs([]), items([(1, "x")])).collect() == []
    assert ranking.rank_documents(docs([(1, "x")]), items([])).collect() == []
    found = ranking.rank_documents(docs([(None, "x y"), (3, "x y"), (3, "x y"), (4, "z")]), items([(None, "x"), (1, "x")])).collect()
    assert sorted((r.item_id is None, r["rank"], r.doc_id) for r in found if r.doc_id is not None) == [
        (False, 1, 3), (False, 2, 3), (True, 1, 3), (True, 2, 3)]
    assert {r["rank"] for r in found if r.doc_id is None} == {3}


def test_rows_of_one_item_are_one_item(docs, items):
    rows = [(1, "x"), (2, "y"), (3, "z")]
    found = ranked(ranking.rank_documents(docs(rows), items([(7, "x"), (7, "y"), (7, "x")])))
    assert [k for k, _ in found[7]] == [1, 2]


# line dedup


def brute_lines(rows, least_chars=20, least_docs=3):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(0x41, 0x5B)})
        return line if len(line) >= least_chars else None

    held = defaultdict(set)
    for k, text in rows:
        if k is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(k)
    out = []
    for k, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if k is None or key(x) is None or len(held[key(x)]) < least_docs or max(held[key(x)]) == k]
        out.append((k, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(seed, n):
    draw = random.Random(seed)
    pool = [f"{'line ' * 4}number {k} É" for k in range(25)] + ["short", "", "naïve ligne de vingt", "   Spaces around this very line\t"]
    return [(k, "\n".join(draw.choice([str.upper, str.title, lambda x: " " + x + "\r"])(draw.choice(pool)) for _ in range(draw.randrange(9)))) for k in range(n)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (7, 3)])
def test_lines_equal_brute_force_for_any_number_of_batches(docs, batches, fanout):
    rows = [*line_rows(5, 60), *((100 + k, t) for k, t in enumerate(ODD)), (200, "one very common line of text\n" * 4000), (None, "line line line line number 3 É")]
    found = [tuple(r) for r in lines.drop_repeated_lines(docs(rows), batches=batches, fanout=fanout).collect()]
    assert sorted(found, key=repr) == brute_lines(rows)


def test_rows_with_one_key_are_one_document(docs):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line), (2, line + "\nother")]
    assert {tuple(r) for r in lines.drop_repeated_lines(docs(rows)).collect()} == set(brute_lines(rows))
    rows = [*rows, (3, line)]
    assert sorted(map(tuple, lines.drop_repeated_lines(docs(rows)).collect())) == brute_lines(rows)
    assert lines.drop_repeated_lines(docs([])).collect() == []


def test_runs_hold_each_hash_once_and_stay_few(spark, docs):
    runs = lines.LineRuns(spark, fanout=2)
    rows = line_rows(6, 80)
    for at in range(0, 80, 10):
        found = lines.line_hashes(docs(rows[at : at + 10]), "doc_id", "text", 20)
        marked = runs.add(found)
        before = {bytes(h) for k in range(at) for h in map(lambda x: lines.line_key(x.encode(), 20), rows[k][1].split("\n")) if h}
        assert {bytes(r.hash) for r in marked.filter("known").collect()} <= before
        assert not {bytes(r.hash) for r in marked.filter("not known").collect()} & before
    held = [bytes(r.hash) for name in runs.runs() for r in runs._held(name).collect()]
    assert len(held) == len(set(held)) and len(runs.runs()) == 1 and len(runs.levels) == 4
    runs.drop()


# collocations


def brute_collocations(rows, least, covered=80, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= covered * count[lang, p[i : i + m]]:
                    hidden.add((lang, p[i : i + m]))
    out = defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if (lang, p) not in hidden:
            out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, own in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1)
    }


def wide(spark, rows):
    return spark.createDataFrame(
        [(k, lang, text, 1, "x", 2) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, id int, block string, a int")


@pytest.mark.parametrize("block_words, least", [(1, 3), (150, 3), (500_000, 8)])
def test_collocations_equal_brute_force(spark, monkeypatch, block_words, least):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(collocations, "HELD_WORDS", 2 * block_words)
    draw = random.Random(8)
    rows = [(draw.choice(["en", "fr", None, ""]), t) for t in [*texts(9, 60), *ODD, *["Of the data, run the row of x"] * 9]]
    found = {tuple(r) for r in collocations.collocations(wide(spark, rows), least=least).collect()}
    assert found == brute_collocations(rows, least)


def test_collocations_are_cut_after_the_last_rank(spark):
    rows = [("en", t) for t in texts(10, 80)]
    found = {tuple(r) for r in collocations.collocations(wide(spark, rows), least=3, top=7).collect()}
    assert found == brute_collocations(rows, 3, top=7) and len(found) == 7


def test_collocations_of_nothing_and_of_one_long_text(spark):
    assert collocations.collocations(wide(spark, [])).collect() == []
    assert collocations.collocations(wide(spark, [("en", None), (None, "")])).collect() == []
    rows = [("en", "a b " * 30000)]
    assert {tuple(r) for r in collocations.collocations(wide(spark, rows)).collect()} == brute_collocations(rows, 30)


def test_line_keys_count_code_points_of_the_stripped_line():
    assert lines.line_key(b" A line of twenty cha ", 20) == lines.line_key(b"a LINE of twenty cha\r", 20)
    assert lines.line_key("é".encode() * 19, 20) is None and lines.line_key("é".encode() * 20, 20) is not None
