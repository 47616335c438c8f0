"""License scans, BPE, SimHash and substring dedup against brute force."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetdelta.llm import bpe, licences, queries, simhash, substring
from sheetdelta.llm.common import roots
from sheetdelta.llm.fmindex import FMIndex

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\t", "İǅ <|endoftext|>x", "I'm  we'LL　", "a" * 700, "é日本🙂 " * 40, "=-" * 300, "\x00\x1f\x7f"]


def by_key(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    return {r[key]: r for r in rows}


# license scans


def brute_licences(text):
    words, starts, labels = licences.words_of((text or "").encode()), [], set()
    for phrase, label in licences.BASE.items():
        parts = phrase.encode().split()
        for at in range(len(words) - len(parts) + 1):
            if words[at : at + len(parts)] == parts:
                starts.append(at)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences_equal_brute_force(docs):
    texts = [
        None, *ODD, "MIT License", "the mit,license and MIT-LICENSE mit", "Under the Apache License, Version 2.0. apache license",
        "GNU General Public License, version 3", "x " * 5000 + "General public LICENSE", "générale public license émit license",
    ]
    found = by_key(licences.scan_licences(docs(list(enumerate(texts)))))
    for key, text in enumerate(texts):
        row = found[key]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute_licences(text)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


@pytest.mark.parametrize("label, wording, keys", licences.TEMPLATES)
def test_each_wording_is_found_and_no_other(docs, label, wording, keys):
    found = by_key(licences.scan_licences(docs([(1, f"Some words. {wording.upper()}. More words."), (2, "nothing of it")])))
    own = set(found[1]["labels"].split(",")) - set(licences.BASE.values()) | ({"mit"} if label == "mit" else set())
    assert own == {label} and found[2]["labels"] == "" and found[2]["score"] == 0


def test_a_text_of_all_wordings_has_all_labels(docs):
    text = ". ".join(wording for _, wording, _ in licences.TEMPLATES)
    others = [(k, wording) for k, (_, wording, _) in enumerate(licences.TEMPLATES) for _ in range(3)]
    found = by_key(licences.scan_licences(docs([(99, text), *others])))
    assert set(found[99]["labels"].split(",")) >= {label for label, _, _ in licences.TEMPLATES}


def test_licences_of_an_empty_table_and_repeated_rows(docs):
    assert licences.scan_licences(docs([])).collect() == []
    assert licences.scan_licences(docs([(1, "mit license"), (1, "mit license"), (None, "x")])).count() == 3


# BPE


def test_ids_and_text_equal_the_library(docs):
    library, draw = Tokenizer.from_file(VOCABULARY), random.Random(3)
    letters = "abc thein,.ß日\x7f  \n\t#*'12"
    texts = [None, *ODD, *("".join(draw.choice(letters) for _ in range(draw.randrange(400))) for _ in range(200)), "the cat " * 20000]
    found = by_key(bpe.encode_documents(docs(list(enumerate(texts))), VOCABULARY))
    for key, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert found[key]["ids"] == want
        assert found[key]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_white_space_of_any_kind_and_forgotten_pieces_equal_the_library():
    library, draw = Tokenizer.from_file(VOCABULARY), random.Random(4)
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = bpe.Encoder(bpe.Vocabulary(json.load(file)), kept=7)
    texts = ["".join(draw.choice(["a", "the", "'s", "9", ".", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000"]) for _ in range(12)) for _ in range(3000)]
    for text, ids in zip(texts, [*encoder.encode(texts[:2000]), *encoder.encode(texts[2000:])]):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_lie_between_tokens():
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = bpe.Vocabulary(json.load(file)).encoder()
    for text in ("hello world", "naïve日本", "x=-1;y"):
        raw = text.encode()
        assert b"".join(encoder.split(raw)) == raw
        for part in encoder.split(raw):
            assert encoder.merge(part) == encoder.merge_long(part)


def test_digests(docs):
    found = by_key(bpe.digest_documents(docs([(1, "hello"), (2, None)]), VOCABULARY))
    ids = Tokenizer.from_file(VOCABULARY).encode("hello", add_special_tokens=False).ids
    assert found[1]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert found[2] == {
        "doc_id": 2, "n_tokens": 0, "ids_sha256": hashlib.sha256(b"").hexdigest(), "decoded_sha256": hashlib.sha256(b"").hexdigest(),
    }


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def components(prints, bits):
    keys, root = sorted(prints), {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_components_equal_brute_force(docs):
    draw = random.Random(5)
    base = [" ".join(draw.choice("ab cd ef gh ij kl mn op".split()) for _ in range(draw.choice([1, 3, 60, 300]))) for _ in range(40)]
    texts = [None, *ODD, *base]
    for t in base:
        words = t.split()
        words[draw.randrange(len(words))] = "zz"
        texts += [" ".join(words), t.upper(), t.replace(" ", " \n")]
    found = by_key(simhash.near_duplicates(docs(list(enumerate(texts))), block=4))
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    assert {k: r["lane0"] & (1 << 64) - 1 for k, r in found.items()} == prints
    assert {k: r["component_id"] for k, r in found.items()} == components(prints, 4)


@pytest.mark.parametrize("block", [2, 16, 512])
def test_dense_fingerprints_are_linked_whatever_the_block(spark, block):
    draw, prints = random.Random(block), {0: 0x0123456789ABCDEF}
    while len(prints) < 250:
        value = draw.choice(list(prints.values()))
        for bit in draw.sample(range(64), draw.choice([1, 3, 4, 5, 9])):
            value ^= 1 << bit
        if value not in prints.values():
            prints[len(prints)] = value
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in prints.items()}
    fps = spark.createDataFrame([(v, v) for v in signed.values()], "id long, lane0 long")
    links = [(r.a, r.b) for r in simhash.link_signatures(fps, 4, 1, 3, block).collect()]
    parent = {v: v for v in signed.values()}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[find(a)] = find(b)
    want = components(prints, 4)
    for a in prints:
        for b in prints:
            assert (find(signed[a]) == find(signed[b])) == (want[a] == want[b])


def test_keep_one_leaves_one_of_each_group(docs):
    draw = random.Random(1)
    long = [" ".join(f"w{draw.randrange(9999)}" for _ in range(300)) for _ in range(3)]
    near = " ".join(["changed", *long[0].split()[1:]])
    rows = [(1, long[0]), (2, near), (3, long[1]), (4, long[1]), (5, long[2]), (6, None), (7, ""), (None, long[0])]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted(kept.collect(), key=str) == sorted(docs([r for r in rows if r[0] in (1, 3, 5, 6, None)]).collect(), key=str)


def altered(draw, words, share, name):
    """Text of ``words`` with single words replaced until about ``share`` of the 5-word shingles are common."""
    own, keep = list(words), set(grams(words))
    while len(keep & set(grams(own))) / len(keep | set(grams(own))) > share:
        own[draw.randrange(len(own))] = f"{name}x{draw.randrange(10**6)}"
    return own


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


@pytest.mark.parametrize("block", [40, 32768])
def test_near_copies_down_to_the_threshold_are_found(docs, block):
    draw, rows = random.Random(8), []
    for pair in range(150):
        words = [f"p{pair}w{draw.randrange(10**6)}" for _ in range(400)]
        near = altered(draw, words, 0.83, f"p{pair}")
        assert len(set(grams(words)) & set(grams(near))) / len(set(grams(words)) | set(grams(near))) >= 0.8
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(near))]
    assert {r.doc_id for r in simhash.keep_one(docs(rows), block=block).collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("group_block", [4, 128])
def test_keep_one_equals_brute_force_between_shares(docs, group_block):
    draw, rows = random.Random(9), [(0, ""), (1, "one two"), (2, "one two three"), (3, "ONE  two")]
    for family in range(12):
        words = [f"f{family}w{draw.randrange(10**6)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + k, " ".join(altered(draw, words, draw.uniform(0.6, 0.95), f"f{family}"))) for k in range(12)]
    sets = {k: set(grams(t.lower().split())) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {find(k) for k in sets}
    assert 12 < len(want) < len(rows) - 12
    assert {r.doc_id for r in simhash.keep_one(docs(rows), group_block=group_block).collect()} == want


def test_a_large_group_of_near_copies_costs_links_in_proportion_to_its_members(spark):
    draw = random.Random(11)
    words = [draw.randrange(1 << 60) for _ in range(300)]
    sets = [np.unique(np.array([*words[:290], *(draw.randrange(1 << 60) for _ in range(10))], np.uint64)) for _ in range(1500)]
    # two chains of texts that are alike, only neighbours similar enough, and some that are like no other
    sets += [np.unique(np.array(words[k : k + 250], np.uint64)) for k in range(0, 50, 10)]
    sets += [np.unique(np.array([draw.randrange(1 << 60) for _ in range(20)], np.uint64)) for _ in range(30)]
    rows = spark.createDataFrame([(7, k, s.tobytes()) for k, s in enumerate(sets)], "grp long, id long, shingles binary")

    def compare(part, side, label):
        return simhash.similar_sets([np.frombuffer(s, "<u8") for s in part["shingles"].to_pylist()], 0.8, side, label)

    links = simhash.link_groups(rows, 100, compare).collect()
    assert len(links) <= 2 * len(sets)
    found = roots(np.array([r.a for r in links]), np.array([r.b for r in links]), len(sets))
    assert np.array_equal(found, simhash.similar_sets(sets, 0.8))


def test_simhash_of_an_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == [] and simhash.keep_one(docs([])).collect() == []


# substring dedup


def brute_repeats(rows, window):
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    for (key, _), own in zip(rows, words):
        for p in range(len(own) - window + 1 if key is not None else 0):
            gram = tuple(own[p : p + window])
            first[gram] = min(first.get(gram, key), key)
    out = []
    for (key, _), own in zip(rows, words):
        keep = [True] * len(own)
        for p in range(len(own) - window + 1 if key is not None else 0):
            if first[tuple(own[p : p + window])] < key:
                keep[p : p + window] = [False] * window
        kept = [w for w, k in zip(own, keep) if k]
        out.append((key, len(own), len(own) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("dense", [1, 3, 2000])
def test_repeats_equal_brute_force(docs, dense, monkeypatch):
    draw = random.Random(dense)
    shared = [[f"p{k}{draw.randrange(50)}" for _ in range(n)] for k, n in enumerate((19, 20, 21, 45, 120))]
    rows = [(None, " ".join(shared[4])), (5, None), (6, ""), (7, " \t\n")]
    for key in range(10, 60):
        own = []
        for _ in range(draw.randrange(4)):
            own += [f"u{draw.randrange(400)}" for _ in range(draw.randrange(40))] + draw.choice(shared)
        rows.append((key, draw.choice([" ", "\n"]).join(own)))
    rows += [(70, rows[20][1]), (70, rows[20][1]), (70, rows[21][1]), (71, "same " * 90), (72, "same " * 60)]
    monkeypatch.setattr(substring.repeated_windows, "__defaults__", (50, 6, dense))
    found = [tuple(r) for r in substring.remove_repeats(docs(rows), window=20).collect()]
    assert sorted(found, key=str) == brute_repeats(rows, 20)


def test_without_repeats_keeps_rows_and_other_texts(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, f"own  words\n{passage} end"), (3, "short  text\n"), (4, None), (None, passage), (5, passage)]
    found = sorted(((r.doc_id, r.text) for r in substring.without_repeats(docs(rows)).collect()), key=str)
    assert found == sorted([(1, passage), (2, "own words end"), (3, "short  text\n"), (4, None), (None, passage), (5, "")], key=str)
    assert substring.without_repeats(docs([])).columns == docs([]).columns


def test_matching_statistics_equal_brute_force():
    draw = np.random.default_rng(0)
    for _ in range(40):
        m = int(draw.integers(1, 12))
        lengths, owners = draw.integers(1, 30, m), draw.integers(0, 4, m)
        texts = [draw.integers(0, draw.integers(1, 5), n).astype(np.uint64) * 7 + 3 for n in lengths]
        padded = np.zeros((m, lengths.max()), np.uint64)
        for i, t in enumerate(texts):
            padded[i, : len(t)] = t
        found = FMIndex(np.concatenate(texts), lengths, owners).matching_statistics(padded, lengths, owners)
        for i, t in enumerate(texts):
            for s in range(len(t)):
                grams = (
                    k for k in range(len(t) - s, 0, -1)
                    if any(
                        owners[j] < owners[i] and any(np.array_equal(u[a : a + k], t[s : s + k]) for a in range(len(u) - k + 1))
                        for j, u in enumerate(texts)
                    )
                )
                assert found[i, s] == next(grams, 0)


def test_query_columns(spark):
    for name in ("op4_simhash_components", "op8_bpe_round_trip", "op9_substring_dedup", "op10_license_scan"):
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count(), name
        assert found.select(F.col("doc_id")).distinct().count() == found.count()


def test_repeats_leave_with_clashing_columns_and_repeated_words(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, passage, "a", 1, 2, 3), (2, "x " + passage + " y", "b", 1, 2, 3), (3, "again " * 300, "c", 1, 2, 3), (4, "again " * 70, "d", 1, 2, 3)]
    rows += [rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, _text int, _row int, _key int")
    found = sorted(map(tuple, substring.without_repeats(df).collect()))
    assert [(r[0], r[1], r[2]) for r in found] == [(1, passage, "a"), (2, "x y", "b"), (2, "x y", "b"), (3, "again " * 300, "c"), (4, "", "d")]
    shown = substring._all_passages(df.select("doc_id", "text").toDF("key", "text"), 50, 12).filter("key = 3").collect()
    assert len(shown) == 1 and len(shown[0].starts) == 251
