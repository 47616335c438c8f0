"""Removal of passages that repeat earlier documents, by FM-indexes of anchored passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import arrow_schema, encoded, per_batch
from sheetdelta.llm.fmindex import FMIndex
from sheetdelta.session import cut

#: Words of the gram that anchors a window.
GRAM = 12
#: Words of one shard's index, about.
SHARD_WORDS = 250_000
#: Different passages of one anchor that one shard takes; where there are more, they are cut to single windows.
DENSE = 2_000

# Odd multipliers of the 64-bit rolling and mixing hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


class Slices:
    """Hashes of word sequences wherever they stand: prefix sums of a polynomial, shifted to power 0."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.shift = _powers(_INVERSE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.shift[starts])


def passages(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: first window, number of windows, anchor, content.

    The anchor of a window is its gram with the least hash, the first one of equals; it
    depends on the window's words alone, so equal windows always have equal anchors.
    """
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    slices = Slices(hashes)
    at = np.arange(len(hashes) - gram + 1)
    grams = slices.of(at, at + gram)
    reach = window - gram + 1
    anchor = np.empty(len(hashes) - window + 1, np.int64)
    for a in range(0, len(anchor), 1 << 16):
        b = min(len(anchor), a + (1 << 16))
        views = np.lib.stride_tricks.sliding_window_view(grams[a : b + reach - 1], reach)
        anchor[a:b] = views.argmin(axis=1) + np.arange(a, b)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    counts = np.diff(np.append(starts, len(anchor)))
    content = slices.of(starts, starts + counts + window - 1)
    return starts, counts, grams[anchor[starts]], content


def _folded(starts: np.ndarray, counts: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of windows, anchor and content of each different run, how often it stands, and all first windows in its order."""
    order = np.lexsort((starts, content, anchor))
    anchor, content = anchor[order], content[order]
    new = np.append(True, (np.diff(anchor) != 0) | (np.diff(content) != 0))[: len(order)]
    first = np.flatnonzero(new)
    places = np.diff(np.append(first, len(order)))
    return counts[order][first], anchor[first], content[first], places, starts[order]


def _row() -> Column:
    """Identity of a row's text: rows may share a key, and may then differ in text."""
    return F.xxhash64(F.col("text")).alias("row")


def _all_passages(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, content, key, row, starts, n) of every run of windows with a common anchor.

    A text gives one row for equal runs, however often it repeats them.
    """

    def work(batch) -> dict[str, object]:
        found = [_folded(*passages(word_hashes(t.split()), window, gram)) for t in encoded(batch.column(2))]
        sizes = [len(f[0]) for f in found]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n, anchor, content, places, starts = (np.concatenate([f[k] for f in found]) for k in range(5))
        edges = pa.array(np.concatenate([[0], np.cumsum(places)]), pa.int32())
        return {
            "anchor": anchor.view(np.int64), "content": content.view(np.int64), "key": batch.column(0).take(pa.array(owner)),
            "row": batch.column(1).take(pa.array(owner)), "starts": pa.ListArray.from_arrays(edges, pa.array(starts, pa.int32())),
            "n": n.astype(np.int32),
        }

    kind = docs.schema["key"].dataType.simpleString()
    return per_batch(
        docs.filter("key is not null").select("key", _row(), "text"), work,
        f"anchor long, content long, key {kind}, row long, starts array<int>, n int",
    )


def _spread(found: DataFrame, docs: DataFrame, window: int, shards: int, dense: int) -> DataFrame:
    """(shard, anchor, content, key, at, words, window): the words of each passage, by shard.

    Passages of an anchor go to one shard. Those of an anchor with more than ``dense``
    different passages are cut to single windows, which carry their hash and no words:
    passages of one window need no index, as equal ones fold.
    """
    wanted = found.groupBy("key", "row").agg(F.collect_list(F.struct("anchor", "content", "start", "n", "variants")).alias("wanted"))
    texts = docs.filter("key is not null").select("key", _row(), "text").dropDuplicates(["key", "row"])
    joined = texts.join(wanted, ["key", "row"]).select("key", "text", "wanted")
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"shard int, anchor long, content long, key {kind}, at int, words binary, window long"
    target = arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, text, wanted in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist()):
                hashes = word_hashes(text.split())
                slices = Slices(hashes)
                for w in wanted:
                    start, n = w["start"], w["n"]
                    if w["variants"] <= dense:
                        words = hashes[start : start + n + window - 1].tobytes()
                        out.append((w["anchor"] % shards, w["anchor"], w["content"], key, 0, words, None))
                    else:
                        at = np.arange(start, start + n)
                        for k, own in enumerate(slices.of(at, at + window).view(np.int64).tolist()):
                            out.append((-1, w["anchor"], w["content"], key, k, None, own))
                    if len(out) > 4096:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    return joined.mapInArrow(work, schema)


def _folded_windows(spread: DataFrame) -> DataFrame:
    """(anchor, content, at, n) of single windows that a smaller key holds too."""
    windows = spread.filter("shard < 0").select("anchor", "content", "key", "at", "window")
    owners = windows.groupBy("window").agg(F.min("key").alias("owner"), F.max("key").alias("last")).filter("owner < last")
    return windows.join(owners, "window").filter("key > owner").select("anchor", "content", "at", F.lit(1).alias("n"))


def _search(spread: DataFrame, window: int) -> DataFrame:
    """(anchor, content, at, n): windows of a passage that a passage of a smaller key holds."""

    def shard(part: pa.Table) -> pa.Table:
        passages_of = part["words"].to_pylist()
        lengths = np.array([len(w) // 8 for w in passages_of])
        words = np.frombuffer(b"".join(passages_of), np.uint64)
        # keys are compared by rank, so any orderable type works
        _, owners = np.unique(np.array(part["key"].to_pylist()), return_inverse=True)
        index = FMIndex(words, lengths, owners)
        table = np.zeros((len(lengths), lengths.max()), np.uint64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = words
        hit = index.matching_statistics(table, lengths, owners) >= window
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        return pa.table({
            "anchor": part["anchor"].take(pa.array(row)), "content": part["content"].take(pa.array(row)),
            "at": pa.array(np.array(part["at"])[row] + start, pa.int32()), "n": pa.array(end - start, pa.int32()),
        })

    return spread.groupBy("shard").applyInArrow(shard, "anchor long, content long, at int, n int")


def repeated_windows(docs: DataFrame, window: int = 50, gram: int = GRAM, dense: int = DENSE) -> DataFrame:
    """(key, row, spans) of rows with windows that start in a row with a smaller key.

    Each document's windows are grouped into passages with a common anchor. Equal passages
    are folded to their smallest key; every later copy repeats it whole. Different passages
    of one anchor go to a shard, which indexes them and searches each of them for windows
    held by passages of smaller keys. Spans hold where a passage stands, and its covered
    parts as (first, end) positions in it.
    """
    found = cut(_all_passages(docs, window, gram))
    folded = cut(found.groupBy("anchor", "content").agg(
        F.min("key").alias("owner"), F.max("key").alias("last"), F.min_by(F.struct("row", F.col("starts")[0].alias("start"), "n"), "key").alias("place"),
    ))
    anchors = folded.groupBy("anchor").agg(
        F.count("*").alias("variants"), F.min("owner").alias("low"), F.max("last").alias("high")
    ).filter("low < high")
    folded = cut(folded.join(anchors, "anchor").filter("variants > 1 or owner < last").select(
        "anchor", "content", "owner", "last", "place", "variants"))
    several = folded.filter("variants > 1").select("anchor", "content", F.col("owner").alias("key"), "place.*", "variants")
    words = several.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    spread = cut(_spread(several, docs, window, shards, dense))
    matched = _search(spread.filter("shard >= 0").drop("window"), window).unionByName(_folded_windows(spread))
    matched = cut(matched.groupBy("anchor", "content").agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    facts = folded.join(matched, ["anchor", "content"], "left").filter("owner < last or runs is not null").select(
        "anchor", "content", "owner", "runs")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).alias("b")))
    part = F.transform("runs", lambda r: F.struct(r["at"].alias("a"), (r["at"] + r["n"] + window - 1).alias("b")))
    spans = found.join(facts, ["anchor", "content"]).select(
        "key", "row", "starts", F.when(F.col("key") > F.col("owner"), whole).otherwise(part).alias("parts"))
    # rows that are the same give the same spans
    return spans.filter("parts is not null").groupBy("key", "row").agg(F.collect_set(F.struct("starts", "parts")).alias("spans"))


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """Words that no part of a passage covers, wherever the passage stands."""
    change = np.zeros(len(words) + 1, np.int32)
    for span in spans:
        starts = np.array(span["starts"])
        for part in span["parts"]:
            np.add.at(change, starts + part["a"], 1)
            np.add.at(change, starts + part["b"], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Each row's text without words covered by a window that starts in a row with a smaller key.

    Returns key, n_words, n_removed, kept (the kept words joined by one space). Windows are
    judged on the input. Null and empty texts have no words; a row with a null key is
    neither larger nor smaller than any other and keeps all its words; rows with equal keys
    don't remove each other's words; repeated rows keep a row each. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    spans = repeated_windows(plain, window)
    joined = plain.select("key", "text", _row()).join(spans, ["key", "row"], "left").select("key", "text", "spans")

    def work(batch) -> dict[str, object]:
        total, removed, kept = [], [], []
        for value, found in zip(encoded(batch.column(1)), batch.column(2).to_pylist()):
            words = value.split()
            total.append(len(words))
            if found:
                words = kept_words(words, found)
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return {"key": batch.column(0), "n_words": total, "n_removed": removed, "kept": kept}

    return per_batch(joined, work, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts; texts without any stay as they are.

    Rows that lose all their words stay with an empty text.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # names that no column of the table has
    own = {n: "_" * (1 + max(map(len, docs.columns))) + n for n in ("key", "row", "spans", "text")}
    spans = repeated_windows(plain, window).withColumnsRenamed(own)
    joined = docs.join(
        spans, (docs[key] == spans[own["key"]]) & (F.xxhash64(docs[text].cast("string")) == spans[own["row"]]), "left"
    ).withColumn(own["text"], docs[text].cast("string"))
    names = docs.columns
    at_text, at_spans = joined.columns.index(own["text"]), joined.columns.index(own["spans"])
    target = arrow_schema(docs.schema.simpleString()[7:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found in zip(batch.column(at_text).to_pylist(), batch.column(at_spans).to_pylist()):
                if found:
                    value = b" ".join(kept_words(value.encode().split(), found)).decode()
                out.append(value)
            arrays = [pa.array(out, pa.string()) if n == text else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return joined.mapInArrow(work, docs.schema)
