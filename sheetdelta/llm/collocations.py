"""Collocations by set-oriented mining over sorted occurrence relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta.llm.common import arrow_schema, bucketed, encoded, per_batch, written
from sheetdelta.session import cut

#: Words of one block of a relation, and of all blocks that a task holds, about; a document is never cut.
BLOCK_WORDS, HELD_WORDS = 500_000, 2_000_000
#: Groups that each bring their own best phrases before those of a language are ranked.
GROUPS = 64

# Bytes that end a piece; only A-Z are lowered, tabs part words like spaces.
_FOLD = bytes.maketrans(
    b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b".......... abcdefghijklmnopqrstuvwxyz",
)


def words_and_ends(text: bytes) -> list[bytes]:
    """Words of a text in lower case, with ``b"."`` between its pieces."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class _Places(dict):
    """Numbers words by first use; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _packed(at: np.ndarray, place: np.ndarray) -> dict[str, object]:
    """A relation sorted by position, as gaps and as places in the block's own dictionary."""
    return {"size": len(at), "gap": _narrow(np.diff(at, prepend=0)), "place": _narrow(place)}


def _unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch["size"][k].as_py()
    return np.cumsum(_wide(batch["gap"][k].as_py(), n)), _wide(batch["place"][k].as_py(), n)


class _Block:
    """Documents of one language that a task gathers to one row."""

    def __init__(self) -> None:
        self.places, self.parts, self.size = _Places(), [], 0

    def add(self, text: bytes) -> int:
        found = np.array([*map(self.places.__getitem__, words_and_ends(text)), 0], np.int32)
        self.parts.append(found)
        new = int(np.count_nonzero(found))
        self.size += new
        return new

    def row(self, number: int, lang: str) -> dict[str, object]:
        """Positions of ends stay free, so adjacent positions are adjacent words of one piece."""
        tokens = np.concatenate(self.parts)
        at = np.flatnonzero(tokens)
        words = [w.decode() for w in self.places][1:]
        counts = np.bincount(tokens, minlength=len(self.places))[1:]
        return {"block": number, "lang": lang, "words": words, "counts": counts} | _packed(at, tokens[at] - 1)


def _blocks(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """One row per block of words: its words with their counts, and the occurrence relation."""
    schema = "block long, lang string, size long, words array<string>, counts array<long>, gap binary, place binary"
    target = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                if name not in held:
                    held[name] = _Block()
                size += held[name].add(value)
                full = list(held) if size >= HELD_WORDS else [name] if held[name].size >= BLOCK_WORDS else []
                for each in full:
                    block = held.pop(each)
                    size, number = size - block.size, number + 1
                    yield pa.RecordBatch.from_pylist([block.row(number, each)], schema=target)
        for name, block in held.items():
            number += 1
            yield pa.RecordBatch.from_pylist([block.row(number, name)], schema=target)

    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string"))
    return plain.mapInArrow(work, schema)


#: A relation of phrases: positions, and places among the sorted ids of the block.
RELATION = "block long, size long, gap binary, place binary, ids array<long>"


def _adjacent(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a sorted relation with itself by adjacent position.

    Returns the sorted ids, and for every pair its position and the places of both ids among them.
    """
    known = batch["ids"][k].values.to_numpy()
    at, place = _unpacked(batch, k)
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    return known, at[first], place[first], place[first + 1]


def _pairs(relation: DataFrame) -> DataFrame:
    """(block, a, b, n): phrases one word longer, as their first and last part, counted per block."""
    schema = arrow_schema("block long, a long, b long, n long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known, _, a, b = _adjacent(batch, k)
                pairs, counts = np.unique(a * len(known) + b, return_counts=True)
                if len(pairs):
                    block = np.full(len(pairs), batch["block"][k].as_py())
                    columns = (block, known[pairs // len(known)], known[pairs % len(known)], counts)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return relation.mapInArrow(work, "block long, a long, b long, n long")


def _row(at: np.ndarray, ids: np.ndarray) -> dict[str, object]:
    known, place = np.unique(ids, return_inverse=True)
    return {"ids": known} | _packed(at, place)


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of keys that occur ``least`` times in all, with that number ``f`` and an ``id`` of the key.

    The id is the number of one of the key's rows, so nothing is joined to get it.
    """
    same = Window.partitionBy(*keys)
    numbered = rows.repartition(*keys).withColumn("at", F.monotonically_increasing_id())
    counted = numbered.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("at").over(same))
    return counted.filter(F.col("f") >= least).drop("n", "at")


def _longer(relation: DataFrame, ids: DataFrame) -> DataFrame:
    """The relation of the phrases one word longer that ``ids`` (block, a, b, id) names."""
    named = ids.groupBy("block").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("id").alias("new"))

    def work(batch) -> dict[str, object]:
        out = []
        for k in range(batch.num_rows):
            known, at, a, b = _adjacent(batch, k)
            first, last, new = (batch[n][k].values.to_numpy() for n in ("a", "b", "new"))
            code = np.searchsorted(known, first) * len(known) + np.searchsorted(known, last)
            order = np.argsort(code)
            code, new, own = code[order], new[order], a * len(known) + b
            place = np.minimum(np.searchsorted(code, own), len(code) - 1)
            held = code[place] == own
            out.append(_row(at[held], new[place[held]]))
        return {"block": batch["block"]} | {n: [row[n] for row in out] for n in ("size", "gap", "place", "ids")}

    return per_batch(relation.join(named, "block"), work, RELATION)


def _word_relation(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The relation of the occurrences of frequent words."""
    named = words.groupBy("block").agg(F.collect_list("slot").alias("places"), F.collect_list("id").alias("new"))
    own = blocks.select("block", "size", "gap", "place", F.size("words").alias("distinct"))

    def work(batch) -> dict[str, object]:
        out = []
        for k in range(batch.num_rows):
            at, place = _unpacked(batch, k)
            ids = np.full(batch["distinct"][k].as_py(), -1, np.int64)
            ids[batch["places"][k].values.to_numpy()] = batch["new"][k].values.to_numpy()
            found = ids[place]
            out.append(_row(at[found >= 0], found[found >= 0]))
        return {"block": batch["block"]} | {n: [row[n] for row in out] for n in ("size", "gap", "place", "ids")}

    return per_batch(own.join(named, "block"), work, RELATION)


def _named_phrases(counted: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with an id, their words, and the counts of all their first (``pre``) and last (``suf``) parts."""
    a = shorter.select(F.col("id").alias("a"), "lang", F.col("words").alias("_first"), F.array_append("pre", F.col("f")).alias("pre"))
    b = shorter.select(
        F.col("id").alias("b"), F.element_at("words", -1).alias("_last"), F.array_prepend("suf", F.col("f")).alias("suf"))
    return counted.join(a, "a").join(b, "b").select(
        "id", "lang", F.array_append("_first", F.col("_last")).alias("words"),
        "f", "pre", "suf", "a", "b",
    )


def _worst_cut() -> Column:
    """(score, k, l, r) of the lowest-scoring cut, the first one of equals; products may pass 64 bits."""

    def scored(parts: Column, k: Column) -> Column:
        top = F.lit(2_000_000).cast("decimal(10,0)") * F.col("f").cast("decimal(20,0)")
        score = F.call_function("div", top, (parts["pre"] + parts["suf"]).cast("decimal(20,0)"))
        return F.struct(score.alias("score"), k.alias("k"), parts["pre"].alias("l"), parts["suf"].alias("r"))

    return F.array_min(F.transform(F.arrays_zip("pre", "suf"), scored))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000,
) -> DataFrame:
    """The phrases of each language whose weakest cut binds best: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``longest`` words of one piece and occur ``least`` times or more. A relation
    of (position, phrase) is kept sorted in blocks; each round merge-joins it with itself by
    adjacent position, counts the longer phrases over all blocks and keeps the occurrences of the
    frequent ones for the next round: both parts of a frequent phrase are frequent. Phrases inside a
    longer one with ``covered`` % of their occurrences are left out. Words and phrases are compared
    exactly, by ids. Null texts are empty, a null language is ``und``; repeated rows count each;
    no word gives no row. Other columns are not read.
    """
    blocks, forget_blocks = bucketed(_blocks(docs, lang, text), "block")
    totals = cut(blocks.groupBy("lang").agg(F.sum("size").alias("n")))
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("slot", "w"))
    each = each.select("block", "lang", "slot", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent, forget_frequent = written(_frequent(each, ["lang", "word"], least))
    none = F.array().cast("array<long>")
    level = frequent.groupBy("id").agg(*(F.first(c).alias(c) for c in ("lang", "word", "f")))
    level = cut(level.select("id", "lang", F.array("word").alias("words"), "f", none.alias("pre"), none.alias("suf")))
    relation, forget = bucketed(_word_relation(blocks, frequent), "block")
    forget_blocks()
    levels = []
    for k in range(2, longest + 1):
        forget_frequent()
        frequent, forget_frequent = written(_frequent(_pairs(relation), ["a", "b"], least))
        level = cut(_named_phrases(frequent.groupBy("id").agg(*(F.first(c).alias(c) for c in ("a", "b", "f"))), level))
        levels.append(level)
        last, forget_last = relation, forget
        if k < longest:
            relation, forget = bucketed(_longer(last, frequent), "block")
        forget_last()
    forget_frequent()
    return _ranked(levels, totals, covered, top)


def _ranked(levels: list[DataFrame], totals: DataFrame, covered: int, top: int) -> DataFrame:
    found = None
    for level, above in zip(levels, [*levels[1:], None]):
        kept = level.select("id", "lang", "words", "f", "pre", "suf")
        if above is not None:
            # a longer phrase around it is never more frequent than one that is longer by a word
            around = above.select(F.col("a").alias("id"), F.col("f").alias("more")).unionByName(
                above.select(F.col("b").alias("id"), F.col("f").alias("more"))).groupBy("id").agg(F.max("more").alias("more"))
            kept = kept.join(around, "id", "left").filter(f"more is null or 100 * more < {covered} * f").drop("more")
        found = kept if found is None else found.unionByName(kept)
    scored = found.select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), _worst_cut().alias("cut"), F.pmod("id", F.lit(GROUPS)).alias("group"),
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "group")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
