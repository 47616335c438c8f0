"""Ranked lexical search with bit-sliced Bloom signatures and exact rescoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta.llm.common import arrow_schema, encoded, per_batch, written
from sheetdelta.session import cut

#: Most documents of a shard, and most bits of its slices; documents of one shard have about the same number of terms.
SHARD_DOCS, SHARD_BITS = 4096, 1 << 25
#: Bits of a signature per entry, and slices that an entry sets.
BITS_PER_ENTRY, SLICES = 8, 4
#: Terms of all items that are searched in one pass over the shards, about.
PASS_TERMS = 20_000
#: Terms whose slices are read at once.
TERM_BLOCK = 2_048
#: Documents of an item that a shard scores first, to raise the bar for the others.
PROBES = 64

# What parts terms, and only A-Z are lowered.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
# Fixed value: odd multiplier that makes further hashes of an entry from one.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes above ASCII; A-Z in lower case."""
    return text.translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hash of a term, remembered while the memory is small."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[term] = found = xxhash.xxh64_intdigest(term)
        return found


def levels() -> np.ndarray:
    """Occurrences from which a term has a further entry: 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    powers = 2 ** np.arange(1, 40, dtype=np.int64)
    return np.sort(np.concatenate([[1], powers, powers[:-1] + powers[:-1] // 2]))


_LEVELS = levels()


def _slots(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The slices of each hash at a level, one row per hash; ``bits`` is a power of two."""
    with np.errstate(over="ignore"):
        x = (hashes + np.uint64(level + 1) * _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * _MIX
        low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
        steps = np.arange(SLICES, dtype=np.uint64)
        return ((low[:, None] + steps * high[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class _Shard:
    """Documents of one size class that a task gathers to one row."""

    def __init__(self, bits: int) -> None:
        self.bits, self.keys, self.n, self.sets = bits, [], [], []

    def full(self) -> bool:
        return len(self.keys) >= min(SHARD_DOCS, SHARD_BITS // self.bits)

    def row(self) -> dict[str, object]:
        """Slices as bitmaps over the documents, and the terms of each document for exact scores."""
        docs = len(self.keys)
        ends = np.cumsum([0, *(len(h) for h, _ in self.sets)])
        hashes, tf = (np.concatenate([s[k] for s in self.sets]) for k in range(2))
        owner = np.repeat(np.arange(docs), np.diff(ends))
        grid = np.zeros((self.bits, docs), bool)
        for level, least in enumerate(_LEVELS):
            live = np.flatnonzero(tf >= least)
            if not len(live):
                break
            slots = _slots(hashes[live], level, self.bits)
            for k in range(SLICES):
                grid[slots[:, k], owner[live]] = True
        return {
            "bits": self.bits, "keys": self.keys, "n": self.n, "slices": np.packbits(grid, axis=1, bitorder="little").tobytes(),
            "ends": ends[1:], "hashes": hashes.astype("<u8").tobytes(), "tf": tf.astype("<u4").tobytes(),
        }


def index_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Shards of bit-sliced signatures; a document without a term has none.

    A shard is made by one task from its own rows, nothing is shuffled. Its slices have
    ``BITS_PER_ENTRY`` bits or more for each entry of its largest document.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"bits int, keys array<{kind}>, n array<long>, slices binary, ends array<long>, hashes binary, tf binary"
    target = arrow_schema(schema)
    made = _Hashes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Shard] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                words = terms(value)
                if not words:
                    continue
                hashes, tf = np.unique(np.fromiter(map(made.__getitem__, words), np.uint64, len(words)), return_counts=True)
                entries = int(np.searchsorted(_LEVELS, tf, side="right").sum())
                bits = 1 << max(9, int(BITS_PER_ENTRY * entries - 1).bit_length())
                shard = open_.setdefault(bits, _Shard(bits))
                shard.keys.append(name)
                shard.n.append(len(words))
                shard.sets.append((hashes, tf))
                if shard.full():
                    yield pa.RecordBatch.from_pylist([open_.pop(bits).row()], schema=target)
        for shard in open_.values():
            yield pa.RecordBatch.from_pylist([shard.row()], schema=target)

    return docs.select(key, F.col(text).cast("string")).mapInArrow(work, schema)


def _term_counts(shards: DataFrame) -> DataFrame:
    """(term, df) of each shard."""

    def work(batch) -> dict[str, object]:
        found = [np.unique(np.frombuffer(h, "<u8"), return_counts=True) for h in batch["hashes"].to_pylist()]
        return {"term": np.concatenate([f[0] for f in found]).view(np.int64), "df": np.concatenate([f[1] for f in found])}

    return per_batch(shards.select("hashes"), work, "term long, df long")


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term) of every item's distinct terms."""
    kind = items.schema[key].dataType.simpleString()

    def work(batch) -> dict[str, object]:
        found = [sorted({xxhash.xxh64_intdigest(t) for t in terms(value)}) for value in encoded(batch.column(1))]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.array([h for f in found for h in f], np.uint64).view(np.int64)
        return {"item": batch.column(0).take(pa.array(owner)), "term": flat}

    return per_batch(items.select(key, F.col(text).cast("string")), work, f"item {kind}, term long").distinct()


class Query:
    """Items of one pass: their terms with weights, as arrays."""

    def __init__(self, items: list[tuple[object, list[int], list[int]]]) -> None:
        self.items = [item for item, _, _ in items]
        owner = np.repeat(np.arange(len(items)), [len(t) for _, t, _ in items])
        flat = np.array([x for _, t, _ in items for x in t], np.int64).view(np.uint64)
        self.terms, self.place = np.unique(flat, return_inverse=True)
        self.owner, self.weight = owner, np.array([x for _, _, w in items for x in w], np.int64)
        self.ends = np.searchsorted(owner, np.arange(len(items) + 1))
        # a term weighs the same in every item
        self.weights = np.zeros(len(self.terms), np.int64)
        self.weights[self.place] = self.weight
        order = np.argsort(self.place, kind="stable")
        self.holders = np.split(owner[order], np.searchsorted(self.place[order], np.arange(1, len(self.terms))))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Searcher:
    """Searches shard after shard and keeps the best documents of each item."""

    def __init__(self, query: Query, documents: int, length: int, k: int) -> None:
        self.query, self.documents, self.length, self.k = query, documents, length, k
        self.best: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), []) for _ in query.items]
        self.bar = np.ones(len(query.items), np.int64)
        self.scored = self.pairs = 0

    def bounds(self, slices: np.ndarray, bits: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bound of every item's score in every document: weighted sums of the slices that hold its terms."""
        query, docs = self.query, len(n)
        total = np.zeros((len(query.items), docs), np.int64)
        caps = np.append(_LEVELS[1:] - 1, np.iinfo(np.int64).max)
        blocks = np.split(query.terms, range(TERM_BLOCK, len(query.terms), TERM_BLOCK))
        held = np.concatenate([np.bitwise_and.reduce(slices[_slots(block, 0, bits)], axis=1) for block in blocks])
        for t in np.flatnonzero(held.any(axis=1) & (query.weights > 0)).tolist():
            there = np.flatnonzero(np.unpackbits(held[t], count=docs, bitorder="little"))
            most, level, live = np.empty(len(there), np.int64), 0, held[t]
            at = np.arange(len(there))
            while True:
                most[at] = np.minimum(caps[level], n[there[at]])
                level += 1
                if level == len(_LEVELS):
                    break
                live = live & np.bitwise_and.reduce(slices[_slots(query.terms[t : t + 1], level, bits)[0]], axis=0)
                at = np.flatnonzero(np.unpackbits(live, count=docs, bitorder="little")[there])
                if not len(at):
                    break
            total[query.holders[t][:, None], there] += query.weights[t] * impact(most, m[there])
        return total

    def scores(self, item: np.ndarray, doc: np.ndarray, shard: dict, m: np.ndarray) -> np.ndarray:
        """Exact scores of the pairs, from the documents' own terms."""
        query, out = self.query, np.zeros(len(item), np.int64)
        hashes, tf, ends = shard["hashes"], shard["tf"], shard["ends"]
        order = np.argsort(doc, kind="stable")
        for pairs in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            d = doc[pairs[0]]
            own, times = hashes[ends[d] : ends[d + 1]], tf[ends[d] : ends[d + 1]]
            sizes = query.ends[item[pairs] + 1] - query.ends[item[pairs]]
            flat = np.arange(sizes.sum()) + np.repeat(query.ends[item[pairs]] - np.cumsum(sizes) + sizes, sizes)
            wanted = query.terms[query.place[flat]]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            part = np.where(own[at] == wanted, query.weight[flat] * impact(times[at], m[d]), 0)
            edges = np.concatenate([[0], np.cumsum(part)])
            stops = np.cumsum(sizes)
            out[pairs] = edges[stops] - edges[stops - sizes]
        self.scored += len(item)
        return out

    def add(self, row: dict) -> None:
        docs = len(row["keys"])
        n = np.array(row["n"], np.int64)
        m = 50 + 50 * n * self.documents // self.length
        shard = {
            "hashes": np.frombuffer(row["hashes"], "<u8"), "tf": np.frombuffer(row["tf"], "<u4").astype(np.int64),
            "ends": np.concatenate([[0], row["ends"]]).astype(np.int64),
        }
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)
        bound = self.bounds(slices, row["bits"], n, m)
        self.pairs += bound.size
        # the most promising documents raise the bar, all others that can reach it follow
        if docs > PROBES:
            first = np.argpartition(bound, docs - PROBES, axis=1)[:, -PROBES:]
            probe = np.zeros(bound.shape, bool)
            np.put_along_axis(probe, first, True, axis=1)
        else:
            probe = np.ones(bound.shape, bool)
        for chosen in (probe, ~probe):
            item, doc = np.nonzero(chosen & (bound >= self.bar[:, None]))
            if len(item):
                self._keep(item, doc, self.scores(item, doc, shard, m), row["keys"])

    def _keep(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, keys: list) -> None:
        edges = np.searchsorted(item, np.arange(len(self.query.items) + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[i], edges[i + 1]
            live = np.flatnonzero(score[a:b] >= self.bar[i]) + a
            if not len(live):
                continue
            old, names = self.best[i]
            value, names = np.concatenate([old, score[live]]), names + [keys[d] for d in doc[live].tolist()]
            if len(value) > self.k:
                # null keys come last among equals
                order = sorted(range(len(value)), key=lambda x: (-value[x], names[x] is None, names[x]))[: self.k]
                value, names = value[order], [names[x] for x in order]
                self.bar[i] = value[-1]
            self.best[i] = value, names

    def found(self) -> Iterator[tuple[object, object, int]]:
        for item, (scores, names) in zip(self.query.items, self.best):
            for score, name in zip(scores.tolist(), names):
                yield item, name, score


def rank_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 50,
) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score (named after the key columns).

    Signatures hold an entry per term and level of its count, bit by bit across the documents
    of a shard, so the slices of an item's terms bound its score in all documents at once, from
    above. Documents whose bound does not reach the ``k``-th score found so far are excluded;
    all others are scored exactly. Items are searched in passes of about ``PASS_TERMS``
    terms over the written shards. Terms are compared by 64-bit hashes.

    Null and empty texts have no term. Equal scores go by ascending key, a null key last;
    repeated documents are a document each. Rows that share an item key are one item with the
    terms of all, a null key is an item too. Other columns are not read.
    """
    shards, _ = written(index_documents(docs, key, text))
    documents, length = shards.agg(F.sum(F.size("keys")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    names = {"item": item_key, "key": key}
    schema = f"item {item_kind}, key {kind}, score long"
    found = docs.sparkSession.createDataFrame([], schema)
    if not documents:
        return _best(found, k, names)
    asked = cut(_item_terms(items, item_key, item_text))
    # only counts of terms that an item asks for are gathered
    counts = _term_counts(shards).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    weighed = asked.join(counts.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")), "term")
    total = asked.count()
    passes = max(1, -(-total // PASS_TERMS))
    queries = cut(weighed.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"), F.pmod(F.xxhash64("item"), F.lit(passes)).alias("turn")))
    target = arrow_schema(schema)
    for turn in range(passes):
        # bounded: the terms of one pass
        own = [(r.item, [t.term for t in r.terms], [t.w for t in r.terms]) for r in queries.filter(F.col("turn") == turn).toLocalIterator()]
        if not own:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(Query(shared.value), documents, length, k)
            for batch in batches:
                for at in range(batch.num_rows):
                    searcher.add(batch.slice(at, 1).to_pylist()[0])
            rows = list(searcher.found())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        found = found.unionByName(shards.mapInArrow(work, schema))
    return _best(found, k, names)


def _best(found: DataFrame, k: int, names: dict[str, str]) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item", "rank", "key", "score").withColumnsRenamed(names)
