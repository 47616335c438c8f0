"""Byte-level BPE with forced boundaries."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.llm.common import per_batch

# The split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Token ids fit in so many bits; pairs of ids and (rank, id) are kept as one number.
_BITS = 24
_NONE = 1 << 62
#: Bytes of the longest fragment that is merged side by side with others.
SIDE_BY_SIDE = 40
#: Characters of the texts that are encoded together, about.
TOGETHER = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and the byte pairs that no token holds."""

    def __init__(self, spec: dict) -> None:
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = ((self.ids[as_bytes(a)], self.ids[as_bytes(b)], self.ids[as_bytes(a + b)]) for a, b in merges)
        self.merges = {a << _BITS | b: rank << _BITS | made for rank, (a, b, made) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.single = [self.ids.get(bytes([b])) for b in range(256)]
        self.tokens = {i: token for token, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        self.cut_table, self.cut_after = ~inside, (~inside).tobytes()
        self.single_table = np.array([-1 if i is None else i for i in self.single], np.int64)
        self.keys = np.sort(np.fromiter(self.merges, np.int64, len(self.merges)))
        self.values = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        self._encoder: Encoder | None = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and made id of every pair, as one number; ``_NONE`` where none merges it."""
        wanted = left.astype(np.int64) << _BITS | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)

    def encoder(self) -> Encoder:
        """One encoder for all tasks of a Python worker."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """Reads a tokenizer file, by Spark where the path has a scheme."""
    if "://" in path:
        rows = spark.read.text(path, wholetext=True).collect()  # one file of a vocabulary
        return Vocabulary(json.loads(rows[0].value))
    with open(path, encoding="utf-8") as lines:
        return Vocabulary(json.load(lines))


class Memory:
    """Ids of pieces. When ``most`` are held they become the older half, which goes with the next change."""

    def __init__(self, most: int) -> None:
        self.most, self.recent, self.older = most, {}, {}

    def known(self, pieces: set[str]) -> dict[str, bytes]:
        recent, older = self.recent, self.older
        return {p: found for p in pieces if (found := recent.get(p) or older.get(p)) is not None}

    def keep(self, found: dict[str, bytes]) -> None:
        self.recent.update((p, ids) for p, ids in found.items() if len(p) <= 32)
        if len(self.recent) > self.most:
            self.older, self.recent = self.recent, {}


class Encoder:
    """Encodes and decodes with one vocabulary; ids are packed as little-endian 32-bit integers.

    Texts are encoded some at a time: all pieces among them that are not remembered are
    cut between byte pairs that no token holds, and the fragments are merged side by side.
    """

    def __init__(self, vocabulary: Vocabulary, kept: int = 200_000) -> None:
        self.v = vocabulary
        self.memory = Memory(kept)
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def split(self, piece: bytes) -> list[bytes]:
        """Fragments between byte pairs that no token holds: no token can span such a pair."""
        cut = self.v.cut_after
        cuts = [at for at, (a, b) in enumerate(zip(piece, piece[1:]), 1) if cut[a << 8 | b]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of every piece."""
        raw = [part.encode() for part in parts]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        last = self.v.cut_table[flat[:-1], flat[1:]]
        last = np.append(last, True)
        last[ends - 1] = True
        stops = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], stops[:-1]])
        ids = np.full(len(flat), -1, np.int32)
        lengths = stops - starts
        for length in np.unique(lengths).tolist():
            at = starts[lengths == length]
            if length <= SIDE_BY_SIDE:
                cells = at[:, None] + np.arange(length)
                self.merge_many(flat[cells], cells, ids)
            else:
                for a in at.tolist():
                    found = self.merge(flat[a : a + length].tobytes())
                    ids[a : a + len(found)] = found
        made = ids >= 0
        stops = np.cumsum(made)[ends - 1] * 4
        packed = ids[made].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def merge_many(self, raw: np.ndarray, cells: np.ndarray, out: np.ndarray) -> None:
        """Merges fragments of one length, a row each, and writes the ids to the first ``cells`` of each row.

        Every round applies the lowest-ranked merge of each row, leftmost first; rows without one are done.
        """
        ids = self.v.single_table[raw]
        pairs = self.v.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = pairs.argmin(axis=1)
            rows = np.arange(len(ids))
            best = pairs[rows, at]
            live = best != _NONE
            if not live.all():
                out[cells[~live, : ids.shape[1]]] = ids[~live]
                ids, pairs, cells, at, best = ids[live], pairs[live], cells[live], at[live], best[live]
                rows = np.arange(len(ids))
            if not len(ids):
                return
            made = best & (1 << _BITS) - 1
            width = ids.shape[1] - 1
            after = np.arange(width) + (np.arange(width) > at[:, None])
            ids = np.take_along_axis(ids, after, axis=1)
            ids[rows, at] = made
            pairs = np.take_along_axis(pairs, after[:, : width - 1], axis=1) if width > 1 else pairs[:, :0]
            if width > 1:
                # the pair that starts at the new token and the one that ends there
                right = np.flatnonzero(at < width - 1)
                pairs[right, at[right]] = self.v.ranks(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                pairs[left, at[left] - 1] = self.v.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        out[cells[:, 0]] = ids[:, 0]

    def merge(self, fragment: bytes) -> list[int]:
        """Applies the lowest-ranked merge, leftmost first, until none is left."""
        if len(fragment) > 64:
            return self.merge_long(fragment)
        rank = self.v.merges.get
        ids = [self.v.single[b] for b in fragment]
        pairs = [rank(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            at = pairs.index(best)
            ids[at] = made = best & (1 << _BITS) - 1
            del ids[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rank(ids[at - 1] << _BITS | made, _NONE)
            if at < len(pairs):
                pairs[at] = rank(made << _BITS | ids[at + 1], _NONE)
        return ids

    def merge_long(self, raw: bytes) -> list[int]:
        """The same result for long fragments, with a heap over a linked list."""
        ids: list[int] = [self.v.single[b] for b in raw]
        rank, n = self.v.merges.get, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [a << _BITS | b for a, b in zip(ids, ids[1:])]
        heap = [(found, at, pair) for at, pair in enumerate(pairs) if (found := rank(pair)) is not None]
        heapify(heap)
        while heap:
            best, at, pair = heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= n or ids[at] << _BITS | ids[right] != pair:
                continue
            ids[at], ids[right] = best & (1 << _BITS) - 1, -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left, middle in ((before[at], at), (at, after[at])):
                if left >= 0 and middle < n:
                    pair = ids[left] << _BITS | ids[middle]
                    if (new := rank(pair)) is not None:
                        heappush(heap, (new, left, pair))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [self.special.split(text) if self.special and self.special.search(text) else [text] for text in texts]
        # special tokens stand at the odd places
        lists = [[self.find(part) if k % 2 == 0 else part for k, part in enumerate(parts)] for parts in split]
        wanted = set(chain.from_iterable(x for parts in lists for x in parts[::2]))
        found = self.memory.known(wanted)
        missing = [p for p in wanted if p not in found]
        if missing:
            found.update(zip(missing, self.pieces(missing)))
        self.memory.keep(found)
        ids = found.__getitem__
        special = lambda token: array("I", [self.v.special[token]]).tobytes()
        return [b"".join(special(x) if isinstance(x, str) else b"".join(map(ids, x)) for x in parts) for parts in lists]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text and the text decoded from them: key, ids, decoded.

    Null texts count as empty and have no ids. Special tokens of the vocabulary keep their
    id where their characters occur. Repeated rows and null keys keep a row each; other
    columns are not read. The vocabulary is broadcast; its size is fixed by its file.
    """

    def shown(ids: list[bytes], decoded: list[str]) -> dict[str, object]:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
        return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "decoded": decoded}

    return _encoded(docs, tokenizer, key, text, shown, "ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count and digests of what ``encode_documents`` returns, made where the ids are, so neither ids nor texts are moved."""

    def shown(ids: list[bytes], decoded: list[str]) -> dict[str, object]:
        return {
            "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [sha256(x.encode()).hexdigest() for x in decoded],
        }

    return _encoded(docs, tokenizer, key, text, shown, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(
    docs: DataFrame, tokenizer: str, key: str, text: str, shown: Callable[[list[bytes], list[str]], dict[str, object]], columns: str,
) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, tokenizer))

    def work(batch) -> dict[str, object]:
        encoder = shared.value.encoder()
        ids = encoder.encode([value or "" for value in batch.column(1).to_pylist()])
        return {"key": batch.column(0)} | shown(ids, list(map(encoder.decode, ids)))

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(docs.select(key, F.col(text).cast("string")), work, f"key {kind}, {columns}").withColumnRenamed("key", key)
