"""SimHash near-duplicates with deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta.llm.common import encoded, per_batch, roots
from sheetdelta.llm.graph import components
from sheetdelta.session import cut

#: Fingerprints of one signature that a task compares at once; larger signatures are dealt to blocks.
BLOCK = 512
#: The same for half segments, whose wildcards are set within the task.
HALF_BLOCK = 32_768
#: Pairs that a task compares at once.
PAIRS = 1 << 20
#: Texts of one candidate group that a task compares at once; larger groups are dealt to blocks.
GROUP_BLOCK = 128
#: Lanes that the distance is measured on; further ones only add segments.
MEASURED = 4


# Fixed value: odd multiplier that makes further lanes of a fingerprint from one hash.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int, lanes: int = 1) -> list[int]:
    """Majority bits of the hashes of all shingles of ``words`` words, repeats included; 64 per lane."""
    return _lanes(_shingles(text, words), lanes)


def _shingles(text: bytes, words: int) -> np.ndarray:
    """Hash of every shingle, in text order; a shorter text is one shingle, one without a word has none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    last = max(1, len(parts) - words + 1)
    stop = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last], stop)), np.uint64, last)


def _lanes(hashes: np.ndarray, lanes: int) -> list[int]:
    if not len(hashes):
        return [0] * lanes
    out = []
    for _ in range(lanes):
        out.append(_majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return out


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def lane_names(lanes: int) -> list[str]:
    return [f"lane{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """(key, lane0, ...) of every row; a lane is the signed long with the same 64 bits."""
    names = lane_names(lanes)

    def work(batch) -> dict[str, object]:
        found = np.array([fingerprint(t, words, lanes) for t in encoded(batch.column(1))], np.uint64).view(np.int64)
        return {"key": batch.column(0)} | {n: pa.array(found[:, k]) for k, n in enumerate(names)}

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{n} long" for n in names)])
    return per_batch(docs.select(key, F.col(text).cast("string")), work, schema).withColumnRenamed("key", key)


def _segments(lanes: int, per_lane: int) -> list[tuple[str, int, int, int]]:
    """(lane, number of its first signature, lowest bit, width) of each segment."""
    edges, out, slot = [64 * k // per_lane for k in range(per_lane + 1)], [], 0
    for lane in lane_names(lanes):
        for low, high in zip(edges, edges[1:]):
            out.append((lane, slot, low, high - low))
            slot += high - low + 1
    return out


def _whole(fp: Column, slot: int, low: int, width: int) -> Column:
    """Signature of a whole segment; those of its wildcards follow it in the upper bits."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(slot << 32)


def _variants(whole: Column, width: int) -> Column:
    """Array of (sig, side) of a whole segment and of its one-wildcard variants.

    ``side`` is the bit under the wildcard, 2 for a whole segment. Segments that differ
    in exactly that bit meet under the wildcard with sides 0 and 1; equal segments meet
    whole. So a pair that shares a segment up to one bit meets once for that segment.
    """
    left, right = (lambda c, by, f=f: F.call_function(f, c, by) for f in ("shiftleft", "shiftright"))

    def wildcard(bit: Column) -> Column:
        free = whole.bitwiseAND(F.bitwise_not(left(F.lit(1).cast("long"), bit)))
        sig = free + left((bit + 1).cast("long"), F.lit(32))
        return F.struct(sig.alias("sig"), right(whole, bit).bitwiseAND(F.lit(1)).cast("byte").alias("side"))

    itself = F.array(F.struct(whole.alias("sig"), F.lit(2).cast("byte").alias("side")))
    return F.concat(itself, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), wildcard))


def _signatures(fps: DataFrame, segments: list[tuple[str, int, int, int]]) -> DataFrame:
    """(sig, side) beside the columns of ``fps``, for every segment and wildcard."""
    parts = [_variants(_whole(F.col(lane), slot, low, width), width) for lane, slot, low, width in segments]
    return fps.select("*", F.explode(F.concat(*parts)).alias("s")).select("s.sig", "s.side", *fps.columns)


def _large_signatures(fps: DataFrame, segments: list[tuple[str, int, int, int]], block: int) -> DataFrame:
    """(sig, blocks) of every signature that may have more than ``block`` members.

    A wildcard joins two values of its segment, so it is large only if one of them has
    more than half a block; counting whole segments is enough.
    """
    found = None
    for lane, slot, low, width in segments:
        heavy = fps.groupBy(_whole(F.col(lane), slot, low, width).alias("whole")).agg(F.count("*").alias("n"))
        heavy = heavy.filter(F.col("n") > block // 2)
        sigs = heavy.select("n", F.explode(_variants(F.col("whole"), width)).alias("s")).select("s.sig", "n")
        found = sigs if found is None else found.unionByName(sigs)
    sizes = found.groupBy("sig").agg(F.sum("n").alias("n"))
    return cut(sizes.select("sig", F.ceil((F.col("n") + block // 2) / block).cast("int").alias("blocks")))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the lanes."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int16)


def _dealt(signatures: DataFrame, large: DataFrame) -> DataFrame:
    """Signatures with the cell that compares their members.

    A signature of usual size is one cell. A large one is cut by a hash of the fingerprint
    into blocks, and each member goes to the cells that pair its block with every block,
    so that no task ever holds a whole large signature.
    """
    dealt = signatures.join(large, "sig", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.lit(0)))
    cells = F.transform(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
        lambda other: F.least("own", other).cast("long") * (1 << 31) + F.greatest("own", other).cast("long"),
    )
    return dealt.select("sig", F.explode(cells).alias("cell"), "own", *(c for c in signatures.columns if c != "sig"))


def link_signatures(fps: DataFrame, bits: int, lanes: int, per_lane: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect fingerprints that differ by at most ``bits`` bits and share a signature.

    ``fps`` holds distinct fingerprints, an ``id`` (long) and their lanes. With more segments than
    half the bits, one of them differs by at most one bit, so every such pair shares a
    signature. Within each cell all pairs are verified; a connected set of a cell is
    returned as links to its smallest member, one row per fingerprint and cell at most, so
    dense groups cost rows in proportion to their size.
    """
    segments, names = _segments(lanes, per_lane), lane_names(lanes)
    cells = _dealt(_signatures(fps, segments), _large_signatures(fps, segments, block))
    cells = cells.repartition("sig", "cell").sortWithinPartitions("sig", "cell")

    def linked(own: np.ndarray, side: np.ndarray, fp: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
        first = side == 0 if side[0] != 2 else np.ones(len(fp), bool)
        second = side == 1 if side[0] != 2 else first
        low = own == own.min()
        found = []
        for mine, theirs in ((first, second),) if diagonal else ((first & low, second & ~low), (first & ~low, second & low)):
            rows, columns = np.flatnonzero(mine), np.flatnonzero(theirs)
            i, j = np.nonzero(_distances(fp[rows][:, None], fp[columns][None, :]) <= bits)
            found.append((rows[i], columns[j]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            sig, cell = now["sig"].to_numpy(), now["cell"].to_numpy()
            edges = np.flatnonzero((np.diff(sig) != 0) | (np.diff(cell) != 0)) + 1
            if len(edges):
                yield work(now.slice(0, edges[-1]), np.concatenate([[0], edges]))
                now = now.slice(edges[-1])
            rest = now
        if rest is not None:
            yield work(rest, np.array([0, rest.num_rows]))

    def work(part: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        """Cells of two rows are compared all at once, larger ones each on its own."""
        own, side, ids, cell = (part[n].to_numpy() for n in ("own", "side", "id", "cell"))
        fp = np.stack([part[n].to_numpy() for n in names], axis=1).view(np.uint64)
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        close = two[_distances(fp[two], fp[two + 1]) <= bits]
        out = [(ids[close], ids[close + 1])]
        for a, b in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist()):
            i, j = linked(own[a:b], side[a:b], fp[a:b], cell[a] >> 31 == cell[a] & 0x7FFFFFFF)
            if len(i):
                root = roots(i, j, b - a)
                moved = np.flatnonzero(root != np.arange(b - a))
                out.append((ids[a:b][moved], ids[a:b][root[moved]]))
        left, right = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return cells.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, lanes: int = 1,
    per_lane: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Fingerprint and component of every row: key, lane0 (and further lanes), component_id.

    Equal fingerprints are folded first, so copies cost one fingerprint. ``per_lane``
    segments of each lane are indexed; by default so many that no pair within ``bits`` is
    missed. The component is the smallest key reachable. Null and empty texts have
    fingerprint zero and link like any other; rows with a null key join the component of
    their fingerprint and offer it no name; repeated rows keep a row each. Other columns
    are not read.
    """
    names = lane_names(lanes)
    per_lane = per_lane or -(-(bits // 2 + 1) // lanes)
    prints = cut(fingerprints(docs, key, text, words, lanes))
    own = F.col("lane0") if lanes == 1 else F.xxhash64(*names)
    folded = cut(prints.groupBy(*names).agg(F.min(key).alias("first")).withColumn("id", own))
    joined = components(link_signatures(folded.select("id", *names), bits, lanes, per_lane, block))
    classes = folded.join(joined, folded.id == joined.node, "left").select(*names, "first", F.coalesce("root", "id").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    members = classes.join(named, "root").select(*names, "component_id")
    return prints.join(members, names).select(key, *names, "component_id")


def bits_within(similarity: float, width: int) -> int:
    """Bits by which nearly all fingerprints of at least a Jaccard similarity differ at most.

    A bit differs with the angle between the shingle vectors over pi; sets with similarity j
    have at least the cosine 2j / (1 + j). Four deviations are added to the expected number.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(width * apart + 4 * math.sqrt(width * apart * (1 - apart)))


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, lanes: int) -> DataFrame:
    """(key, id, lane0, ...) of every row: digest and fingerprint of its distinct shingles."""
    names = lane_names(lanes)

    def work(batch) -> dict[str, object]:
        sets = [np.unique(_shingles(t, words)) for t in encoded(batch.column(1))]
        found = np.array([_lanes(s, lanes) for s in sets], np.uint64).view(np.int64)
        return {"key": batch.column(0), "id": _digests(sets)} | {n: pa.array(found[:, k]) for k, n in enumerate(names)}

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}, id long", *(f"{n} long" for n in names)])
    return per_batch(docs.select(key, F.col(text).cast("string")), work, schema)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _halves(segments: list[tuple[str, int, int, int]]) -> Column:
    """Array of (sig, side): each half of a segment names a bucket, the other half is its ``side``.

    Segments that differ in at most one bit agree in one of their halves.
    """
    out = []
    for n, (lane, _, low, width) in enumerate(segments):
        half = width // 2
        upper = F.shiftrightunsigned(lane, low + half).bitwiseAND(F.lit((1 << (width - half)) - 1))
        lower = F.shiftrightunsigned(lane, low).bitwiseAND(F.lit((1 << half) - 1))
        for k, (bucket, rest) in enumerate(((upper, lower), (lower, upper))):
            out.append(F.struct((bucket + F.lit(2 * n + k << 32)).alias("sig"), rest.cast("int").alias("side")))
    return F.array(*out)


def _met(values: np.ndarray, free: int, equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in the distinct sorted ``values`` that differ in one of ``free`` bits, or in none."""
    at = np.arange(len(values))
    left, right = ([at], [at]) if equal else ([], [])
    for bit in range(free):
        zero = at[values >> bit & 1 == 0]
        other = np.searchsorted(values, values[zero] | 1 << bit)
        there = np.minimum(other, len(values) - 1)
        same = values[there] == values[zero] | 1 << bit
        left.append(zero[same])
        right.append(there[same])
    return np.concatenate(left), np.concatenate(right)


def _products(starts: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of the pairs of runs, about ``PAIRS`` at once."""
    sizes = counts[left] * counts[right]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, int(edges[-1]), PAIRS):
        at = np.arange(low, min(low + PAIRS, int(edges[-1])))
        run = np.searchsorted(edges, at, side="right") - 1
        a, b, within = left[run], right[run], at - edges[run]
        i, j = starts[a] + within // counts[b], starts[b] + within % counts[b]
        once = (a != b) | (i < j)
        yield i[once], j[once]


def link_groups(rows: DataFrame, block: int, compare: Callable[[pa.Table, np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): links that connect the members of each group as far as ``compare`` connects them.

    ``rows`` holds ``grp`` and ``id`` (long) beside what is compared. A task compares ``block``
    members at most, or two blocks of that size. First each block is connected on its own
    and every member is named by the smallest id it reaches; then one member per name meets
    those of other blocks, until no names fall together. A group of copies has one name by
    then. Only where names are left, members of different names are compared across blocks;
    blocks of one name never meet. So links are in proportion to members, and groups of
    copies cost no pairs of blocks.

    ``compare`` gets a table, the side of each row (None: all pairs count, else pairs of
    different sides) and the place of the first row with its name; it returns the place of
    the smallest row that each row reaches, or a row of the same set.
    """

    def joined(part: pa.Table, side: np.ndarray | None) -> pa.Table:
        ids, names = part["id"].to_numpy(), part["name"].to_numpy()
        _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        root = compare(part, side, first[inverse])
        # a name is one node; each connected set of names takes its smallest
        low = np.unique(names)
        left, right = inverse, inverse[root]
        found = roots(left, right, len(low))
        moved = np.flatnonzero(found != np.arange(len(low)))
        return pa.table({
            "grp": pa.array(np.full(len(moved), part["grp"][0].as_py()), pa.int64()),
            "a": pa.array(low[moved], pa.int64()), "b": pa.array(low[found[moved]], pa.int64()),
        })

    def within(part: pa.Table) -> pa.Table:
        return joined(part, None)

    def across(part: pa.Table) -> pa.Table:
        own, cell = part["own"].to_numpy(), part["cell"][0].as_py()
        return joined(part, own if cell >> 31 != cell & 0x7FFFFFFF else None)

    schema = "grp long, a long, b long"
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = cut(sizes.select("grp", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = rows.join(large, "grp", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.lit(0)))
    first = cut(dealt.drop("blocks").withColumn("name", F.col("id")).groupBy("grp", "own").applyInArrow(within, schema))
    links = first.select("a", "b")
    if large.isEmpty():
        return links
    members = cut(rows.join(large.select("grp"), "grp"))
    renamed = first.select("grp", F.col("a").alias("name"), F.col("b").alias("to"))
    names = members.select("grp", "id", F.col("id").alias("name"))
    while True:
        names = cut(names.join(renamed, ["grp", "name"], "left").select("grp", "id", F.coalesce("to", "name").alias("name")))
        each = names.select("grp", "name").distinct()
        several = cut(each.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"))
        if several.isEmpty():
            return links.unionByName(names.filter("id > name").select(F.col("id").alias("a"), F.col("name").alias("b")))
        blocks = F.ceil(F.col("n") / block)
        heads = each.join(several, "grp").select("grp", F.col("name").alias("id"), F.pmod(F.xxhash64("name"), blocks).alias("own"))
        met = members.join(heads, ["grp", "id"]).withColumn("name", F.col("id"))
        moved = cut(met.groupBy("grp", "own").applyInArrow(within, schema))
        # once few names fall together, the rest is left to the cells
        if moved.count() * 10 < several.agg(F.sum("n")).first()[0]:
            names = names.join(moved.select("grp", F.col("a").alias("name"), F.col("b").alias("to")), ["grp", "name"], "left")
            names = cut(names.select("grp", "id", F.coalesce("to", "name").alias("name")))
            break
        renamed = moved.select("grp", F.col("a").alias("name"), F.col("b").alias("to"))
    links = links.unionByName(names.filter("id > name").select(F.col("id").alias("a"), F.col("name").alias("b")))
    cells = _cells(members.join(names.join(several.select("grp"), "grp"), ["grp", "id"]), block)
    return links.unionByName(cells.groupBy("grp", "cell").applyInArrow(across, schema).select("a", "b"))


def _cells(named: DataFrame, block: int) -> DataFrame:
    """Members with the cells of two blocks that compare them.

    A name with more than ``block`` members has blocks of its own, which do not meet each other;
    the other members share blocks, which also meet themselves.
    """
    sizes = named.groupBy("grp", "name").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("pool", F.when(F.col("n") > block, F.col("name")))
    pools = sizes.groupBy("grp", "pool").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    order = Window.partitionBy("grp").orderBy("pool")
    pools = pools.withColumn("stop", F.sum("blocks").over(order).cast("int"))
    pools = pools.join(pools.groupBy("grp").agg(F.max("stop").alias("all")), "grp")
    theirs = pools.select(F.col("grp").alias("_grp"), F.col("pool").alias("_pool"), "blocks", "stop", "all")
    placed = cut(sizes.select("grp", "name", "pool").join(
        theirs, (F.col("grp") == F.col("_grp")) & F.col("pool").eqNullSafe(F.col("_pool"))).drop("_grp", "_pool"))
    dealt = named.join(placed, ["grp", "name"]).withColumn("low", F.col("stop") - F.col("blocks"))
    dealt = dealt.withColumn("own", (F.col("low") + F.pmod(F.xxhash64("id"), "blocks")).cast("int"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda other: F.col("pool").isNull() | (other < F.col("low")) | (other >= F.col("stop")),
    )
    cell = F.explode(F.transform(others, lambda other: F.least("own", other).cast("long") * (1 << 31) + F.greatest("own", other).cast("long")))
    return dealt.withColumn("cell", cell).drop("pool", "blocks", "stop", "all", "low")


def link_halves(fps: DataFrame, bits: int, lanes: int, per_lane: int, block: int = HALF_BLOCK) -> DataFrame:
    """(a, b): links that connect fingerprints within ``bits`` that have a segment within one bit.

    The same pairs as ``link_signatures`` compares, dealt by half segments: two rows per segment
    are shuffled, and the wildcards of the other half are set within the task. That allows
    many segments. The distance is that of the first ``MEASURED`` lanes.
    """
    segments, names = _segments(lanes, per_lane), lane_names(min(lanes, MEASURED))
    widths = [width for _, _, _, width in segments]
    halves = fps.select("id", *names, F.explode(_halves(segments)).alias("s")).select(F.col("s.sig").alias("grp"), "s.side", "id", *names)

    def compare(part: pa.Table, block_of: np.ndarray | None, _: np.ndarray) -> np.ndarray:
        slot = part["grp"][0].as_py() >> 32
        width, upper = widths[slot // 2], slot % 2 == 0
        order = np.argsort(part["side"].to_numpy(), kind="stable")
        side = part["side"].to_numpy()[order]
        fp = np.stack([part[n].to_numpy()[order] for n in names], axis=1).view(np.uint64)
        values, starts, counts = np.unique(side, return_index=True, return_counts=True)
        # equal segments meet in the bucket of their upper half only
        runs = _met(values, width // 2 if upper else width - width // 2, upper)
        left = right = np.zeros(0, np.int64)
        for i, j in _products(starts, counts, *runs):
            if block_of is not None:
                live = block_of[order[i]] != block_of[order[j]]
                i, j = i[live], j[live]
            close = _distances(fp[i], fp[j]) <= bits
            left, right = np.concatenate([left, i[close]]), np.concatenate([right, j[close]])
            if len(left) > PAIRS:
                right = roots(left, right, len(side))
                left = np.flatnonzero(right != np.arange(len(side)))
                right = right[left]
        root = np.empty(len(side), np.int64)
        root[order] = order[roots(left, right, len(side))]
        return root

    return link_groups(halves, block, compare).distinct()


def similar_sets(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """A member of each component of the sets whose exact Jaccard similarity is at least ``similarity``, for every set.

    With ``side``, only members of different sides are compared. Members with one ``label``, and those
    that are connected already, are not compared. Without labels the smallest member is returned.
    """
    n, label = len(sets), np.arange(len(sets)) if label is None else label.copy()
    sizes = np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    values, found = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    for k in range(n):
        open_ = (label != label[k]) & (np.minimum(sizes, sizes[k]) >= similarity * np.maximum(sizes, sizes[k]) - 1e-6)
        if side is not None:
            open_ &= side != side[k]
        if not open_.any():
            continue
        own = found[edges[k] : edges[k + 1]]
        mark[own] = True
        common = np.diff(np.concatenate([[0], np.cumsum(mark[found])])[edges])
        mark[own] = False
        near = np.flatnonzero(open_ & (common / np.maximum(1, sizes + sizes[k] - common) >= similarity))
        if len(near):
            joined = np.unique(label[np.append(near, k)])
            label[np.isin(label, joined)] = joined[0]
    return label


def _verified(
    keyed: DataFrame, folded: DataFrame, near: DataFrame, key: str, text: str, words: int, similarity: float, block: int,
) -> DataFrame:
    """(a, b): links that connect the shingle sets of each candidate group that are similar enough.

    ``near`` holds (node, root) of the candidate groups. All pairs of a group that are not
    connected otherwise are compared exactly.
    """
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    wanted = folded.join(members, folded.id == members.node).select("id", "root", F.col("first").alias("_first"))
    texts = keyed.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    chosen = wanted.join(texts, wanted["_first"] == texts["_key"]).select("id", "root", "_text")

    def work(batch) -> dict[str, object]:
        sets = [np.unique(_shingles(t, words)) for t in encoded(batch.column(2))]
        # rows that share the key may have other texts
        own = _digests(sets) == batch.column(0).to_numpy()
        return {
            "id": batch.column(0), "grp": batch.column(1), "own": own, "shingles": [s.astype("<u8").tobytes() for s in sets],
        }

    sets = per_batch(chosen, work, "id long, grp long, own boolean, shingles binary").filter("own").drop("own").dropDuplicates(["id"])

    def compare(part: pa.Table, side: np.ndarray | None, label: np.ndarray) -> np.ndarray:
        return similar_sets([np.frombuffer(s, "<u8") for s in part["shingles"].to_pylist()], similarity, side, label)

    return link_groups(cut(sets), block, compare)


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 6, per_lane: int = 4,
    block: int = HALF_BLOCK, group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the row of its smallest key.

    Near copies have a Jaccard similarity of at least ``similarity`` between their distinct
    shingles; groups are connected by such pairs. Fingerprints of the distinct shingles are
    compared where one of ``lanes`` x ``per_lane`` segments differs by at most one bit; those within
    the bits that nearly all pairs of ``similarity`` keep to make candidate groups, whose pairs
    are all verified exactly. With 24 segments of 16 bits, the index misses 0.04 % of the pairs at 0.8
    exactly and fewer above it, if bits are independent. Texts without a word are copies of each
    other. Rows with a null key are kept, as nothing names their copy; repeated rows with the
    key that stays remain.
    """
    keyed = docs.filter(F.col(key).isNotNull())
    prints = cut(shingle_sets(keyed, key, text, words, lanes))
    folded = cut(prints.groupBy("id", *lane_names(lanes)).agg(F.min("key").alias("first")))
    near = components(link_halves(folded, bits_within(similarity, 64 * min(lanes, MEASURED)), lanes, per_lane, block))
    same = components(_verified(keyed, folded, near, key, text, words, similarity, group_block))
    classes = folded.join(same, folded.id == same.node, "left").groupBy(F.coalesce("root", "id").alias("root"))
    kept = classes.agg(F.min("first").alias("_kept")).select("_kept").distinct()
    return docs.join(kept, docs[key] == kept["_kept"], "left").filter(
        F.col("_kept").isNotNull() | F.col(key).isNull()
    ).drop("_kept")
