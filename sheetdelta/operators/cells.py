"""Raster operators on packed cells.

A row of the packed form holds 64 neighbouring cells of one raster row as the
bits of a long: cell ``x`` is bit ``x & 63`` of word ``wx = x >> 6``. Set
algebra, tolerance tests, stencils and counts become bitwise expressions and
``bit_or`` aggregations, so a shuffle moves one row per 64 cells and its key
(sheet, y, wx) spreads one huge sheet over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.session import cut
from sheetdelta.functions.geometry import px_to_mm2

KEYS = ("doc_pair", "seq")


def _zero() -> Column:
    return F.lit(0).cast("long")


def _all_ones() -> Column:
    return F.lit(-1).cast("long")


def shift(bits: Column, by: int) -> Column:
    """Moves cells ``by`` places to larger x inside one word; what leaves it is lost."""
    if by == 0:
        return bits
    if abs(by) > 63:
        return _zero()
    return F.shiftleft(bits, by) if by > 0 else F.shiftrightunsigned(bits, -by)


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns)


def all_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), columns)


def without(bits: Column, other: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(other))


def pack(cells: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[str] = ("rev",)) -> DataFrame:
    """Cells (x, y) to words (y, wx, bits)."""
    return (
        cells.select(
            *keys, *extra, F.col("y").cast("long").alias("y"),
            F.expr("shiftright(cast(x as bigint), 6)").alias("wx"),
            F.expr("shiftleft(1L, cast(cast(x as bigint) & 63L as int))").alias("bit"),
        )
        .groupBy(*keys, *extra, "y", "wx").agg(F.bit_or("bit").alias("bits"))
    )


def unpack(words: DataFrame, bits: str = "bits", keep: Sequence[str] = (*KEYS, "rev")) -> DataFrame:
    """Words back to one row per cell."""
    # all 64 places of a word, of which the set ones are kept while they are written, not one by one from an array
    placed = words.filter(F.col(bits) != 0).select(*keep, "y", "wx", F.col(bits).alias("_set"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return placed.filter("(shiftrightunsigned(_set, i) & 1L) = 1L").select(*keep, (F.col("wx") * 64 + F.col("i")).alias("x"), "y")


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets (dx, dy) within Euclidean ``radius``."""
    reach = int(math.floor(radius + 1e-9))
    return [
        (dx, dy)
        for dy in range(-reach, reach + 1)
        for dx in range(-reach, reach + 1)
        if dx * dx + dy * dy <= radius * radius + 1e-9
    ]


def ellipse(reach: int) -> list[tuple[int, int]]:
    """Offsets of the round stencil of size 2 * reach + 1; reach 1 is a plus sign."""
    out = []
    for dy in range(-reach, reach + 1):
        half = int(round(math.sqrt(reach * reach - dy * dy)))
        out.extend((dx, dy) for dx in range(-half, half + 1))
    return out


def square(size: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(size) for dx in range(size)]


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _moved(bits: Column, offsets: Iterable[tuple[int, int]]) -> list[tuple[int, int, Column]]:
    """Where the cells of a word land under every offset: (dy, word step, bits)."""
    landing: dict[tuple[int, int], list[Column]] = {}
    for dx, dy in offsets:
        step, rest = divmod(dx, 64)
        landing.setdefault((dy, step), []).append(shift(bits, rest))
        if rest:
            landing.setdefault((dy, step + 1), []).append(shift(bits, rest - 64))
    return [(dy, step, any_of(parts)) for (dy, step), parts in sorted(landing.items(), key=lambda kv: kv[0])]


def _scatter(words: DataFrame, columns: dict[str, list[tuple[int, int, Column]]], keep: Sequence[str]) -> DataFrame:
    """Sends each word's contributions to their target words and ORs them there, in one shuffle."""
    targets: dict[tuple[int, int], dict[str, Column]] = {}
    for name, moves in columns.items():
        for dy, step, bits in moves:
            targets.setdefault((dy, step), {})[name] = bits
    structs = [
        F.struct(
            F.lit(dy).cast("long").alias("dy"), F.lit(step).cast("long").alias("step"),
            *[parts.get(name, _zero()).alias(name) for name in columns],
        )
        for (dy, step), parts in sorted(targets.items(), key=lambda kv: kv[0])
    ]
    filled = lambda s: reduce(lambda a, b: a | b, [s[name] != 0 for name in columns])
    return (
        words.select(*keep, "y", "wx", F.explode(F.filter(F.array(*structs), filled)).alias("m"))
        .select(
            *keep, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("wx") + F.col("m.step")).alias("wx"),
            *[F.col(f"m.{name}").alias(name) for name in columns],
        )
        .groupBy(*keep, "y", "wx").agg(*[F.bit_or(name).alias(name) for name in columns])
    )


def dilate(words: DataFrame, offsets: Sequence[tuple[int, int]], keep: Sequence[str] = (*KEYS, "rev")) -> DataFrame:
    return _scatter(words, {"bits": _moved(F.col("bits"), offsets)}, keep).filter("bits != 0")


def range_bits(low: Column, high: Column, wx: Column) -> Column:
    """Bits of word ``wx`` that stand for low <= x <= high."""
    first = F.greatest(low - wx * 64, _zero()).cast("int")
    last = F.least(high - wx * 64, F.lit(63).cast("long")).cast("int")
    mask = F.call_function("shiftleft", _all_ones(), first).bitwiseAND(
        F.call_function("shiftrightunsigned", _all_ones(), F.lit(63) - last)
    )
    return F.when(first <= last, mask).otherwise(_zero())


#: Raster lines and words of a tile that is eroded and dilated on its own.
STENCIL_ROWS, STENCIL_WORDS = 256, 16
#: Words of the rasters of tiles that are worked on at once.
_STACK = 1 << 20


def _stencils(
    words: DataFrame, steps: Sequence[tuple[str, Sequence[tuple[int, int]]]], dims: DataFrame, keys: Sequence[str], extra: Sequence[str],
) -> DataFrame:
    """Words after the ``steps`` (erode, dilate or clip, with offsets), one after the other; lines off the sheet are left out.

    A raster is cut into tiles, which also get the words around them that all steps together can see, so
    a word is sent once, to few tiles, whatever the stencils. A task takes many tiles at once. ``dims`` holds width and height per sheet.
    """
    keep = (*keys, *extra)
    down = sum(max((abs(dy) for _, dy in offsets), default=0) for _, offsets in steps)
    across = -(-sum(max((abs(dx) for dx, _ in offsets), default=0) for _, offsets in steps) // 64)
    near = [
        F.struct(F.floor((F.col("y") + dy) / STENCIL_ROWS).alias("ty"), F.floor((F.col("wx") + dx) / STENCIL_WORDS).alias("tx"))
        for dy in sorted({-down, 0, down}) for dx in sorted({-across, 0, across})
    ]
    if down > STENCIL_ROWS or across > STENCIL_WORDS:
        raise ValueError("the stencils reach further than a tile")
    placed = (
        words.filter("bits <> 0 and wx is not null").join(dims.select(*keys, "width", "height"), list(keys))
        .filter((F.col("y") >= 0) & (F.col("y") < F.col("height")))
        .select(*keep, "y", "wx", "bits", *[F.col(c).cast("long").alias(c) for c in ("width", "height")], F.explode(F.array_distinct(F.array(*near))).alias("t"))
        .select(*keep, "t.ty", "t.tx", "y", "wx", "bits", "width", "height")
    )
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keep)
    rows_, words_ = STENCIL_ROWS, STENCIL_WORDS
    names = [*keep, "ty", "tx"]

    def work(part: pa.Table) -> pa.Table:
        codes = [part[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in names]
        order = np.lexsort(codes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
        part = part.take(pa.array(order))
        row, y, wx, bits = _stencil_tiles(np.flatnonzero(fresh), *(part[c].to_numpy() for c in ("y", "wx", "bits", "width", "height")), steps, down, across)
        ty, tx = (part[c].to_numpy()[row] for c in ("ty", "tx"))
        own = (y // rows_ == ty) & (wx // words_ == tx)
        kept = part.select(list(keep)).take(pa.array(row[own]))
        return pa.table([*kept.columns, *(pa.array(c[own]) for c in (y, wx, bits))], [*keep, "y", "wx", "bits"])

    # many small tiles are worked on together
    groups = 16 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(work, f"{kinds}, y long, wx long, bits long")


def _stencil_tiles(
    first: np.ndarray, y: np.ndarray, wx: np.ndarray, bits: np.ndarray, width: np.ndarray, height: np.ndarray,
    steps: Sequence[tuple[str, Sequence[tuple[int, int]]]], down: int, across: int,
) -> tuple[np.ndarray, ...]:
    """Words after the steps of tiles that begin at the rows ``first``: a row of the tile, y, wx, bits.

    The tiles stand one below the other, each with ``down`` free lines and ``across`` free words around it.
    """
    top, left = np.minimum.reduceat(y, first) - down, np.minimum.reduceat(wx, first) - across
    tall = np.maximum.reduceat(y, first) - top + down + 1
    broad = np.maximum.reduceat(wx, first) - left + across + 1
    wide, high = np.maximum.reduceat(width, first), np.maximum.reduceat(height, first)
    ends = np.append(first[1:], len(y))
    found, start = [], 0
    while start < len(first):
        size = np.cumsum(tall[start:]) * np.maximum.accumulate(broad[start:])
        stop = start + max(1, int(np.searchsorted(size, _STACK, "right")))
        tiles, rows = slice(start, stop), slice(first[start], ends[stop - 1])
        base = np.cumsum(tall[tiles]) - tall[tiles]
        of = np.repeat(np.arange(stop - start), ends[tiles] - first[tiles])
        stack = np.zeros((int(tall[tiles].sum()), int(broad[tiles].max())), np.uint64)
        np.bitwise_or.at(stack, (base[of] + y[rows] - top[tiles][of], wx[rows] - left[tiles][of]), bits[rows].astype(np.int64).view(np.uint64))
        tile = np.repeat(np.arange(stop - start), tall[tiles])
        line = np.arange(len(stack)) - base[tile] + top[tiles][tile]
        column = (left[tiles][tile][:, None] + np.arange(stack.shape[1])) * 64
        inside = (line >= 0) & (line < high[tiles][tile])
        sheet = np.where(inside[:, None], _ones(wide[tiles][tile][:, None] - column) & ~_ones(-column), np.uint64(0))
        for kind, offsets in steps:
            if kind == "clip":
                stack &= sheet
            elif kind == "dilate":
                stack = _any_moved(stack, offsets)
            else:
                # a cell goes when its stencil covers a free cell of the sheet
                stack = stack & ~_any_moved(sheet & ~stack, [(-dx, -dy) for dx, dy in offsets])
                stack[~inside] = 0
        row, col = np.nonzero(stack)
        found.append((first[tiles][tile[row]], line[row], left[tiles][tile[row]] + col, stack[row, col].view(np.int64)))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*found))


def _ones(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set, none for n below 1 and all for 64 and more."""
    some = (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1)
    return np.where(n >= 64, ~np.uint64(0), some)


def _any_moved(tile: np.ndarray, offsets: Sequence[tuple[int, int]]) -> np.ndarray:
    """Cells that some cell of the tile lands on when it is moved by one of the offsets."""
    out = np.zeros_like(tile)
    columns: dict[int, list[int]] = {}
    for dx, dy in offsets:
        columns.setdefault(dx, []).append(dy)
    n, m = tile.shape
    for dx, lines in columns.items():
        step, rest = divmod(dx, 64)
        moved = np.zeros_like(tile)
        for by, part in ((step, tile << np.uint64(rest)), (step + 1, tile >> np.uint64(64 - rest) if rest else None)):
            if part is not None and abs(by) < m:
                moved[:, max(by, 0):m + min(by, 0)] |= part[:, max(-by, 0):m - max(by, 0)]
        for dy in lines:
            if abs(dy) < n:
                out[max(dy, 0):n + min(dy, 0)] |= moved[max(-dy, 0):n - max(dy, 0)]
    return out


def erode(
    words: DataFrame, offsets: Sequence[tuple[int, int]], dims: DataFrame,
    keys: Sequence[str] = KEYS, extra: Sequence[str] = ("rev",),
) -> DataFrame:
    """Cells whose whole stencil is set; places off the sheet count as set.

    ``dims`` holds width and height per sheet.
    """
    return _stencils(words, [("erode", offsets)], dims, keys, extra)


def opening(
    words: DataFrame, offsets: Sequence[tuple[int, int]], dims: DataFrame,
    keys: Sequence[str] = KEYS, extra: Sequence[str] = ("rev",),
) -> DataFrame:
    """Cells covered by some placement of the stencil that fits into the set cells."""
    return _stencils(words, [("erode", offsets), ("dilate", offsets), ("clip", [])], dims, keys, extra)


def closing(
    words: DataFrame, offsets: Sequence[tuple[int, int]], dims: DataFrame,
    keys: Sequence[str] = KEYS, extra: Sequence[str] = ("rev",),
) -> DataFrame:
    return _stencils(words, [("dilate", offsets), ("clip", []), ("erode", offsets)], dims, keys, extra)


def clip(words: DataFrame, dims: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells inside the sheet."""
    bounded = words.join(dims.select(*keys, "width", "height"), list(keys))
    inside = range_bits(_zero(), F.col("width") - 1, F.col("wx"))
    return (
        bounded.filter((F.col("y") >= 0) & (F.col("y") < F.col("height")))
        .withColumn("bits", F.col("bits").bitwiseAND(inside)).filter("bits != 0").drop("width", "height")
    )


def side_by_side(words: DataFrame, keys: Sequence[str] = KEYS, radius: float = 0.0) -> DataFrame:
    """Both revisions of a sheet on one row per word, with what lies within ``radius`` of each.

    Columns a, b, near_a, near_b. One shuffle serves both directions of the
    tolerance test, the foreground union and all counts.
    """
    offsets = disc(radius)
    a = F.when(F.col("rev") == "A", F.col("bits")).otherwise(_zero())
    b = F.when(F.col("rev") == "B", F.col("bits")).otherwise(_zero())
    if offsets == [(0, 0)]:
        return (
            words.select(*keys, "y", "wx", a.alias("a"), b.alias("b"))
            .groupBy(*keys, "y", "wx").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
            .withColumns({"near_a": F.col("a"), "near_b": F.col("b")})
        )
    split = words.select(*keys, "y", "wx", a.alias("a"), b.alias("b"))
    spread = _scatter(
        split,
        {
            "a": [(0, 0, F.col("a"))], "b": [(0, 0, F.col("b"))],
            "near_a": _moved(F.col("a"), offsets), "near_b": _moved(F.col("b"), offsets),
        },
        keys,
    )
    return spread.filter("a != 0 or b != 0")


def masks(both: DataFrame) -> DataFrame:
    """Removed, added, changed and foreground words of a ``side_by_side`` table."""
    removed = without(F.col("a"), F.col("near_b"))
    added = without(F.col("b"), F.col("near_a"))
    return both.withColumns(
        {
            "removed": removed, "added": added,
            "changed": removed.bitwiseOR(added), "foreground": F.col("a").bitwiseOR(F.col("b")),
        }
    )


def tolerance_anti_join(words: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells of one revision with no cell of the other within ``radius``: side removed or added."""
    found = masks(side_by_side(words, keys, radius))
    sides = [
        found.select(*keys, F.lit(side).alias("side"), "y", "wx", F.col(side).alias("bits"))
        for side in ("removed", "added")
    ]
    return sides[0].unionByName(sides[1]).filter("bits != 0")


# --- boxes over cells -----------------------------------------------------------------

TILE_ROWS, TILE_WORDS = 256, 4


def box_tiles(boxes: DataFrame) -> DataFrame:
    """One row per 256 x 256 tile a box touches (columns ty, tx)."""
    last_x, last_y = F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1
    rows = F.sequence(F.floor(F.col("y") / TILE_ROWS), F.floor(last_y / TILE_ROWS))
    cols = F.sequence(F.floor(F.col("x") / (64 * TILE_WORDS)), F.floor(last_x / (64 * TILE_WORDS)))
    return boxes.filter("w > 0 and h > 0").withColumn("ty", F.explode(rows)).withColumn("tx", F.explode(cols))


def _tiled(words: DataFrame) -> DataFrame:
    return words.withColumns(
        {"ty": F.floor(F.col("y") / TILE_ROWS), "tx": F.floor(F.col("wx") / TILE_WORDS)}
    )


def words_in_boxes(words: DataFrame, boxes: DataFrame, bits: str, keys: Sequence[str], box_cols: Sequence[str]) -> DataFrame:
    """Each word with each box that touches it, cut to the box (column ``inside``)."""
    tiles = box_tiles(boxes).select(
        *keys, *box_cols, "ty", "tx", F.col("x").alias("bx"), F.col("y").alias("by"),
        F.col("w").alias("bw"), F.col("h").alias("bh"),
    )
    joined = _tiled(words).join(tiles, [*keys, "ty", "tx"])
    in_rows = (F.col("y") >= F.col("by")) & (F.col("y") < F.col("by") + F.col("bh"))
    cut_bits = F.col(bits).bitwiseAND(range_bits(F.col("bx"), F.col("bx") + F.col("bw") - 1, F.col("wx")))
    return joined.filter(in_rows).withColumn("inside", cut_bits).filter("inside != 0")


def count_in_boxes(words: DataFrame, boxes: DataFrame, bits: str, keys: Sequence[str], box_id: str) -> DataFrame:
    """Set cells inside every box, boxes without any included (column ``changed_px``)."""
    hits = (
        words_in_boxes(words.filter(F.col(bits) != 0), boxes, bits, keys, [box_id])
        .groupBy(*keys, box_id).agg(F.sum(F.bit_count("inside")).cast("long").alias("changed_px"))
    )
    return boxes.join(hits, [*keys, box_id], "left").fillna(0, ["changed_px"])


def mask_regions(words: DataFrame, boxes: DataFrame, bits: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Clears the cells inside exclusion boxes, in all columns of ``bits``."""
    tiles = box_tiles(boxes).select(
        *keys, "ty", "tx", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh")
    )
    places = _tiled(words.select(*keys, "y", "wx").distinct())
    hidden = (
        places.join(tiles, [*keys, "ty", "tx"])
        .filter("y >= by and y < by + bh")
        .withColumn("mask", range_bits(F.col("bx"), F.col("bx") + F.col("bw") - 1, F.col("wx")))
        .groupBy(*keys, "y", "wx").agg(F.bit_or("mask").alias("mask"))
    )
    joined = words.join(hidden, [*keys, "y", "wx"], "left")
    keep = F.bitwise_not(F.coalesce("mask", _zero()))
    cleared = joined.withColumns({name: F.col(name).bitwiseAND(keep) for name in bits}).drop("mask")
    return cleared.filter(reduce(lambda a, b: a | b, [F.col(name) != 0 for name in bits]))


# --- gray rasters ---------------------------------------------------------------------


def blur(
    gray: DataFrame, dims: DataFrame, keys: Sequence[str] = (*KEYS, "rev"), dim_keys: Sequence[str] = KEYS, tile: int = 256,
) -> DataFrame:
    """3 x 3 binomial blur of a sparse gray raster; absent cells are white, edges mirror inward.

    Only cells that differ from white come out. A task blurs a tile of ``tile`` x ``tile`` cells, which
    also gets the cells next to it.
    """
    near = [
        F.struct(F.floor((F.col("x") + dx) / tile).alias("tx"), F.floor((F.col("y") + dy) / tile).alias("ty"))
        for dx in (-1, 1) for dy in (-1, 1)
    ]
    long = lambda c: F.col(c).cast("long").alias(c)
    placed = (
        gray.filter("v != 255 and x is not null and y is not null").join(dims.select(*dim_keys, "width", "height"), list(dim_keys))
        .withColumn("t", F.explode(F.array_distinct(F.array(*near))))
        .select(*keys, "t.tx", "t.ty", *map(long, ("x", "y", "v", "width", "height")))
    )
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys)

    def spread(part: pa.Table) -> pa.Table:
        corner = part["tx"][0].as_py() * tile, part["ty"][0].as_py() * tile
        blurred = _blur_tile(*(part[c].to_numpy() for c in ("x", "y", "v", "width", "height")), corner, tile)
        own = [pa.repeat(part[k][0], len(blurred[0])) for k in keys]
        return pa.table([*own, *map(pa.array, blurred)], [*keys, "x", "y", "v"])

    return placed.groupBy(*keys, "tx", "ty").applyInArrow(spread, f"{kinds}, x long, y long, v long")


def _blur_tile(
    x: np.ndarray, y: np.ndarray, v: np.ndarray, width: np.ndarray, height: np.ndarray, corner: tuple[int, int], tile: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of one tile after the blur, without white ones."""

    def weight(source: np.ndarray, target: np.ndarray, extent: np.ndarray, step: int) -> np.ndarray:
        # the cell next to an edge also stands in for its mirror image outside
        mirrored = ((target == 0) & (source == 1)) | ((target == extent - 1) & (source == extent - 2))
        return np.where((step == 0) | mirrored, 2, 1)

    # of the tile only the part that cells reach
    left, top = max(int(x.min()) - 1, corner[0]), max(int(y.min()) - 1, corner[1])
    right, bottom = min(int(x.max()) + 1, corner[0] + tile - 1), min(int(y.max()) + 1, corner[1] + tile - 1)
    across = right - left + 1
    total = np.zeros(across * (bottom - top + 1), np.int64)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            to_x, to_y = x + dx, y + dy
            own = (to_x >= 0) & (to_y >= 0) & (to_x < width) & (to_y < height)
            own &= (to_x >= left) & (to_x <= right) & (to_y >= top) & (to_y <= bottom)
            part = (v - 255) * weight(x, to_x, width, dx) * weight(y, to_y, height, dy)
            np.add.at(total, ((to_y - top) * across + to_x - left)[own], part[own])
    value = (total + 255 * 16 + 8) // 16
    found = np.flatnonzero(value != 255)
    return left + found % across, top + found // across, value[found]


def histogram(gray: DataFrame, dims: DataFrame, keys: Sequence[str] = (*KEYS, "rev"), dim_keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells per gray value and sheet; the absent cells are added to white."""
    counts = gray.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    present = counts.groupBy(*keys).agg(F.sum("n").alias("present"))
    white = present.join(dims, list(dim_keys)).select(
        *keys, F.lit(255).cast("long").alias("v"), (F.col("width") * F.col("height") - F.col("present")).alias("n")
    )
    return counts.unionByName(white).groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def cumulative_histogram(hist: DataFrame, keys: Sequence[str] = (*KEYS, "rev")) -> DataFrame:
    """Running count and running weighted sum; at most 256 rows per sheet."""
    run = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    return hist.withColumns(
        {
            "count_low": F.sum("n").over(run), "sum_low": F.sum(F.col("n") * F.col("v")).over(run),
            "count_all": F.sum("n").over(every), "sum_all": F.sum(F.col("n") * F.col("v")).over(every),
        }
    )


def otsu_threshold(hist: DataFrame, keys: Sequence[str] = (*KEYS, "rev")) -> DataFrame:
    """Gray value that splits the histogram with the largest variance between both classes."""
    run = cumulative_histogram(hist, keys)
    low, high = F.col("count_low").cast("double"), (F.col("count_all") - F.col("count_low")).cast("double")
    mean_low = F.col("sum_low") / low
    mean_high = (F.col("sum_all") - F.col("sum_low")) / high
    share = (low / F.col("count_all")) * (high / F.col("count_all"))
    between = F.when(high > 0, share * (mean_low - mean_high) * (mean_low - mean_high)).otherwise(0.0)
    scored = run.withColumn("rank", F.struct(F.round(between, 6).alias("s"), (-F.col("v")).alias("v")))
    return scored.groupBy(*keys).agg((-F.max("rank")["v"]).alias("threshold"))


def foreground(gray: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (*KEYS, "rev")) -> DataFrame:
    """Cells at or below the threshold of their sheet."""
    return gray.join(thresholds, list(keys)).filter("v <= threshold").select(*keys, "x", "y")


def thumbnail(
    gray: DataFrame, dims: DataFrame, side: int = 160,
    keys: Sequence[str] = (*KEYS, "rev"), dim_keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Area average over a ``side`` x ``side`` grid as one row-major vector per sheet."""
    gx = F.floor(F.col("x") * side / F.col("width"))
    gy = F.floor(F.col("y") * side / F.col("height"))
    ink = (
        gray.filter("v != 255").join(dims.select(*dim_keys, "width", "height"), list(dim_keys))
        .groupBy(*keys, "width", "height", gx.alias("gx"), gy.alias("gy"))
        .agg(F.sum(F.col("v") - 255).alias("dark"))
    )

    def span(g: Column, extent: Column) -> Column:
        # cells x with floor(x * side / extent) = g
        return F.ceil((g + 1) * extent / side) - F.ceil(g * extent / side)

    area = span(F.col("gx"), F.col("width")) * span(F.col("gy"), F.col("height"))
    values = ink.select(
        *keys, (F.col("gy") * side + F.col("gx")).alias("place"), (255.0 + F.col("dark") / area).alias("value")
    )
    filled = F.map_from_entries(F.collect_list(F.struct("place", "value")))   # at most side * side entries
    places = F.sequence(F.lit(0).cast("long"), F.lit(side * side - 1).cast("long"))
    return values.groupBy(*keys).agg(filled.alias("m")).select(
        *keys, F.transform(places, lambda p: F.coalesce(F.try_element_at("m", p), F.lit(255.0))).alias("thumb")
    )


# --- metrics --------------------------------------------------------------------------


def diff_metrics(mask_words: DataFrame, dims: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, percentages and areas per sheet; ``dims`` holds width, height and dpi."""
    names = ("changed", "added", "removed", "foreground")
    sums = mask_words.groupBy(*keys).agg(
        *[F.sum(F.bit_count(name)).cast("long").alias(f"{name}_px") for name in names]
    )
    full = dims.join(sums, list(keys), "left").fillna(0, [f"{name}_px" for name in names])
    size = F.col("width") * F.col("height")
    mm2 = px_to_mm2(F.col("dpi"))
    share = F.least(F.lit(100.0), F.col("changed_px") / F.col("foreground_px") * 100.0)
    return full.withColumns(
        {
            "diff_percent": F.col("changed_px") / size * 100.0,
            "diff_foreground_percent": F.when(F.col("foreground_px") > 0, share).otherwise(0.0),
            "diff_area_mm2": F.col("changed_px") * mm2,
            "added_area_mm2": F.col("added_px") * mm2,
            "removed_area_mm2": F.col("removed_px") * mm2,
            "foreground_sparse": F.col("foreground_px") < size * C.SPARSE_FOREGROUND_RATIO,
        }
    )


# --- registration ---------------------------------------------------------------------


#: Raster lines and words of a tile whose shifts one task votes on.
VOTE_ROWS, VOTE_WORDS = 256, 16


def shift_votes(words: DataFrame, reach: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many cells of A meet a cell of B displaced by (dx, dy), for all |dx|, |dy| <= reach.

    A tile of A also gets the words of B around it; a word is sent once, to few tiles, and a task votes on many tiles at once.
    """
    if reach > 63:
        raise ValueError("reach is limited to 63 cells; use a coarser grid for larger shifts")
    own, side = F.col("rev") == "A", 1 if reach else 0
    near = [
        F.struct(F.floor((F.col("y") + dy) / VOTE_ROWS).alias("ty"), F.floor((F.col("wx") + step) / VOTE_WORDS).alias("tx"))
        for dy in (0, -reach, reach) for step in (0, -side, side)
    ]
    tiles = F.array_distinct(F.when(own, F.array(near[0])).otherwise(F.array(*near)))
    placed = (
        words.filter("rev in ('A', 'B') and bits <> 0 and y is not null and wx is not null")
        .select(*keys, own.alias("own"), "y", "wx", "bits", F.explode(tiles).alias("t")).select(*keys, "t.ty", "t.tx", "own", "y", "wx", "bits")
    )
    spans = list(range(-reach, reach + 1))
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys)
    names = ["dy", *(f"v{i}" for i, _ in enumerate(spans))]

    tile = [*keys, "ty", "tx"]

    def vote(part: pa.Table) -> pa.Table:
        codes = [part[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in tile]
        order = np.lexsort(codes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
        part, first = part.take(pa.array(order)), np.flatnonzero(fresh)
        # tile, dy, dx
        votes = _tile_votes(first, *(part[c].to_numpy() for c in ("own", "y", "wx", "bits")), reach)
        at, dy = np.nonzero(votes.any(axis=2))
        kept = part.select(list(keys)).take(pa.array(first[at]))
        return pa.table([*kept.columns, pa.array(dy - reach), *map(pa.array, votes[at, dy].T)], [*keys, *names])

    # many small tiles are voted on together
    groups = 16 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(*tile), F.lit(groups)))
    voted = dealt.groupBy("part").applyInArrow(vote, f"{kinds}, " + ", ".join(f"{n} long" for n in names))
    summed = voted.groupBy(*keys, "dy").agg(*[F.sum(n).alias(n) for n in names[1:]])
    listed = F.explode(
        F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.col(f"v{i}").alias("votes")) for i, dx in enumerate(spans)])
    )
    return summed.select(*keys, "dy", listed.alias("v")).select(*keys, "v.dx", "dy", "v.votes").filter("votes > 0")


def _tile_votes(first: np.ndarray, own: np.ndarray, y: np.ndarray, wx: np.ndarray, bits: np.ndarray, reach: int) -> np.ndarray:
    """Votes [tile, dy, dx] of the words of A (``own``) and the words of B around them, in tiles that begin at the rows ``first``.

    The tiles stand one below the other, each with ``reach`` free lines and a free word around it.
    """
    span = range(-reach, reach + 1)
    votes = np.zeros((len(first), len(span), len(span)), np.int64)
    bits = bits.astype(np.int64).view(np.uint64)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(y))))
    most = np.iinfo(np.int64).max
    top, left = (np.minimum.reduceat(np.where(own, c, most), first) for c in (y, wx))
    tall, broad = (np.maximum.reduceat(np.where(own, c, -most), first) for c in (y, wx))
    chosen = np.flatnonzero(np.logical_or.reduceat(own, first) & np.logical_or.reduceat(~own, first))
    tall[chosen] += 2 * reach + 1 - top[chosen]
    broad[chosen] += 3 - left[chosen]
    start = 0
    while start < len(chosen):
        size = np.cumsum(tall[chosen[start:]]) * np.maximum.accumulate(broad[chosen[start:]])
        stop = start + max(1, int(np.searchsorted(size, _STACK, "right")))
        tiles = chosen[start:stop]
        base = np.cumsum(tall[tiles]) - tall[tiles]
        place = np.full(len(first), -1)
        place[tiles] = np.arange(len(tiles))
        rows = np.flatnonzero(place[of] >= 0)
        at, mine = place[of[rows]], own[rows]
        line, col = y[rows] - top[tiles][at] + reach, wx[rows] - left[tiles][at] + 1
        near = ~mine & (line >= 0) & (line < tall[tiles][at]) & (col >= 0) & (col < broad[tiles][at])
        a, b = (np.zeros((int(tall[tiles].sum()), int(broad[tiles].max())), np.uint64) for _ in "ab")
        for stack, held in ((a, mine), (b, near)):
            stack[base[at[held]] + line[held], col[held]] = bits[rows[held]]
        # only lines that hold cells of A are looked at, word by word
        lines = np.flatnonzero(a.any(axis=1))
        a, edges = np.ascontiguousarray(a[lines, 1:-1].T), np.searchsorted(lines, np.append(base, len(b)))
        for dx in span:
            moved = b[:, 1:-1]
            if dx > 0:
                moved = (moved >> np.uint64(dx)) | (b[:, 2:] << np.uint64(64 - dx))
            elif dx < 0:
                moved = (moved << np.uint64(-dx)) | (b[:, :-2] >> np.uint64(64 + dx))
            moved = np.ascontiguousarray(moved.T)
            for dy in span:
                met = np.zeros(len(lines) + 1, np.int64)
                np.cumsum(np.bitwise_count(a & np.take(moved, lines + dy, axis=1)).sum(axis=0, dtype=np.int64), out=met[1:])
                votes[tiles, dy + reach, dx + reach] = np.diff(met[edges])
        start = stop
    return votes


def halve(words: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The next coarser grid: a cell is set if one of its four cells is."""
    bits = F.col("bits")
    half = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555))
    # every second bit moves together, twice as many per step
    for step, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0xFFFFFFFF)):
        half = half.bitwiseOR(F.shiftrightunsigned(half, step)).bitwiseAND(F.lit(mask))
    odd = F.col("wx").bitwiseAND(F.lit(1)) == 1
    placed = F.when(odd, F.shiftleft(half, 32)).otherwise(half)
    return words.select(*keys, "rev", F.shiftright("y", 1).alias("y"), F.shiftright("wx", 1).alias("wx"), placed.alias("bits")).groupBy(
        *keys, "rev", "y", "wx").agg(F.bit_or("bits").alias("bits"))


def _best_shift(votes: DataFrame, limits: DataFrame, slack: int, keys: Sequence[str]) -> DataFrame:
    """Displacement with the most votes among those plausible for the sheet; ties to the smallest."""
    order = F.struct(F.col("votes"), -(F.abs("dx") + F.abs("dy")), -F.abs("dy"), -F.col("dy"), -F.col("dx"))
    inside = (F.abs("dx") <= F.col("most_x") + slack) & (F.abs("dy") <= F.col("most_y") + slack)
    return votes.join(limits, list(keys)).filter(inside).groupBy(*keys).agg(F.max_by(F.struct("dx", "dy", "votes"), order).alias("best"))


def register_shift(words: DataFrame, dims: DataFrame, reach: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Displacement of B against A with its residual before and after.

    Shifts up to a tenth of the side are found from coarse to fine: the grid is halved
    until ``reach`` cells cover a tenth of the longer side (the sheet's size alone decides
    how often), all shifts of that grid are voted on, and each finer grid refines the
    winner by two cells. The residual counts cells without a partner, |A| + |B| - 2 * votes.
    A shift is taken only when it lowers the residual clearly.
    """
    longer = F.greatest("width", "height") * C.MAX_SHIFT_RATIO
    limits = cut(dims.select(
        *keys, (F.col("width") * C.MAX_SHIFT_RATIO).alias("most_x"), (F.col("height") * C.MAX_SHIFT_RATIO).alias("most_y"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.floor(longer) / reach))).cast("int").alias("levels"),
    ))
    top = limits.agg(F.max("levels")).first()[0] or 0
    grids = [words]
    for level in range(1, top + 1):
        grids.append(cut(halve(grids[-1].join(limits.filter(F.col("levels") >= level).select(*keys), list(keys), "left_semi"), keys)))
    found: DataFrame | None = None
    for level in range(top, -1, -1):
        here = limits.withColumns({m: F.col(m) / (1 << level) for m in ("most_x", "most_y")})
        own = grids[level].join(limits.filter(F.col("levels") == level).select(*keys), list(keys), "left_semi")
        best = _best_shift(shift_votes(own, reach, keys), here, 1 if level else 0, keys).select(*keys, "best.*")
        if found is not None:
            guess = found.select(*keys, (F.col("dx") * 2).alias("shift_x"), (F.col("dy") * 2).alias("shift_y"))
            moved = apply_shift(grids[level].join(guess.select(*keys), list(keys), "left_semi"), guess, keys)
            near = shift_votes(moved, 2, keys).join(guess, list(keys)).withColumns(
                {"dx": F.col("dx") + F.col("shift_x"), "dy": F.col("dy") + F.col("shift_y")})
            best = best.unionByName(_best_shift(near, here, 1 if level else 0, keys).select(*keys, "best.*"))
        found = cut(best) if level else best
    met = F.sum(F.bit_count(F.col("a").bitwiseAND(F.col("b")))).alias("still")
    still = side_by_side(words, keys).groupBy(*keys).agg(met)
    totals = words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("total"))
    joined = dims.select(*keys).join(totals, list(keys)).join(found, list(keys), "left").join(still, list(keys), "left")
    dx, dy = F.coalesce("dx", F.lit(0)), F.coalesce("dy", F.lit(0))
    before = F.col("total") - 2 * F.coalesce("still", F.lit(0))
    after = F.col("total") - 2 * F.coalesce("votes", F.lit(0))
    method = (
        F.when(before == 0, "IDENTITY")
        .when(F.col("votes").isNull(), "SHIFT_FAILED")
        .when((dx == 0) & (dy == 0), "ALREADY_ALIGNED")
        .when(after <= before * C.CLEAR_RESIDUAL_RATIO, "SHIFT")
        .otherwise("SHIFT_FAILED")
    )
    moved = method == "SHIFT"
    return joined.select(
        *keys, method.alias("method"), (method != "SHIFT_FAILED").alias("ok"),
        F.when(moved, dx).otherwise(0).cast("long").alias("shift_x"),
        F.when(moved, dy).otherwise(0).cast("long").alias("shift_y"),
        before.alias("residual_before"), F.when(moved, after).otherwise(before).alias("residual_after"),
    )


def apply_shift(words: DataFrame, shifts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Moves revision B back by its shift, so that it lies on A."""
    joined = words.join(shifts.select(*keys, "shift_x", "shift_y"), list(keys), "left")
    is_b = F.col("rev") == "B"
    dx = F.when(is_b, -F.coalesce("shift_x", F.lit(0).cast("long"))).otherwise(0)
    dy = F.when(is_b, -F.coalesce("shift_y", F.lit(0).cast("long"))).otherwise(0)
    step, rest = F.floor(dx / 64), F.pmod(dx, F.lit(64).cast("long")).cast("int")
    low = F.call_function("shiftleft", F.col("bits"), rest)
    high = F.when(rest == 0, _zero()).otherwise(
        F.call_function("shiftrightunsigned", F.col("bits"), F.lit(64) - rest)
    )
    parts = F.array(
        F.struct((F.col("wx") + step).alias("wx"), low.alias("bits")),
        F.struct((F.col("wx") + step + 1).alias("wx"), high.alias("bits")),
    )
    return (
        joined.select(*keys, "rev", (F.col("y") + dy).alias("y"), F.explode(F.filter(parts, lambda p: p["bits"] != 0)).alias("p"))
        .groupBy(*keys, "rev", "y", F.col("p.wx").alias("wx")).agg(F.bit_or("p.bits").alias("bits"))
    )
