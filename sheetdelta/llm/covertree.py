"""Embedding near-duplicates by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import roots
from sheetdelta.llm.graph import components
from sheetdelta.llm.vptree import usable
from sheetdelta.session import cut

#: Vectors of one block, about; each block gets a tree, each pair of blocks a traversal.
BLOCK_ROWS = 2_048
#: Pairs of children from which on two nodes are compared as matrices.
WIDE = 4_096
#: Levels below the unit radius; radii halve from one to the next.
LEVELS = 6


class CoverTree:
    """Nested levels over unit vectors: each node covers its points within its level's radius.

    A level is a set of centres no closer than its radius, chosen in order; each centre of a
    finer level hangs on the nearest centre of the coarser one. ``reach`` is the true largest
    distance from a centre to a point below it, which bounds at least as well as the radius.
    """

    def __init__(self, points: np.ndarray, levels: int = LEVELS) -> None:
        self.points = points
        n = len(points)
        centres = [np.zeros(1, int) if n else np.zeros(0, int)]
        self.parent: list[np.ndarray] = []
        radius = 1.0
        for _ in range(levels):
            centres.append(self._net(centres[-1], radius))
            radius /= 2
        centres.append(np.arange(n))
        self.centres = centres
        for coarse, fine in zip(centres, centres[1:]):
            self.parent.append(self._nearest(fine, coarse))
        # centres above each point, and how far the points below a centre are
        self.reach = [np.zeros(n)]
        above = np.arange(n)
        for coarse, parent in zip(centres[-2::-1], self.parent[::-1]):
            above = parent[above]
            far = np.zeros(len(coarse))
            gap = np.sqrt(((points - points[coarse[above]]) ** 2).sum(axis=1)) if n else np.zeros(0)
            np.maximum.at(far, above, gap)
            self.reach.insert(0, far)
        # children of every centre: their order, and where each centre's begin
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        for coarse, parent in zip(centres, self.parent):
            order = np.argsort(parent, kind="stable")
            self.children.append((order, np.searchsorted(parent[order], np.arange(len(coarse) + 1))))

    def _net(self, kept: np.ndarray, radius: float) -> np.ndarray:
        """Extends the coarser centres so that every point is within ``radius`` of one."""
        near = 1 - radius * radius / 2
        free = np.flatnonzero(self._closest(np.arange(len(self.points)), kept) < near)
        if not len(free):
            return kept
        # points without another free one near by are centres in any order, the rest are taken in turn
        alone = self._closest(free, free, itself=False) < near
        added, rest = [free[alone]], free[~alone]
        while len(rest):
            added.append(rest[:1])
            rest = rest[self.points[rest] @ self.points[rest[0]] < near]
        return np.sort(np.concatenate([kept, *added]))

    def _closest(self, some: np.ndarray, others: np.ndarray, itself: bool = True) -> np.ndarray:
        """Largest cosine of each of some points to one of the others."""
        out = np.full(len(some), -2.0)
        for a in range(0, len(some) if len(others) else 0, 1024):
            dots = self.points[some[a : a + 1024]] @ self.points[others].T
            if not itself:
                dots[np.arange(len(dots)), np.arange(a, a + len(dots))] = -2.0
            out[a : a + 1024] = dots.max(axis=1)
        return out

    def _nearest(self, fine: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fine), int)
        for a in range(0, len(fine), 1024):
            out[a : a + 1024] = (self.points[fine[a : a + 1024]] @ self.points[coarse].T).argmax(axis=1)
        return out


def _child_pairs(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, most: int = 1 << 16,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs, in portions of about ``most``."""
    (order_a, ends_a), (order_b, ends_b) = left, right
    wide = np.diff(ends_b)[b]
    # one entry for each child of a, which then meets all children of b
    tall = np.diff(ends_a)[a]
    pair = np.repeat(np.arange(len(a)), tall)
    child = order_a[np.repeat(ends_a[a], tall) + np.arange(len(pair)) - np.repeat(np.cumsum(tall) - tall, tall)]
    done = np.cumsum(wide[pair])
    start = 0
    while start < len(pair):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
        part = pair[start:stop]
        each = wide[part]
        at = np.repeat(ends_b[b[part]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        yield np.repeat(child[start:stop], each), order_b[at]
        start = stop


def close_pairs(left: CoverTree, right: CoverTree, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points within ``limit``, each once for one tree: node pairs are dropped level by level.

    A pair of nodes lives on only if the distance of the centres, less both reaches, is
    within the limit; the pairs of a level come from the children of those of the level above.
    """
    if not len(left.points) or not len(right.points):
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.zeros(1, int), np.zeros(1, int)
    for level in range(len(left.parent)):
        own_a, own_b = left.centres[level + 1], right.centres[level + 1]
        reach_a, reach_b = left.reach[level + 1], right.reach[level + 1]
        out = []
        (order_a, ends_a), (order_b, ends_b) = left.children[level], right.children[level]
        wide = np.diff(ends_a)[a] * np.diff(ends_b)[b] >= WIDE
        for x, y in zip(a[wide].tolist(), b[wide].tolist()):
            kids, others = order_a[ends_a[x] : ends_a[x + 1]], order_b[ends_b[y] : ends_b[y + 1]]
            for s in range(0, len(kids), 1024):
                part = kids[s : s + 1024]
                bound = np.minimum(limit + reach_a[part][:, None] + reach_b[others][None, :] + 1e-9, 2.0)
                i, j = np.nonzero(left.points[own_a[part]] @ right.points[own_b[others]].T >= 1 - bound * bound / 2)
                out.append((part[i], others[j]))
        for i, j in _child_pairs(left.children[level], right.children[level], a[~wide], b[~wide]):
            dots = np.einsum("ij,ij->i", left.points[own_a[i]], right.points[own_b[j]])
            bound = np.minimum(limit + reach_a[i] + reach_b[j] + 1e-9, 2.0)
            keep = dots >= 1 - bound * bound / 2
            out.append((i[keep], j[keep]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in (0, 1))
        if left is right:  # each pair once
            once = np.unique(np.minimum(a, b) * len(own_b) + np.maximum(a, b))
            a, b = once // max(1, len(own_b)), once % max(1, len(own_b))
    return left.centres[-1][a], right.centres[-1][b]


def near_duplicate_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is at least
    ``cosine``. Equal vectors of a label are folded with their number, so copies cost one
    vector. Vectors of a label are dealt to blocks of bounded size; each pair of blocks is
    one task, which traverses two cover trees and returns, per vector, how many rows it
    links to and one connecting link at most. Null or zero vectors and those with null or
    non-finite components link with nothing; vectors link with those of their length only; usable rows with one
    key count once, with the smallest label and then vector; a null key takes no part and returns with no links. Other
    columns are not read.
    """
    own = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    rows = own.filter(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    folded = cut(rows.groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    sizes = folded.groupBy("label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = folded.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    dealt = dealt.select("label", F.size("v").alias("width"), F.explode(cells).alias("cell"), "own", "first", "copies", "v")
    kind = vectors.schema[key].dataType.simpleString()
    limit = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def compare(part: pa.Table) -> pa.Table:
        flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(part.num_rows, -1)
        norm = np.sqrt((v * v).sum(axis=1))
        unit = v / norm[:, None]
        block, copies = part["own"].to_numpy(), part["copies"].to_numpy()
        low = np.flatnonzero(block == block.min())
        high = np.flatnonzero(block != block.min())
        cell = part["cell"][0].as_py()
        if cell["low"] == cell["high"]:
            tree = CoverTree(unit)
            i, j = close_pairs(tree, tree, limit)
            keep = i < j
            i, j = i[keep], j[keep]
        elif len(high) == 0:
            i = j = np.zeros(0, int)
        else:
            i, j = close_pairs(CoverTree(unit[low]), CoverTree(unit[high]), limit)
            i, j = low[i], high[j]
        exact = np.zeros(len(i), bool)
        for a in range(0, len(i), 65536):
            s, t = i[a : a + 65536], j[a : a + 65536]
            exact[a : a + 65536] = (v[s] * v[t]).sum(axis=1) / (norm[s] * norm[t]) >= cosine
        i, j = i[exact], j[exact]
        links = np.bincount(i, copies[j], len(v)) + np.bincount(j, copies[i], len(v))
        met = np.flatnonzero(links)
        first = part["first"]
        root = roots(i, j, len(v))
        return pa.table({
            "id": first.take(pa.array(met)), "links": pa.array(links[met].astype(np.int64)), "root": first.take(pa.array(root[met])),
        })

    # by cell, not by label alone, and not merged by size: the work is in the comparisons
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "label", "width", "cell")
    found = cut(dealt.groupBy("label", "width", "cell").applyInArrow(compare, f"id {kind}, links long, root {kind}"))
    counts = found.groupBy("id").agg(F.sum("links").alias("others"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = folded.join(counts, folded["first"] == counts.id, "left").drop("id").join(joined, folded["first"] == joined.node, "left")
    facts = facts.select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "first").alias("component_id"),
    )
    return own.join(facts, (own.label == facts["_label"]) & (own.v == facts["_v"]) & own.id.isNotNull(), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
