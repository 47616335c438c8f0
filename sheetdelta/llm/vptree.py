"""Nearest neighbours with vantage-point trees per shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Vectors of one shard's tree and queries of one block, about.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 8_192
#: Vectors of a leaf.
LEAF = 64
#: How much wider than allowed by the triangle inequality a part may be pruned; 1 is exact.
RELAX = 1.0


def usable(vector: Column) -> Column:
    """Vectors with finite components only, at least one of them not zero."""
    vector = vector.cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - query) ** 2).sum(axis=-1))


@dataclass
class Node:
    """A vantage point, the distance ranges of both halves to it, and the halves; or a leaf's rows."""

    rows: np.ndarray
    point: int = -1
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    inside: Node | None = None
    outside: Node | None = None


class VPTree:
    """Tree over the rows of a matrix, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 5) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids, self.leaf = vectors[order], ids[order], leaf
        self.draw = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows)
        pick = int(self.draw.integers(len(rows)))
        point = int(rows[pick])
        rest = np.delete(rows, pick)
        gap = distances(self.vectors[rest], self.vectors[point])
        order = np.argsort(gap, kind="stable")
        half = len(rest) // 2
        low, high = order[:half], order[half:]  # halves by rank, so equal distances can't unbalance the tree
        return Node(
            rows[:0], point, (float(gap[low[0]]), float(gap[low[-1]])), (float(gap[high[0]]), float(gap[high[-1]])),
            self._build(np.sort(rest[low])), self._build(np.sort(rest[high])),
        )

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the ``k`` nearest of each query, ties to the smaller id; -1 where there are none.

        ``own`` is the id of each query itself, which is left out.
        """
        best = np.full((len(queries), k), np.inf)
        rows = np.full((len(queries), k), len(self.ids))

        def offer(at: np.ndarray, candidates: np.ndarray) -> None:
            for a in range(0, len(at), 512):
                part = at[a : a + 512]
                gap = distances(self.vectors[candidates][None, :, :], queries[part][:, None, :])
                gap[self.ids[candidates][None, :] == own[part][:, None]] = np.inf
                all_gaps = np.concatenate([best[part], gap], axis=1)
                all_rows = np.concatenate([rows[part], np.broadcast_to(candidates, gap.shape)], axis=1)
                order = np.lexsort((all_rows, all_gaps), axis=1)[:, :k]  # rows are in id order
                best[part], rows[part] = np.take_along_axis(all_gaps, order, 1), np.take_along_axis(all_rows, order, 1)

        def reachable(at: np.ndarray, gap: np.ndarray, span: tuple[float, float]) -> np.ndarray:
            outside = np.maximum(span[0] - gap, gap - span[1])
            return outside * relax <= best[at, -1] * (1 + 1e-12)

        def visit(node: Node, at: np.ndarray) -> None:
            if not len(at):
                return
            if node.point < 0:
                if len(node.rows):
                    offer(at, node.rows)
                return
            offer(at, np.array([node.point]))
            gap = distances(self.vectors[node.point], queries[at])
            first = gap <= (node.near[1] + node.far[0]) / 2
            for side, other in ((first, False), (~first, False), (first, True), (~first, True)):
                inner = (side is first) != other
                span, child = (node.near, node.inside) if inner else (node.far, node.outside)
                here = side & reachable(at, gap, span)
                visit(child, at[here])

        visit(self.root, np.arange(len(queries)))
        rows[np.isinf(best)] = -1
        return rows, best


def nearest(
    base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, relax: float = RELAX,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` for each row of ``queries``: query_id, rank, key, score.

    Nearness is Euclidean in double precision; a row is no neighbour of a query with its
    own key; ties go to the smaller key. Rows are dealt by a hash of the key to shards of
    bounded size, queries to blocks of bounded size; each pair of shard and block builds
    the shard's tree, searches it and sends k rows per query. ``relax`` above 1 prunes more
    than the triangle inequality allows. Null or zero vectors, and those with null or
    non-finite components, take no part, nor do null keys; vectors are compared with those
    of their own length only; with fewer than ``k`` candidates all are returned. Of usable rows
    with one key, the smallest vector counts.
    """
    clean = lambda df: df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    rows, asked = clean(base), clean(queries)
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // block_queries))
    deal = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n)).cast("int")
    left = rows.select("*", deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("*", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(part: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if part.num_rows and wanted.num_rows:
            tree = VPTree(_matrix(part), part["id"].to_numpy())
            own = wanted["id"].to_numpy()
            found, gaps = tree.search(_matrix(wanted), own, k, relax)
            q, r = np.nonzero(found >= 0)
            out.append((own[q], tree.ids[found[q, r]], gaps[q, r]))
        q, ids, gaps = (np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3))
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(gaps, pa.float64())})

    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _matrix(part: pa.Table) -> np.ndarray:
    flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(part.num_rows, -1)
