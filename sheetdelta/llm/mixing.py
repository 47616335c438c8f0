"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetdelta.session import cut

# Fixed value: what separates words.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Passes over a document at most.
REPEATS = 3
#: Membership patterns the driver routes at most; more is an error, never a cut.
MOST_PATTERNS = 50_000
#: Rows of a stretch of the seeded order that one task sums up.
STRETCH = 50_000


def cycling_weights(names: Sequence[str | None], cycle: Sequence[float] = (5, 2, 1)) -> dict[str | None, float]:
    """Weights repeating over the sources in code point order, null last."""
    ordered = sorted(names, key=lambda n: (n is None, n or ""))
    return {name: cycle[i % len(cycle)] for i, name in enumerate(ordered)}


def share_out(total: float, sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int) -> dict[str | None, float]:
    """Targets by weight; a target above ``repeats`` sizes stops there and its excess is shared anew."""
    targets = {name: 0.0 for name in sizes}
    free, left = set(sizes), float(total)
    while free:
        scale = sum(weights[n] for n in free)
        if scale <= 0:
            break
        full = {n for n in free if left * weights[n] / scale > repeats * sizes[n]}
        if not full:
            targets |= {n: left * weights[n] / scale for n in free}
            break
        targets |= {n: float(repeats * sizes[n]) for n in full}
        left -= sum(targets[n] for n in full)
        free -= full
    return targets


def route(capacity: list[int], quotas: list[int], member: list[list[int]], repeats: int) -> list[dict[int, int]]:
    """Tokens from each pattern to each source's quota, cheapest repetition first.

    Every pass over a pattern is an arc of its capacity; the r-th pass costs r, so costs
    are convex and rare patterns are repeated only when quotas can't be met otherwise.
    Successive shortest paths with label correction over the residual arcs.
    """
    p, n = len(capacity), len(capacity) + len(quotas) + 2
    start, end = n - 2, n - 1
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, most: int, price: int) -> None:
        for x, y, c, w in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(head))
            head.append(y)
            room.append(c)
            cost.append(w)

    for k, size in enumerate(capacity):
        for turn in range(1, repeats + 1):
            arc(start, k, size, turn)
        for s in member[k]:
            arc(k, p + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        arc(p + s, end, quota, 0)
    while True:
        far = [1 << 60] * n
        via = [-1] * n
        far[start], queue = 0, [start]
        while queue:
            later = []
            for a in queue:
                for e in out[a]:
                    if room[e] and far[a] + cost[e] < far[head[e]]:
                        far[head[e]], via[head[e]] = far[a] + cost[e], e
                        later.append(head[e])
            queue = list(dict.fromkeys(later))
        if via[end] < 0:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = head[via[at] ^ 1]
        much = min(room[e] for e in path)
        for e in path:
            room[e] -= much
            room[e ^ 1] += much
    return [{head[e] - p: room[e ^ 1] for e in out[k] if not e & 1 and head[e] != start and room[e ^ 1]} for k in range(p)]


def mix(
    docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text", seed: int = 42, repeats: int = REPEATS,
    weigh: Callable[[Sequence[str | None]], dict[str | None, float]] = cycling_weights, keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document.

    ``members`` is the array of sources a document belongs to; null names a source of its
    own and an empty or null array belongs to none. Returns, per input row, key, the columns
    in ``keep``, members, size (words; 0 for null or empty texts), sources (array of name,
    size, target), copies (0 to ``repeats``) and taken (copies x size). Rows are
    aggregated by membership pattern, pattern capacity is routed to the source quotas, and
    documents are drawn in a seeded order until the routed tokens of their pattern are met,
    so a pattern misses its tokens by half a document at most. Repeated rows are documents of
    their own with equal seeds; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>"))))
    wide = docs.select(
        key, *keep, names.alias("members"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
    ).withColumn("pattern", F.to_json("members"))
    wide = wide.withColumn("turn", F.xxhash64(F.lit(seed), F.col(key), "pattern"))
    sized = cut(wide)
    # one row per combination of sources
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns; merge sources first")
    member_names = [json.loads(row.pattern) for row in rows]
    sizes: dict[str | None, int] = {}
    for row, own in zip(rows, member_names):
        for name in own:
            sizes[name] = sizes.get(name, 0) + row.size
    total = sum(row.size for row, own in zip(rows, member_names) if own)
    targets = share_out(total, sizes, weigh(list(sizes)), repeats)
    order = list(sizes)
    at = {name: i for i, name in enumerate(order)}
    flows = route([row["size"] for row in rows], [round(targets[n]) for n in order], [[at[n] for n in own] for own in member_names], repeats)
    facts = [
        (
            row.pattern, int(row["size"]), int(sum(flow.values())), max(1, -(-row.n // STRETCH)),
            [(n, int(sizes[n]), float(targets[n])) for n in own],
        )
        for row, own, flow in zip(rows, member_names, flows)
    ]
    patterns = spark.createDataFrame(
        facts, "pattern string, pattern_size long, tokens long, stretches long, sources array<struct<name:string,size:long,target:double>>",
    )
    dealt = sized.join(F.broadcast(patterns), "pattern").withColumn("stretch", F.expr("pmod(shiftright(turn, 16), stretches)"))
    # the seeded order is by stretch, then by turn within it
    from pyspark.sql import Window as W

    parts = dealt.groupBy("pattern", "stretch").agg(F.sum("size").alias("part"))
    before = parts.select(
        "pattern", "stretch",
        (F.sum("part").over(W.partitionBy("pattern").orderBy("stretch")) - F.col("part")).alias("before"),
    )
    inner = W.partitionBy("pattern", "stretch").orderBy("turn", key, "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("own", F.sum("size").over(inner) - F.col("size")).join(before, ["pattern", "stretch"])
    middle = F.col("before") + F.col("own") + F.col("size") / 2
    copies = F.when(
        F.col("pattern_size") > 0, F.greatest(F.lit(0), F.ceil((F.col("tokens") - middle) / F.col("pattern_size")))
    ).otherwise(0)
    copies = F.least(F.lit(repeats), copies).cast("int")
    return placed.select(key, *keep, "members", "size", "sources", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def mixed_rows(docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows with a null key are not drawn.

    Rows that share a key share the largest number of copies that one of them got.
    """
    chosen = mix(docs, members, key, text, seed).filter(F.col("copies") > 0)
    chosen = chosen.groupBy(F.col(key).alias("_drawn")).agg(F.max("copies").alias("_copies"))
    joined = docs.join(chosen, docs[key] == chosen["_drawn"])
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
