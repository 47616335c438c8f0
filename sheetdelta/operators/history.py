"""Run history: one view over both stores, positions, retention, revision chains, earlier runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetdelta import config as C
from sheetdelta.functions import records as H
from sheetdelta.functions import text as T
from sheetdelta.operators.ordered import Scan, running
from sheetdelta.session import cut as step


def normalize_records(records: DataFrame) -> DataFrame:
    """Raw rows of both stores in one shape; ``append_pos`` is their order in the store."""
    row = {c: F.col(c) for c in records.columns}
    source = F.col("source")
    name = F.coalesce(F.nullif("run_name", F.lit("")), H.base_name(F.col("run_dir")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return records.select(
        H.stable_id(source, row).alias("id"), "source", "append_pos", F.coalesce("ts", F.lit("")).alias("date"),
        H.normalize_result(F.col("result")).alias("result"), *[blank(c) for c in ("old_pdf", "new_pdf", "out_dir", "run_dir")],
        name.alias("run_name"), H.replay_settings(source, row).alias("replay"),
    )


def union_sources(ui: DataFrame | None, agent: DataFrame | None, only: str | None = None) -> DataFrame:
    """Records of both stores, or of one of them."""
    parts = [df for name, df in (("ui", ui), ("mcp", agent)) if df is not None and only in (None, name)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _newest_first() -> tuple[Column, list[Column]]:
    """Bucket and order for newest first; dates are ordered as text, ui before mcp, older appends first."""
    later = F.when(F.col("source") == "ui", 0).otherwise(1)
    # a prefix of the date text follows the order: one bucket per minute; undated runs are cut by their place
    undated = F.col("date") == ""
    bucket = F.struct(
        F.substring("date", 1, 16).alias("minute"), F.when(undated, -later).alias("store"),
        F.when(undated, F.floor(-F.col("append_pos") / 4096)).alias("block"),
    )
    return bucket, [F.col("date"), -later, -F.col("append_pos")]


def number_runs(runs: DataFrame) -> DataFrame:
    """Position of every run, newest first, over the whole list."""
    bucket, order = _newest_first()
    # the scan runs backwards: the newest date is number 1
    return running(runs, [], bucket, order, {"index": Scan(F.lit(1).cast("long"), reverse=True)})


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """Newest runs with their position over the full list; 0 keeps all."""
    if limit <= 0:
        return number_runs(runs)
    order = [c.desc() for c in _newest_first()[1]]
    # the first ``limit`` rows only
    top = Window.partitionBy(F.lit(1)).orderBy(*order)
    return runs.orderBy(*order).limit(limit).withColumn("index", F.row_number().over(top).cast("long"))


def find_run(runs: DataFrame, refs: DataFrame) -> DataFrame:
    """Run of every reference: an equal id first, else a position written ``#n`` or ``n``."""
    numbered = number_runs(runs)
    wanted = refs.select(F.trim("ref").alias("ref")).distinct().filter("ref <> ''")
    by_id = wanted.join(numbered.withColumn("ref", F.col("id")), "ref").withColumn("_way", F.lit(0))
    number = F.regexp_extract("ref", r"^#*\s*(\d+)$", 1).try_cast("long")
    by_place = wanted.withColumn("index", number).join(numbered, "index").withColumn("_way", F.lit(1))
    both = by_id.unionByName(by_place)
    best = F.min_by(F.struct("id", "index", "date", "result", "run_name"), F.struct("_way", "index"))
    return both.groupBy("ref").agg(best.alias("r")).select("ref", "r.*")


def retain_last(runs: DataFrame, cap: int = C.HISTORY_CAP) -> DataFrame:
    """The ``cap`` rows appended last in each store."""
    last = lambda store: runs.filter(F.col("source") == store).orderBy(F.col("append_pos").desc()).limit(cap)
    return last("ui").unionByName(last("mcp"))


def retained_jobs(jobs: DataFrame, now: Column, keep: int = C.RETAINED_JOBS, days: int = C.RETENTION_DAYS) -> DataFrame:
    """Active jobs, and of the others the ``keep`` newest that are younger than ``days``."""
    young = F.col("touched") >= now - F.expr(f"interval {days} days")
    idle = jobs.filter(~F.col("active") & young)
    day = F.to_date("touched")
    hours = F.floor(F.unix_timestamp("touched") / 3600)
    numbered = running(
        idle, [], F.struct(day.alias("d"), hours.alias("h")), [F.col("touched"), F.col("job_id")],
        {"_n": Scan(F.lit(1).cast("long"), reverse=True)},
    )
    return jobs.filter("active").unionByName(numbered.filter(F.col("_n") <= keep).drop("_n"))


def search_runs(runs: DataFrame, text: str = "", result: str = "all") -> DataFrame:
    """Runs whose paths contain ``text``; ``done`` also takes the word ok."""
    raw = F.upper(F.coalesce("result", F.lit("")))
    found = runs
    if result == "done":
        found = found.filter(raw.isin("DONE", "OK"))
    elif result == "cancelled":
        found = found.filter(raw == "CANCELLED")
    needle = text.strip().lower()
    if needle:
        paths = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("old_pdf", "new_pdf", "out_dir", "run_dir")])
        found = found.filter(F.lower(paths).contains(needle))
    return found


def revision_chain(catalog: DataFrame) -> DataFrame:
    """Documents of one base name in revision order, each with the one before it.

    Documents without a revision come first. The chain is a running maximum, so
    a base name with very many documents is not sorted in one task.
    """
    revision = T.extract_revision(F.col("name"))
    number = F.coalesce(F.regexp_extract(revision, r"(\d+)", 1).try_cast("long"), F.lit(-1))
    # the revision is cut off together with the separator before it
    tail = r"(?iuU)[-_ ]*(?:rev(?:ision)?|r|рев|ревизия|р)?[-_ ]*[A-Za-zА-Яа-я]?\d+[A-Za-zА-Яа-я]*$"
    base = F.when(revision.isNull(), F.col("name")).otherwise(F.regexp_replace("name", tail, ""))
    ranked = catalog.select("doc", "name", base.alias("base"), revision.alias("revision"), number.alias("number"))
    this = F.struct("number", "doc", "revision")
    chained = running(
        ranked, ["base"], F.struct(F.col("number"), F.floor(F.col("doc") / 4096).alias("d")),
        [F.col("number"), F.col("doc")], {"before": Scan(this, "max", inclusive=False)},
    )
    return chained.select(
        "base", "doc", "revision", F.col("before.doc").alias("previous_doc"), F.col("before.revision").alias("previous_revision")
    )


#: Texts of either side that share one piece and meet in one group; commoner pieces are dealt to several groups.
PIECE_BLOCK = 4096
#: Rows of both sides that a task holds at once.
GROUP_ROWS = 1 << 15
#: Pairs that are compared at once.
_PAIRS = 1 << 15


def _edits(length: Column, cut: float) -> Column:
    """Edits that a text of this length may be away from one not longer, at a ratio of ``cut``."""
    return F.floor((1 - cut) * F.greatest(length, F.lit(1)) + 1e-9).cast("int")


def _pieces(texts: DataFrame, cut: float) -> DataFrame:
    """(long, k, place, piece): each text cut into one piece more than the edits it allows, so one piece stays whole.

    The longer pieces come last. Place is the distance of the piece from the start of the text. ``size`` is
    the length that rules the edits.
    """
    k, length = _edits(F.col("size"), cut), F.length("text")
    sized = texts.select("text", "size", k.alias("k"), F.floor(length / (k + 1)).cast("int").alias("width"), (length % (k + 1)).cast("int").alias("wider"))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    before = F.greatest(F.col("i") - (F.col("k") + 1 - F.col("wider")), F.lit(0))
    placed = each.withColumn("place", (F.col("i") * F.col("width") + before).cast("int"))
    wide = F.col("width") + (F.col("i") >= F.col("k") + 1 - F.col("wider")).cast("int")
    return placed.select(F.col("text").alias("long"), "size", "k", "place", F.substring("text", F.col("place") + 1, wide).alias("piece"))


def _probes(texts: DataFrame, widths: list[int]) -> DataFrame:
    """(short, at, piece): every part of a text that is as wide as some piece."""

    def parts(width: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length("text") - width, F.lit(0)))
        return F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring("text", at + 1, F.lit(width)).alias("piece")))

    each = F.array_distinct(F.concat(*map(parts, widths)))
    return texts.select(F.col("text").alias("short"), "size", F.explode(each).alias("p")).select("short", "size", "p.at", "p.piece")


def _codes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one line each, and their lengths."""
    held = np.array(texts.to_pylist(), dtype=str)
    return held.view(np.uint32).reshape(len(held), -1), pc.utf8_length(texts).to_numpy()


def _letters(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which letters each text holds how often from place ``first`` to before ``last``, as bits.

    There are 16 classes, four bits each for the first four of a class. A letter that one text
    holds more often than another takes an edit, so bits that only one has bound the distance.
    """
    column = np.arange(codes.shape[1])
    at, place = np.nonzero((column >= first[:, None]) & (column < last[:, None]))
    counts = np.bincount(at * 16 + codes[at, place] % 16, minlength=len(codes) * 16).reshape(-1, 16)
    held = (np.uint64(1) << np.minimum(counts, 4).astype(np.uint64)) - np.uint64(1)
    return np.bitwise_or.reduce(held << (4 * np.arange(16, dtype=np.uint64)), axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edits that the letters of two texts take at least."""
    return np.maximum(np.bitwise_count(x & ~y), np.bitwise_count(y & ~x))


def _marks(codes: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Places of every letter in every text, as bits of words of 64: [text, letter, word]; the last letter stands nowhere."""
    found = np.zeros((len(codes), len(letters) + 1, max(1, -(-int(lengths.max()) // 64))), np.uint64)
    at, place = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None])
    np.bitwise_or.at(found, (at, np.searchsorted(letters, codes[at, place]), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return found


def _distances(marks: np.ndarray, own: np.ndarray, lengths: np.ndarray, letters: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Edit distance of text ``own`` of ``marks`` to the text of ``letters`` beside it, for all pairs at once.

    A column of the table of distances is kept as the bits of its steps up and down.
    """
    one, zero = np.uint64(1), np.uint64(0)
    n, words = len(own), marks.shape[2]
    up, down = np.full((words, n), ~zero), np.zeros((words, n), np.uint64)
    end, last = np.maximum(lengths[own] - 1, 0), np.uint64(63)
    end_word, end_bit = end // 64, (end % 64).astype(np.uint64)
    score = lengths[own].astype(np.int64)
    for t in range(int(others.max(initial=0))):
        live = t < others
        more, less = np.full(n, one), np.zeros(n, np.uint64)
        for w in range(words):
            equal = marks[own, letters[:, t], w]
            vertical = equal | down[w]
            equal = equal | less
            across = (((equal & up[w]) + up[w]) ^ up[w]) | equal
            rise, fall = down[w] | ~(across | up[w]), up[w] & across
            here = live if words == 1 else live & (end_word == w)
            step = ((rise >> end_bit) & one).astype(np.int64) - ((fall >> end_bit) & one).astype(np.int64)
            score += np.where(here, step, 0)
            rise, more = (rise << one) | more, rise >> last
            fall, less = (fall << one) | less, fall >> last
            up[w], down[w] = fall | ~(vertical | rise), rise & vertical
    return score


def _close(a: pa.Table, b: pa.Table, equal: bool) -> pa.Table:
    """(long, short): texts that meet on a piece and are near enough; ``equal`` also takes those of one size."""
    none = pa.table({"long": pa.array([], pa.string()), "short": pa.array([], pa.string())})
    if not a.num_rows or not b.num_rows:
        return none
    b = b.sort_by([("meet", "ascending"), ("at", "ascending")])
    (long, long_size), (short, short_size) = _codes(a["long"]), _codes(b["short"])
    k, place, wide, at, broad = (t[c].to_numpy().astype(np.int32) for t, c in ((a, "k"), (a, "place"), (a, "wide"), (b, "at"), (b, "wide")))
    before = _letters(long, 0 * place, place), _letters(short, 0 * at, at)
    after = _letters(long, place + wide, long_size), _letters(short, at + broad, short_size)
    # letters by their rank; those of no long text come after them
    letters = np.unique(long[np.arange(long.shape[1]) < long_size[:, None]])
    marks = _marks(long, long_size, letters)
    rank = np.minimum(np.searchsorted(letters, short), max(len(letters) - 1, 0))
    ranked = np.where(letters[rank] == short, rank, len(letters)) if len(letters) else np.zeros_like(rank)
    # a piece is moved by at most k places
    groups, held = np.unique(b["meet"].to_numpy(), return_inverse=True)
    span = int(max(at.max(), (place + k).max())) + 2
    held = held * span + at
    asked = np.minimum(np.searchsorted(groups, a["meet"].to_numpy()), len(groups) - 1)
    known = groups[asked] == a["meet"].to_numpy()
    low = np.searchsorted(held, asked * span + np.maximum(place - k, 0), "left")
    counts = np.where(known, np.searchsorted(held, asked * span + place + k, "right") - low, 0)
    long_rank, short_rank = a["size"].to_numpy(), b["size"].to_numpy()
    until = np.cumsum(counts)
    met, start = [], 0
    while start < len(counts):
        done = until[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(until, done + 8 * _PAIRS, "right")))
        some = counts[start:stop]
        i = np.repeat(np.arange(start, stop), some)
        j = np.arange(len(i)) + np.repeat(low[start:stop] - (until[start:stop] - some - done), some)
        start = stop
        moved, apart = at[j] - place[i], short_size[j] - long_size[i]
        ranked_so = short_rank[j] <= long_rank[i] if equal else short_rank[j] < long_rank[i]
        near = (np.abs(moved) + np.abs(apart - moved) <= k[i]) & ranked_so
        i, j = i[near], j[near]
        likely = _apart(before[0][i], before[1][j]) + _apart(after[0][i], after[1][j]) <= k[i]
        i, j = i[likely], j[likely]
        for part in range(0, len(i), _PAIRS):
            x, y = i[part:part + _PAIRS], j[part:part + _PAIRS]
            fits = _distances(marks, x, long_size, ranked[y], short_size[y]) <= k[x]
            met.append((x[fits], y[fits]))
    if not met:
        return none
    i, j = (np.concatenate(side) for side in zip(*met))
    return pa.table({"long": a["long"].take(pa.array(i)).cast(pa.string()), "short": b["short"].take(pa.array(j)).cast(pa.string())})


def _near_texts(left: DataFrame, right: DataFrame, cut: float) -> DataFrame:
    """(left, right): pairs of texts (text, size) whose edit distance is at most what the larger size allows.

    The text of larger size of a pair with at most k edits is cut
    into k + 1 pieces; one of them stands in the other text, moved by at most the edits before it,
    while those after it make up the rest of the difference in length. Texts meet on equal
    pieces; letters that only one holds, before and after the piece, rule most pairs out, and the distances of
    the others are taken there for many pairs at once, so only similar pairs leave the task. A piece that
    many texts hold is dealt to several groups, on both sides.
    """
    block = PIECE_BLOCK

    def one_way(longer: DataFrame, shorter: DataFrame, equal: bool) -> DataFrame:
        spark = longer.sparkSession
        pieces = _pieces(longer, cut)
        widths = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]  # at most 1 / (1 - cut) + 1 values
        if not widths:
            widths = [0]
        probes = _probes(shorter, sorted(widths))
        counts = pieces.select("piece", F.lit(1).alias("long"), F.lit(0).alias("short")).unionByName(probes.select("piece", F.lit(0).alias("long"), F.lit(1).alias("short")))
        counts = counts.groupBy("piece").agg(F.sum("long").alias("n"), F.sum("short").alias("m")).filter("n > 0 and m > 0")     # pieces that both sides hold
        groups = step(counts.withColumns({"rows": F.ceil(F.col("n") / block).cast("int"), "cols": F.ceil(F.col("m") / block).cast("int")}))
        total = groups.agg(F.sum(F.col("n") * F.col("cols") + F.col("m") * F.col("rows"))).first()[0] or 0
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda text, n: F.pmod(F.xxhash64(text), F.col(n)).cast("int")
        dealt = pieces.join(groups, "piece").withColumn("row", own("long", "rows")).withColumn("col", every("cols"))
        asked = probes.join(groups, "piece").withColumn("col", own("short", "cols")).withColumn("row", every("rows"))
        # a task takes many pieces at once, as many as their rows allow
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(tasks, total // GROUP_ROWS + 1)

        def side(df: DataFrame, *columns: str) -> DataFrame:
            met = df.select(*columns, "size", F.length("piece").alias("wide"), F.xxhash64("piece", "row", "col").alias("meet"))
            return met.withColumn("part", F.pmod("meet", F.lit(parts))).repartition(tasks, "part").groupBy("part")

        def close(a: pa.Table, b: pa.Table) -> pa.Table:
            return _close(a, b, equal)

        return side(dealt, "long", "k", "place").cogroup(side(asked, "short", "at")).applyInArrow(close, "long string, short string").distinct()

    # a small table of texts is cut for all tasks as well
    left, right = (step(texts.select("text", "size").repartition(texts.sparkSession.sparkContext.defaultParallelism)) for texts in (left, right))
    found = one_way(left, right, True).select(F.col("long").alias("left"), F.col("short").alias("right"))
    low, high = left.agg(F.min("size")).first()[0], right.agg(F.max("size")).first()[0]
    if low is None or high is None or high <= low:
        return found        # no text on the right is larger
    return found.unionByName(one_way(right, left, False).select(F.col("short").alias("left"), F.col("long").alias("right")))


#: Texts that differ in digits and signs only are compared as one, if there are at most so many of them.
FOLD_TEXTS = 256
#: Pairs of texts per pair of folds from which on folding pays.
FOLD_GAIN = 16


def similar_texts(left: DataFrame, right: DataFrame, cut: float = C.SIMILAR_RUN_CUT) -> DataFrame:
    """(left, right, ratio): pairs of texts whose edit distance is at most 1 - ``cut`` of the longer one.

    Both tables hold a column ``text``, distinct. Leaving out digits and signs from two texts never makes their
    distance larger, so names that differ in numbers only are folded into their letters, and folds that are near
    enough for their longest texts are compared text by text. Folds of very many texts, and all texts where
    folding brings little together, are compared as they are.
    """
    fold = F.regexp_replace("text", r"[^\p{L}]+", "")
    sides = [step(texts.select("text", F.length("text").alias("size"), fold.alias("fold"))) for texts in (left, right)]
    folds = step(sides[0].withColumn("on_left", F.lit(1)).unionByName(sides[1].withColumn("on_left", F.lit(0))).groupBy("fold").agg(
        F.sum("on_left").alias("n"), F.sum(1 - F.col("on_left")).alias("m"), F.max("size").alias("size")))
    n, m, n_folds, m_folds = folds.agg(F.sum("n"), F.sum("m"), F.count_if(F.col("n") > 0), F.count_if(F.col("m") > 0)).first()
    whole = [side.select("text", "size") for side in sides]
    if not n or not m or n * m < FOLD_GAIN * n_folds * m_folds:
        pairs = _near_texts(*whole, cut)
    else:
        small = folds.filter((F.col("n") + F.col("m") <= FOLD_TEXTS) & (F.length("fold") * 3 >= F.col("size") * 2))
        folded = _near_texts(*(small.filter(F.col(c) > 0).select(F.col("fold").alias("text"), "size") for c in ("n", "m")), cut).toDF("fold", "other")
        # at most FOLD_TEXTS texts a fold, so pairs of folds are dealt to all tasks before their texts are paired
        members = [side.join(small.select("fold"), "fold").groupBy("fold").agg(F.collect_list("text").alias(name)) for side, name in zip(sides, ("lefts", "rights"))]
        folded = folded.join(members[0], "fold").drop("fold").join(members[1].withColumnRenamed("fold", "other"), "other").drop("other")
        tasks = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = folded.repartition(tasks).select(F.explode("lefts").alias("left"), "rights").select("left", F.explode("rights").alias("right"))
        large = step(folds.join(small, "fold", "left_anti").select("fold"))
        if not large.isEmpty():
            apart = [side.join(large, "fold", "left_semi").select("text", "size") for side in sides]
            rest = sides[0].join(large, "fold", "left_anti").select("text", "size")
            pairs = pairs.unionByName(_near_texts(apart[0], whole[1], cut)).unionByName(_near_texts(rest, apart[1], cut))
    width = F.greatest(F.length("left"), F.length("right"), F.lit(1))
    # a filter on a plain column would take every distance twice
    scored = pairs.select(F.explode(F.array(F.struct("left", "right", (1.0 - F.levenshtein("left", "right") / width).alias("ratio")))).alias("p"))
    return scored.select("p.*").filter(F.col("ratio") >= cut)


def match_existing_runs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Earlier runs of a file pair, ranked by how they match.

    ``pairs`` holds pair_id, old_path and new_path, ``runs`` run_id, created_at,
    file_a and file_b. Equal paths and equal names are equality joins. Similar
    names are compared once for each distinct text, by an index of pieces for the edit distance. Runs of the same
    files are compared once and come in at the end.
    """
    stem = lambda c: F.regexp_replace(H.base_name(c), r"\.[^.]*$", "")
    asked = step(pairs.select(
        "pair_id", *[F.lower(F.regexp_replace(p, r"\\", "/")).alias(f"{n}_path") for n, p in (("old", "old_path"), ("new", "new_path"))],
        *[F.lower(H.base_name(F.col(p))).alias(f"{n}_name") for n, p in (("old", "old_path"), ("new", "new_path"))],
        F.lower(F.concat_ws(" ", stem(F.col("old_path")), stem(F.col("new_path")))).alias("asked_stems"),
    ))
    # written, so a number stays that of its files
    files = step(runs.select("file_a", "file_b").distinct().withColumn("files", F.monotonically_increasing_id()))
    known = step(files.select(
        "files", *[F.lower(F.regexp_replace(p, r"\\", "/")).alias(f"{n}_path") for n, p in (("a", "file_a"), ("b", "file_b"))],
        *[F.lower(H.base_name(F.col(p))).alias(f"{n}_name") for n, p in (("a", "file_a"), ("b", "file_b"))],
        F.lower(F.concat_ws(" ", stem(F.col("file_a")), stem(F.col("file_b")))).alias("stems"),
        F.lower(F.concat_ws(" ", stem(F.col("file_b")), stem(F.col("file_a")))).alias("stems_reversed"),
    ))
    same_files = runs["file_a"].eqNullSafe(files["file_a"]) & runs["file_b"].eqNullSafe(files["file_b"])
    run = step(runs.join(files, same_files).select("files", "run_id", "created_at"))

    def equal(kind: str, reverse: bool, score: float, reason: str) -> DataFrame:
        left, right = ("b", "a") if reverse else ("a", "b")
        on = (asked[f"old_{kind}"] == known[f"{left}_{kind}"]) & (asked[f"new_{kind}"] == known[f"{right}_{kind}"])
        return asked.join(known, on).select("pair_id", "files", F.lit(score).alias("similarity"), F.lit(reason).alias("reason"))

    named = equal("path", False, 1.0, "exact_paths")
    for args in (("path", True, 0.98, "exact_paths_reversed"), ("name", False, 0.95, "exact_file_names"), ("name", True, 0.93, "exact_file_names_reversed")):
        named = named.unionByName(equal(*args))
    named = step(named.groupBy("pair_id", "files").agg(F.max(F.struct("similarity", "reason")).alias("m")).select("pair_id", "files", "m.*"))

    # each distinct text once; a run is also compared with its names the other way round
    mine = asked.select("asked_stems").distinct()
    theirs = known.select("stems", "stems_reversed").distinct()
    turned = theirs.select(F.explode(F.array("stems", "stems_reversed")).alias("text"))
    close = similar_texts(mine.select(F.col("asked_stems").alias("text")), turned.distinct()).toDF("asked_stems", "other", "ratio")
    either = theirs.select("stems", "stems_reversed", F.explode(F.array_distinct(F.array("stems", "stems_reversed"))).alias("other"))
    ratio = close.join(either, "other").groupBy("asked_stems", "stems", "stems_reversed").agg(F.max("ratio").alias("ratio"))
    alike = asked.join(ratio, "asked_stems").join(known, ["stems", "stems_reversed"]).select("pair_id", "files", "ratio")
    # equal paths and names come first, whatever the similarity; a similar name names a run once
    alike = alike.join(named.select("pair_id", "files", F.lit(True).alias("named")), ["pair_id", "files"], "left")
    fuzzy = alike.join(run, "files").filter("named is null or run_id is null").select(
        "pair_id", "run_id", "created_at", F.col("ratio").alias("similarity"), F.lit("similar_file_names").alias("reason")
    )
    keys = ["pair_id", "run_id", "created_at"]
    exact = named.join(run, "files").groupBy(*keys).agg(F.max(F.struct("similarity", "reason")).alias("m")).select(*keys, "m.*")
    # runs of one number may have other files
    doubled = run.groupBy("run_id").agg(F.min("files").alias("low"), F.max("files").alias("high")).filter("low < high").select("run_id")
    taken = step(named.join(run.join(step(doubled), "run_id"), "files").select("pair_id", "run_id").distinct())
    return exact.unionByName(fuzzy.join(taken, ["pair_id", "run_id"], "left_anti").select(exact.columns))


def similar_runs(matches: DataFrame, limit: int = 10) -> DataFrame:
    """Best matches per pair by similarity, then by creation text.

    Every task keeps the first ``limit`` of a pair before they meet, so no task sorts all matches of a large one.
    """
    enough = matches.filter(F.col("similarity") >= C.SIMILAR_RUN_CUT)
    order = [F.col(c).desc() for c in ("similarity", "created_at", "run_id")]
    ranked = enough.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order)))
    return ranked.filter(F.col("place") <= limit).withColumn("place", F.col("place").cast("long"))


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.coalesce("created_at", "started_at").desc(), F.col("job_id"))

