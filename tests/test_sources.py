import json
import os
import random

import pytest

from sheetdelta.operators import history as O
from sheetdelta.sources import readers, writers


def test_run_summaries_prefer_the_inner_folder(spark, tmp_path):
    def put(path, body):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)

    put(tmp_path / "one" / "_internal" / "summary.json", json.dumps({"file_a": "new", "pairs": [{"seq": 1, "status": "matched"}, {"seq": 2, "status": "added"}]}, indent=1))
    put(tmp_path / "one" / "summary.json", json.dumps({"file_a": "old", "pairs": []}))
    put(tmp_path / "two" / "summary.json", json.dumps({"file_a": "only", "pairs": {"not": "a list"}}))
    put(tmp_path / "bad" / "summary.json", "{oops")
    read = readers.read_run_summaries(spark, str(tmp_path)).cache()
    assert sorted((r.run_dir.rsplit("/", 1)[-1], r.file_a) for r in read.collect()) == [("one", "new"), ("two", "only")]
    assert sorted(r.seq for r in readers.explode_pairs(read).collect()) == [1, 2]


def test_history_round_trip(spark, tmp_path):
    (tmp_path / "ui.json").write_text(json.dumps({"history": [{"ts": "2024-01-02", "result": "ok", "run_dir": "x/run1"}, 5, {"ts": "2024-01-01", "result": "error"}]}))
    (tmp_path / "agent.json").write_text(json.dumps({"history": [{"ts": "2024-01-03", "result": "completed", "job_id": "j7"}]}))
    (tmp_path / "broken.json").write_text("{")
    raw = readers.read_history(spark, str(tmp_path / "ui.json"), str(tmp_path / "agent.json"))
    listed = O.latest_runs(O.normalize_records(raw), 0).orderBy("index").collect()
    assert [(r["index"], r.result, r.source) for r in listed] == [(1, "done", "mcp"), (2, "done", "ui"), (3, "failed", "ui")]
    assert listed[0].id == "mcp:j7" and listed[1].run_name == "run1"
    refs = spark.createDataFrame([("#2",), ("mcp:j7",), ("9",)], "ref string")
    found = {r.ref: r["index"] for r in O.find_run(O.normalize_records(raw), refs).collect()}
    assert found == {"#2": 2, "mcp:j7": 1}
    assert readers.read_history(spark, str(tmp_path / "broken.json"), None).count() == 0


def test_page_map_file_and_replaced_rows(spark, tmp_path):
    details = spark.createDataFrame([(1, 2, "matched", 0.5), (1, 1, "added", None), (2, 1, "matched", 0.1)], "run_id long, seq long, status string, diff_percent double")
    writers.write_page_map(details, str(tmp_path / "csv"))
    lines = [p.read_text().splitlines() for p in (tmp_path / "csv" / "run_id=1").glob("*.csv")]
    assert all(l[0].startswith("seq,a_page,b_page,status") and len(l[0].split(",")) == 30 for l in lines)
    path = str(tmp_path / "details")
    details.write.partitionBy("run_id").parquet(path)
    updates = spark.createDataFrame([(1, 2, "matched", 9.0)], details.schema)
    for _ in range(2):   # the second time changes nothing
        writers.write_replaced(spark.read.parquet(path).select(*details.columns), updates, path)
        rows = sorted((r.run_id, r.seq, r.diff_percent) for r in spark.read.parquet(path).collect())
        assert rows == [(1, 1, None), (1, 2, 9.0), (2, 1, 0.1)]


def test_similar_names_and_exact_names(spark):
    runs = spark.createDataFrame(
        [(1, "2024", "x/bridge_R1.pdf", "x/bridge_R2.pdf"), (2, "2025", "y/bridge_R2.pdf", "y/bridge_R1.pdf"), (3, "2023", "z/bridge_R1.pdf", "z/bridge_R3.pdf"), (4, "2023", "q/tower.pdf", "q/other.pdf")],
        "run_id long, created_at string, file_a string, file_b string",
    )
    pairs = spark.createDataFrame([(9, "x/bridge_R1.pdf", "x/bridge_R2.pdf")], "pair_id long, old_path string, new_path string")
    got = {r.run_id: r.reason for r in O.match_existing_runs(pairs, runs).collect()}
    assert got == {1: "exact_paths", 2: "exact_file_names_reversed", 3: "similar_file_names"}
    best = O.similar_runs(O.match_existing_runs(pairs, runs), 2).orderBy("place").select("run_id").collect()
    assert [r.run_id for r in best] == [1, 3]   # one letter apart is closer than reversed names


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_texts_equal_brute_force_at_every_length(spark, monkeypatch):
    monkeypatch.setattr(O, "PIECE_BLOCK", 3)
    draw, texts = random.Random(5), {"", "a", "ab", "7", "é"}
    while len(texts) < 120:
        base = draw.choice(sorted(texts, key=lambda t: (len(t), t))[-40:]) if draw.random() < 0.7 else "".join(draw.choice("ab_r1 ") for _ in range(draw.randrange(34)))
        own = list(base)
        for _ in range(draw.randrange(8)):
            at = draw.randrange(len(own) + 1)
            own[at : at + draw.randrange(2)] = draw.choice(["", "a", "b", "zz", "1"])
        texts.add("".join(own)[:45])
    asked, known = sorted(texts)[::2], sorted(texts)[1::2] + sorted(texts)[::10]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string").distinct()
    found = {(r.left, r.right): r.ratio for r in O.similar_texts(frame(asked), frame(known)).collect()}
    want = {}
    for a in set(asked):
        for b in set(known):
            ratio = 1.0 - brute_distance(a, b) / max(len(a), len(b), 1)
            if ratio >= 0.72:
                want[a, b] = ratio
    assert found == want and len(want) > 100


@pytest.mark.parametrize("most, gain, folds", [(1000, 0, True), (4, 0, True), (1000, 10_000, False)])
def test_names_that_differ_in_numbers_are_compared_as_one(spark, monkeypatch, most, gain, folds):
    monkeypatch.setattr(O, "FOLD_TEXTS", most)     # larger folds are compared as they are
    monkeypatch.setattr(O, "FOLD_GAIN", gain)
    seen, near = [], O._near_texts
    monkeypatch.setattr(O, "_near_texts", lambda a, b, cut: seen.append(a.count()) or near(a, b, cut))
    draw = random.Random(7)
    stems = ["bridge", "bridges", "tower", "towel", "Ñandú", "abridged tow", "x"]
    texts = sorted({f"{draw.choice(stems)}_R{draw.randrange(12)} {draw.choice(stems)}-{draw.randrange(3)}" for _ in range(150)} | {"20240101", "20240102", "2024", "", "_"})
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    found = [(r.left, r.right, r.ratio) for r in O.similar_texts(frame(texts[::2]), frame(texts[::3])).collect()]
    ratio = lambda a, b: 1.0 - brute_distance(a, b) / max(len(a), len(b), 1)
    want = {(a, b, ratio(a, b)) for a in texts[::2] for b in texts[::3] if ratio(a, b) >= 0.72}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 150
    assert (seen[0] < len(texts[::2])) is folds and len(seen) == (3 if folds else 1)


def test_runs_of_the_same_files_come_in_at_the_end(spark):
    runs = spark.createDataFrame(
        [(1, "2024", "x/bridge_R1.pdf", "x/bridge_R2.pdf"), (1, "2024", "x/bridge_R1.pdf", "x/bridge_R2.pdf"), (1, "2025", "x/bridge_R1.pdf", "x/bridge_R4.pdf"),
         (2, "2024", "x/bridge_R3.pdf", "x/bridge_R2.pdf"), (2, "2024", "x/bridge_R3.pdf", "x/bridge_R2.pdf"), (None, "2024", "x/bridge_R1.pdf", "x/bridge_R2.pdf"), (3, None, None, None)],
        "run_id long, created_at string, file_a string, file_b string",
    )
    pairs = spark.createDataFrame([(9, "x/bridge_R1.pdf", "x/bridge_R2.pdf"), (8, None, None)], "pair_id long, old_path string, new_path string")
    found = O.match_existing_runs(pairs, runs)
    got = sorted((r.pair_id, r.run_id or 0, r.reason) for r in found.collect())
    # an exact match comes once and hides similar names of the same number; a run without a number hides nothing
    assert got == [(8, 3, "exact_file_names"), (9, 0, "exact_paths"), (9, 0, "similar_file_names"), (9, 1, "exact_paths"), (9, 2, "similar_file_names"), (9, 2, "similar_file_names")]
    best = O.similar_runs(found, 2)
    assert sorted((r.pair_id, r.place) for r in best.collect()) == [(8, 1), (9, 1), (9, 2)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()     # tasks keep the first ones before the shuffle


def test_stale_jobs_of_a_stream_share_the_states_of_a_few_groups(spark, tmp_path):
    from sheetdelta.streaming import jobs as J

    kinds = "job_id string, at timestamp, event_id long, state string"
    steps = [
        [("a", 0, 1, "running"), ("b", 0, 2, "queued"), ("c", 5, 3, "completed"), ("d", 5, 4, "running"), (None, 1, 5, "running"), ("g", 5, 6, "running")],
        [("d", 300, 7, "running"), ("a", -100, 8, "running")],       # an older event counts, but sets no timer
        [("d", 1000, 9, "running"), ("e", 1000, 10, "running")],     # g is given up here and comes again
        [("f", 4000, 11, "completed"), ("g", 3800, 12, "running")],
    ]
    for number, rows in enumerate(steps):
        table = spark.createDataFrame([(j, 600_000 + m * 60, e, s) for j, m, e, s in rows], "job_id string, sec long, event_id long, state string")
        table.selectExpr("job_id", "timestamp_seconds(sec) as at", "event_id", "state").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for path in (tmp_path / "in").glob("*.parquet"):
            if path.stat().st_mtime > 10_000:
                os.utime(path, (100 * number + 100, 100 * number + 100))
    events = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = J.stream_stale_jobs(events, 7200, 14400).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    stream = writer.format("parquet").start(str(tmp_path / "out"))
    stream.awaitTermination()
    found = sorted((r.job_id or "", r.last_state, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("", "running", 1), ("a", "running", 2), ("b", "queued", 1), ("d", "running", 3), ("e", "running", 1), ("g", "running", 1), ("g", "running", 1)]
    many = spark.range(500).selectExpr("cast(id as string) as job_id", "timestamp_seconds(id) as at", "id as event_id", "'running' as state")
    many.write.parquet(str(tmp_path / "many"))
    events = spark.readStream.schema(kinds).parquet(str(tmp_path / "many"))
    stream = J.stream_stale_jobs(events, groups=3).writeStream.trigger(availableNow=True).format("memory").queryName("many_jobs").option(
        "checkpointLocation", str(tmp_path / "many-state")).start()
    stream.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) <= 3


def test_distances_of_many_pairs_equal_brute_force_beyond_one_word(spark):
    import numpy as np
    import pyarrow as pa

    draw = random.Random(3)
    for longest in (3, 31, 64, 65, 130):
        own, other = ([""] * side + ["".join(draw.choice("abж_") for _ in range(draw.randrange(1, longest + 1))) for _ in range(12)] for side in (0, 1))
        (codes, sizes), (others, lengths) = (O._codes(pa.chunked_array([texts])) for texts in (own, other))
        letters = np.unique(codes[np.arange(codes.shape[1]) < sizes[:, None]])
        rank = np.minimum(np.searchsorted(letters, others), len(letters) - 1)
        ranked = np.where(letters[rank] == others, rank, len(letters))
        i, j = (side.ravel() for side in np.meshgrid(np.arange(len(own)), np.arange(len(other))))
        found = O._distances(O._marks(codes, sizes, letters), i, sizes, ranked[j], lengths[j])
        assert found.tolist() == [brute_distance(own[x], other[y]) for x, y in zip(i, j)]
