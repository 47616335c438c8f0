import random

from pyspark.sql import functions as F

from sheetdelta.operators.ranges import range_text, seq_ranges


def test_ranges_over_block_borders_equal_the_numbers(spark):
    rnd = random.Random(2)
    groups = {g: {k for k in range(-5, 200) if rnd.random() < share} for g, share in (("a", 0.1), ("b", 0.6), ("c", 0.95), ("d", 1.0))}
    rows = [(g, k) for g, own in groups.items() for k in own for _ in range(rnd.randrange(1, 3))] + [("a", None), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, seq long")
    for block in (1, 8, 64, 4096):
        found = seq_ranges(frame, ["g"], block=block).collect()
        for g, own in groups.items():
            mine = sorted((r.first, r.last) for r in found if r.g == g)
            assert sorted(k for a, b in mine for k in range(a, b + 1)) == sorted(own)
            assert all(b + 1 < c for (_, b), (c, _) in zip(mine, mine[1:]))
        assert not [r for r in found if r.g == "e"]


def test_a_run_without_gaps_is_one_row_however_long(spark):
    frame = spark.range(300_000).select(F.lit(1).alias("g"), F.col("id").alias("seq"))
    assert [tuple(r) for r in seq_ranges(frame, ["g"]).select("first", "last", range_text(F.col("first"), F.col("last"))).collect()] == [(0, 299_999, "0-299999")]
