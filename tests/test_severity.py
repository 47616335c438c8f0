import pytest
from pyspark.sql import functions as F

from sheetdelta.functions import severity as V
from sheetdelta.functions.review import token_cost
from sheetdelta.operators import selection as S

# diff percent, zones, foreground percent, sparse, largest region -> level
CASES = [
    (0.0, 0, 1.5, False, None, "minor"), (0.0, 0, 8.0, False, None, "moderate"), (0.0, 0, 20.0, False, None, "major"),
    (0.0, 0, 50.0, True, 150.0, "minor"), (0.0, 0, 50.0, True, 12000.0, "major"),
    (0.0, 20, 0.0, False, 0.0, "moderate"), (0.0, 45, 0.0, False, 0.0, "major"), (0.0, 0, 0.0, False, 0.0, "unchanged"),
    (0.2, 0, None, False, None, "minor"), (2.0, 0, None, False, None, "moderate"), (6.0, 0, None, False, None, "major"),
    (0.021, 0, None, False, None, "unchanged"), (0.021, 16, None, False, None, "minor"),
]


def test_levels(spark):
    df = spark.createDataFrame(CASES, "d double, z long, fg double, sp boolean, rg double, want string")
    level = V.classify(F.col("d"), F.col("z"), F.col("fg"), F.col("sp"), F.col("rg"))
    assert [r.got for r in df.select(level.alias("got")).collect()] == [c[-1] for c in CASES]


def test_skip_reasons(spark):
    rows = [
        (1, 1, 1, "matched", "minor", 2.0, 3), (2, None, 1, "added", None, None, None), (3, 1, None, "removed", None, None, None),
        (4, 1, None, "matched", "minor", 2.0, 3), (5, 1, 1, "size_mismatch", "size_mismatch", None, None),
        (6, 1, 1, "matched", "unchanged", 0.0, 0), (7, 1, 1, "matched", "minor", 0.0, 0), (8, 1, 1, "matched", "major", 9.0, 5),
        (None, 1, 1, "matched", "major", 9.0, 5),
    ]
    details = spark.createDataFrame(rows, "seq long, a_page long, b_page long, status string, change_level string, diff_percent double, bboxes_count long").withColumn("run_id", F.lit(1))
    got = {r.seq: r.skip_reason for r in S.select_for_review(details, details.filter("seq = 8")).collect()}
    assert got == {
        1: None, 2: "added", 3: "removed", 4: "one_sided", 5: "not_matched", 6: "unchanged", 7: "no_diff", 8: "excluded",
    }


def test_token_cost(spark):
    df = spark.sql("select timestamp '2026-08-22 12:58:00' as at")
    cost = df.select(token_cost(F.lit(10000), F.lit(2000), F.lit(0), F.col("at")).alias("c")).select("c.*").first()
    assert cost.period == "off_peak"
    assert cost.direct_usd == pytest.approx(0.00352) and cost.effective_usd == pytest.approx(0.0037136)
