from datetime import datetime

from vitrine.operators import ranking, runs as R


def at(month, day=1):
    return datetime(2026, month, day)


def test_since_last_uses_the_newest_run_that_has_the_check(spark):
    rows = [("s", "jan", at(1), "ai_search", "COMPLETE", True, (None, 0.0, 0.0)), ("s", "feb", at(2), "ai_search", "UNKNOWN", True, (9.0, 9.0, 9.0)),
            ("s", "mar", at(3), "ai_search", "COMPLETE", True, (2.0, .5, 1.0)), ("s", "jan", at(1), "google_business", "OBSERVED", False, (1.0, 1.0, 1.0)),
            ("s", "mar", at(3), "google_business", "OBSERVED", True, (1.0, 1.0, 1.0))]
    checks = spark.createDataFrame(rows, "site string, run_id string, created_at timestamp, name string, status string, found boolean, "
                                         "data struct<rank:double,mention_rate:double,own:double>")
    got = {r.metric: (r.earlier_run, r.before, r.after, r.trend) for r in R.check_diff(R.since_last(checks), {"rank": False, "mention_rate": True, "own": True}).collect()}
    assert got == {"rank": ("jan", None, 2.0, None), "mention_rate": ("jan", 0.0, .5, "better"), "own": ("jan", 0.0, 1.0, "better")}


def test_metric_trend_gap_delta_and_missing(spark):
    runs = spark.createDataFrame([("s", m, at(i)) for i, m in ((7, "jul"), (8, "aug"), (9, "sep"))], "site string, run_id string, created_at timestamp")
    metrics = spark.createDataFrame([("s", "jul", "seo_pct", 20.0), ("s", "sep", "seo_pct", 50.0), ("s", "aug", "a11y_findings", 0.0), ("s", "sep", "a11y_findings", 1.0),
                                     ("s", "aug", "rating", 4.5), ("s", "jul", "reviews", 7.0), ("s", "sep", "reviews", 7.0), ("s", "sep", "ai_slop", float("nan"))],
                                    "site string, run_id string, key string, value double")
    got = {r.key: (r.delta, r.trend, r.has_gap, r.missing) for r in R.metric_trend(metrics, runs).collect()}
    assert got == {"seo_pct": (30.0, "better", True, False), "a11y_findings": (1.0, "worse", False, False), "rating": (None, None, True, True),
                   "reviews": (None, "same", True, False)}


def test_positions_and_previous_match_brute_force(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, datetime(2026, 1 + i % 9, 1 + i % 27, i % 24, i % 60)) for i in range(1000)]
    rows = list({(k, t): (k, v, t) for k, v, t in rows}.values())
    df = spark.createDataFrame(rows, "k string, v int, t timestamp")
    expected, before = {}, {}
    for key in {r[0] for r in rows}:
        for n, (_, v, t) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[2]), 1):
            expected[key, t] = n
        held = None
        for _, v, t in sorted((r for r in rows if r[0] == key), key=lambda r: r[2]):
            before[key, t] = held
            held = v if v % 2 == 0 else held
    got = ranking.positions(df, ["k"], [df.t.asc()]).collect()
    assert {(r.k, r.t): r.position for r in got} == expected
    from pyspark.sql import functions as F

    even = F.when(F.col("v") % 2 == 0, F.col("v"))
    assert {(r.k, r.t): r.b for r in ranking.previous(df, ["k"], "t", even, "b").collect()} == before
