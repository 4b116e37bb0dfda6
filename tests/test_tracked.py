"""What moved in tracked checks, against results written by hand."""

import json

from vitrine.operators import tracked


def checks(spark, rows):
    frame = spark.createDataFrame([("s", run, f"2024-01-0{at} 00:00:00", name, status, found, data if data is None or isinstance(data, str) else json.dumps(data)) for run, at, name, status, found, data in rows],
                                  "site string, run_id string, created_at string, name string, status string, found boolean, data string")
    return frame.withColumn("created_at", frame["created_at"].cast("timestamp"))


def test_numbers_and_names_of_two_runs(spark):
    scores = lambda rank, rate, own, rivals: {"scores": {"rank": rank, "mention_rate": rate, "sentiment": {"score": 1}, "sources": own, "leaderboard": [{"company": c} for c in rivals]}}
    given = checks(spark, [
        ("a", 1, "llm_reputation", "OBSERVED", True, scores(3, 0.5, [{"domain": "x.test", "answers": 4}], ["B", "C"])),
        ("b", 2, "llm_reputation", "UNKNOWN", True, scores(9, 0.9, [], [])),
        ("c", 3, "llm_reputation", "OBSERVED", True, scores(0, 0.25, [{"domain": "s", "answers": 2, "is_target": True}], ["C", "D"])),
        ("a", 1, "google_business", "OBSERVED", True, {"reviews": {"rating": 4.5, "count": 10}, "mismatches": ["phone", "city"]}),
        ("c", 3, "google_business", "OBSERVED", True, {"reviews": {"rating": 4.5, "count": 12}, "mismatches": ["city"]}),
        ("a", 1, "answer_coverage", "OBSERVED", True, {"summary": {"answered": 1, "partial": 2, "missing": 3}}),
        ("c", 3, "answer_coverage", "OBSERVED", True, {"summary": {"answered": 2, "partial": 3, "missing": 4}}),
        ("c", 3, "security", "OBSERVED", True, {}),
    ])
    got = {(r["name"], r["label"]): (r["earlier_run"], r["before"], r["after"], r["trend"]) for r in tracked.tracked_numbers(given).collect()}
    assert got == {
        ("llm_reputation", "Rank"): ("a", 3.0, None, None), ("llm_reputation", "Mention rate"): ("a", 0.5, 0.25, "worse"), ("llm_reputation", "Share of voice"): ("a", None, None, None),
        ("llm_reputation", "Sentiment"): ("a", 1.0, 1.0, "same"), ("llm_reputation", "Answers citing your site"): ("a", 0.0, 2.0, "better"),
        ("google_business", "Rating"): ("a", 4.5, 4.5, "same"), ("google_business", "Reviews"): ("a", 10.0, 12.0, "better"), ("google_business", "Facts that differ"): ("a", 2.0, 1.0, "better"),
        ("answer_coverage", "Answered"): ("a", 1.0, 2.0, "better"), ("answer_coverage", "Partly answered"): ("a", 2.0, 3.0, None), ("answer_coverage", "Not answered"): ("a", 3.0, 4.0, "worse")}
    names = {(r["name"], r["label"]): (r["gained"], r["lost"]) for r in tracked.tracked_names(given).collect()}
    assert names == {("llm_reputation", "Top competitors"): (["D"], ["B"]), ("llm_reputation", "Top cited sites"): ([], ["x.test"]), ("google_business", "Differs from the website"): ([], ["phone"])}


def test_broken_and_missing_results(spark):
    given = checks(spark, [("a", 1, "practitioners", "OBSERVED", True, "no json"), ("b", 2, "practitioners", "OBSERVED", True, None), ("c", 3, "practitioners", "OBSERVED", True, {"summary": {"practitioners": 2}, "practitioners": [{"name": "P"}, {"name": None}]}),
                           ("a", 1, "google_business", "OBSERVED", False, {}), ("c", 3, "google_business", "OBSERVED", True, {})])
    got = [(r["run_id"], r["label"], r["before"], r["after"], r["trend"]) for r in tracked.tracked_numbers(given).collect()]
    assert len(got) == 8 and all(before is None and trend is None for _, _, before, _, trend in got) and ("c", "Practitioners", None, 2.0, None) in got
    assert [(r["run_id"], r["gained"], r["lost"]) for r in tracked.tracked_names(given).collect()] == [("c", ["P"], [])]
    assert tracked.tracked_numbers(given.limit(0)).count() == 0
