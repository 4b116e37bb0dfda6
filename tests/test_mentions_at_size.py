from pyspark.sql import functions as F

from vitrine.operators import visibility as V
from vitrine.plans import runs as PR
from vitrine.session import Tables


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_counted_without_being_sorted(spark):
    rows = [("s", "k", True, "B", 5, 2), ("s", "k", True, "A", 5, 1), ("s", "k", True, "C", 6, 1), ("s", "j", False, "D", None, 3), ("s", "j", False, "E", -7, 1)]
    mentions = spark.createDataFrame(rows, "site string, company_key string, is_target boolean, name string, answer_id bigint, position bigint")
    board = V.leaderboard(mentions, ["site"])
    assert {r.company_key: r.company for r in board.collect()} == {"k": "A", "j": "D"}
    assert {r.company for r in V.leaderboard(mentions.withColumn("answer_id", F.col("answer_id").cast("string")), ["site"]).collect()} == {"A", "D"}
    assert "keys=[site#" in plan(board) and not any("partial_count" in line and "SortAggregate" in line for line in plan(board).splitlines())


def test_cited_answers_are_counted_without_a_distinct(spark):
    source = F.array(F.struct(F.lit("https://a.test/x").alias("url"), F.lit("t").alias("title")), F.struct(F.lit("https://a.test/x#b").alias("url"), F.lit("u").alias("title")))
    rows = [("s", 1, "p"), ("s", 1, "p"), ("s", 2, "p"), ("s", 2, "q"), ("s", None, "q")]
    found = V.cited_pages(spark.createDataFrame(rows, "site string, answer_id bigint, prompt string").withColumn("sources", source), ["site"])
    assert [(r.citations, r.answers) for r in found.collect()] == [(10, 3)] and "distinct" not in plan(found)


def test_runs_arrive_from_one_pass_over_the_events(spark, tmp_path, monkeypatch):
    rows = [(u, f"2024-01-0{d} 0{h}:00:00", key, float((u or 0) * d + h)) for u in (1, 2, None) for d in (1, 2) for h in (1, 2) for key in ("click", "view")]
    spark.createDataFrame(rows, "user_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("runs", "metrics"):
        monkeypatch.setattr(PR, name, lambda t: 1 / 0)
    found = {r.run_id: r for r in spark.read.parquet(PR.arriving(Tables(spark, str(tmp_path))) + "/in").collect()}
    assert found["2/2024-01-02"].metrics == {"click": 6.0, "view": 6.0} and found["2/2024-01-02"].counts.pages == 4
