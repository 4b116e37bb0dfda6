import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from vitrine.streaming import jobs as J


def put(folder, run, day, **metrics):
    (folder / f"{run}.json").write_text(json.dumps({"site": "s", "run_id": run, "created_at": datetime(2026, 1, day).isoformat(), "command": "scan", "status": "COMPLETE",
                                                    "counts": {"pages": 3}, "metrics": metrics}))


def test_runs_are_stored_once_and_kept(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "r1", 1, seo_pct=20.0)
    (inbox / "broken.json").write_text("{")
    out, check = str(tmp_path / "runs"), str(tmp_path / "check")
    J.ingest_runs(J.read_manifests(spark, str(inbox)), out, check).awaitTermination()
    put(inbox, "r2", 2, seo_pct=30.0)
    (inbox / "copy.json").write_text((inbox / "r1.json").read_text())
    J.ingest_runs(J.read_manifests(spark, str(inbox)), out, check).awaitTermination()
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["r1", "r2"]


def test_alerts_equal_the_batch_result_even_for_late_runs(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    runs, alerts, check = (str(tmp_path / n) for n in ("runs", "alerts", "check"))

    def go():
        J.metric_alerts(J.read_manifests(spark, str(inbox)), alerts, check).awaitTermination()
        J.ingest_runs(J.read_manifests(spark, str(inbox)), runs, check + "-runs").awaitTermination()

    put(inbox, "r1", 1, seo_pct=20.0)
    go()
    put(inbox, "r3", 3, seo_pct=50.0)
    go()
    put(inbox, "r2", 2, seo_pct=40.0)  # Late: it belongs between the two.
    go()
    stored = spark.read.parquet(alerts)
    last = stored.filter(F.col("batch") == stored.agg(F.max("batch")).first()[0]).first()
    assert (last.key, last.before, last.now, last.delta, last.trend) == ("seo_pct", 40.0, 50.0, 10.0, "better")
    history = spark.read.parquet(runs)
    batch = J.site_alerts(history, history).first()
    assert (batch.before, batch.now, batch.delta) == (last.before, last.now, last.delta)


def test_trends_from_state_equal_those_of_the_history(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    runs, trends, check = (str(tmp_path / n) for n in ("runs", "trends", "check"))
    rng, days = random.Random(2), list(range(1, 29))
    rng.shuffle(days)
    values = {d: {k: rng.choice([1.0, 2.5, 7.125]) for k in ("seo_pct", "ai_slop", "pages") if rng.random() < 0.7} for d in days}
    for part in (days[:9], days[9:10], days[10:]):
        for d in part:
            put(inbox, f"r{d}", d, **values[d])
            (inbox / f"again{d}.json").write_text((inbox / f"r{d}.json").read_text())
        changes = J.metric_changes(J.read_manifests(spark, str(inbox), 7))
        assert "parquet" not in changes._jdf.queryExecution().logical().toString().lower()
        J.run_writer(changes, trends, check, "update").awaitTermination()
        J.ingest_runs(J.read_manifests(spark, str(inbox), 7), runs, check + "-runs").awaitTermination()
        history = spark.read.parquet(runs)
        now = spark.read.parquet(trends)
        now = now.filter(F.col("batch") == now.agg(F.max("batch")).first()[0]).drop("batch")
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, J.site_alerts(history, history).select(now.columns).collect()))
    assert history.count() == 28


def test_schedule_hands_over_due_sites(spark):
    sites = spark.createDataFrame([("a", ["k"], False, 7), ("b", ["k"], False, 7)], "site string, keywords array<string>, repeat boolean, every_days int")
    posts = spark.createDataFrame([("b", 1, "x", datetime(2026, 1, 9))], "site string, post_id int, keyword string, created_at timestamp")
    got = []
    J.schedule_batch(sites, posts, sites, F.to_timestamp(F.lit("2026-01-10")), lambda due: got.extend(r.site for r in due.collect()))
    assert got == ["a"]
