"""Recurring work as incremental jobs over arriving runs.

Each micro-batch only touches the sites in it: what a job must know of earlier runs is keyed state in the query's checkpoint,
never a scan of what is stored. Results are Parquet folders on shared storage; a batch that is replayed after a lost
executor or driver leaves them as they were, because its rows are written under its number and its state is that of the
batch before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fixed
from ..operators.calendar import due_sites
from ..operators.runs import finite, metric_trend, trend_rows

MANIFEST = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("command", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("counts", T.StructType([T.StructField("pages", T.LongType())])),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])


def read_manifests(spark: SparkSession, folder: str, files_per_batch: int = 1000, form: str = "json") -> DataFrame:
    """Arriving run manifests as a stream; unreadable files become rows of NULLs and fall out in ``crawl_runs``."""
    return spark.readStream.schema(MANIFEST).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def crawl_runs(manifests: DataFrame) -> DataFrame:
    return manifests.filter(F.col("counts").isNotNull() & F.col("created_at").isNotNull() & F.col("run_id").isNotNull())


def store_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Write one batch's rows under its number; a replay replaces exactly those rows."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def run_writer(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived, a folder per batch, and stop."""
    return rows.writeStream.outputMode(mode).foreachBatch(lambda batch, number: store_batch(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_runs(manifests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """New runs become snapshot rows once each and stay after their bundle is gone. The ids seen are the query's state."""
    fresh = crawl_runs(manifests).dropDuplicates(["run_id"])
    return run_writer(fresh.select("site", "run_id", "created_at", "command", "status", "metrics", F.col("counts.pages").alias("pages")), folder, checkpoint)


def long_metrics(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("site", "run_id", "created_at", F.explode("metrics").alias("key", "value")).withColumn("value", finite(F.col("value"))).filter(F.col("value").isNotNull())


def site_alerts(snapshots: DataFrame, touched: DataFrame, directions: dict | None = None) -> DataFrame:
    """Current trend of every metric of the touched sites, from their whole stored history: late runs fall into place by
    their own time, not their arrival."""
    history = snapshots.join(touched.select("site").distinct(), "site", "left_semi")
    return metric_trend(long_metrics(history), history.select("site", "run_id", "created_at"), directions=directions)


SIDES = "site string, key string, now double, before double, measured bigint, oldest int"


def sides(history: list[tuple[int, str, dict]]) -> list[tuple]:
    """``(key, now, before, measured, oldest)`` of every metric of a site's runs, newest first."""
    found: dict[str, list] = {}
    for age, (_, _, metrics) in enumerate(history, 1):
        for key, value in metrics.items():
            found.setdefault(key, []).append((age, value))
    return [(key, at[0][1] if at[0][0] == 1 else None, next((v for age, v in at if age > 1), None), len(at), at[-1][0]) for key, at in sorted(found.items())]


def metric_changes(manifests: DataFrame, directions: dict | None = None, last: int = fixed.TREND_RUNS) -> DataFrame:
    """A stream of current trends: all metrics of every site that a batch touches, against its last ``last`` runs.

    A site's state is its ``last`` newest runs by their own time, so late runs fall into place, a run that comes twice counts
    once, and one that is older than all of them changes nothing. Values that are no real numbers are no measurements.
    """
    measured = F.map_filter("metrics", lambda k, v: finite(v).isNotNull())
    runs = crawl_runs(manifests).select("site", F.unix_micros("created_at").alias("at"), "run_id", F.to_json(measured).alias("metrics"))

    def update(key, batches, state: GroupState):
        known = [tuple(r) for r in json.loads(state.get[0])] if state.exists else []
        runs = {(at, run): metrics for at, run, metrics in known}
        ids = {run for _, run in runs}
        for rows in batches:
            for at, run, metrics in zip(rows["at"], rows["run_id"], rows["metrics"]):
                if run not in ids:
                    ids.add(run)
                    runs[int(at), run] = json.loads(metrics) if metrics else {}
        newest = [(*k, runs[k]) for k in sorted(runs, reverse=True)[:last]]
        if newest == known:
            return
        state.update((json.dumps(newest),))
        found = sides(newest)
        yield pd.DataFrame({"site": [key[0]] * len(found)} | {c: [f[i] for f in found] for i, c in enumerate(("key", "now", "before", "measured", "oldest"))}).astype(
            {"now": "float64", "before": "float64", "measured": "int64", "oldest": "int32"})

    rows = runs.groupBy("site").applyInPandasWithState(update, SIDES, "history string", "update", GroupStateTimeout.NoTimeout)
    return trend_rows(rows.withColumn("now", finite(F.col("now"))).withColumn("before", finite(F.col("before"))), directions)


def metric_alerts(manifests: DataFrame, alerts: str, checkpoint: str, directions: dict | None = None) -> StreamingQuery:
    """Per batch the changed metrics of the sites that got runs."""
    return run_writer(metric_changes(manifests, directions).filter(F.col("delta").isNotNull() | F.col("missing")), alerts, checkpoint, "update")


def schedule_batch(sites: DataFrame, posts: DataFrame, runs: DataFrame, now: Column, start: Callable[[DataFrame], None]) -> None:
    """The hourly pass: hand over the sites that are due. ``start`` takes them as a DataFrame."""
    start(due_sites(sites, posts, runs, now))
