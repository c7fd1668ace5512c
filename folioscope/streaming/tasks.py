"""Index tasks: requests, life cycle events, latest states and callbacks, in batch and as a stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQUEST = "task_id string, callback_url string, file_path string, remote_url string, index_options string, requested_at timestamp"
#: The stages of a task, their status and progress.
STAGES = (("accepted", "accepted", 0), ("fetching", "running", 10), ("indexing", "running", 60), ("finalizing", "running", 90))
CALLBACK_ATTEMPTS = 3


def checked(requests: DataFrame) -> DataFrame:
    """requests with error: a task needs an id, a callback and a file or a remote file, not both; options are a JSON object."""
    error = (
        F.when(F.coalesce(F.trim("task_id"), F.lit("")) == "", "task_id is required")
        .when(F.coalesce(F.trim("callback_url"), F.lit("")) == "", "callback_url is required")
        .when(F.col("file_path").isNull() & F.col("remote_url").isNull(), "a file or a remote file is required")
        .when(F.col("file_path").isNotNull() & F.col("remote_url").isNotNull(), "a file and a remote file exclude each other")
        .when(F.col("index_options").isNotNull() & F.from_json("index_options", "map<string,string>").isNull(), "index_options is no JSON object")
    )
    return requests.withColumn("error", error)


def life_cycle(requests: DataFrame) -> DataFrame:
    """task_id, seq, event_type, stage, status, progress_percent, error: the events of each request in order.

    requests are checked(); a null error ends completed, another failed. Only remote files are fetched.
    """
    event = lambda seq, stage, status, pct, kind="progress": F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event_type"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(pct).alias("progress_percent"))
    steps = F.array(*(event(i, *s) for i, s in enumerate(STAGES)), event(4, "completed", "completed", 100, "result"), event(5, "failed", "failed", 100, "result"))
    bad = F.col("error").isNotNull()
    held = F.filter(steps, lambda e: F.when(e["stage"] == "accepted", True).when(e["stage"] == "failed", bad).when(e["stage"] == "fetching", ~bad & F.col("remote_url").isNotNull()).otherwise(~bad))
    return requests.select("task_id", F.inline(held), "error").withColumn("error", F.when(F.col("stage") == "failed", F.col("error")))


def latest(events: DataFrame, task: str = "task_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last event of each task."""
    last = F.max_by(F.struct(*(c for c in events.columns if c != task)), F.struct(*order))
    return events.groupBy(task).agg(last.alias("e")).select(task, "e.*")


def durations(events: DataFrame, task: str = "task_id", ts: str = "ts") -> DataFrame:
    """events with the seconds since the event of the task before."""
    at = F.col(ts).cast("timestamp")  # times without a zone are read in that of the session
    return events.withColumn("waited_s", at.cast("double") - F.lag(at).over(Window.partitionBy(task).orderBy(ts, "seq")).cast("double"))


def post(url: str, payload: dict, attempts: int = CALLBACK_ATTEMPTS, timeout_s: float = 30, send: Callable | None = None, sleep=time.sleep) -> int:
    """Send a payload, waiting one, two, three seconds between attempts; the last error is raised. Attempts needed."""
    import urllib.request

    def http():
        ask = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(ask, timeout=timeout_s).close()

    for n in range(1, attempts + 1):
        try:
            (send or (lambda *_: http()))(url, payload)
            return n
        except Exception:  # noqa: BLE001  whatever the network raises
            if n == attempts:
                raise
            sleep(min(n, 3))
    return attempts


def run_stream(spark: SparkSession, requests: str, events: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] | None = None, watermark: str = "1 hour"):
    """A query that reads request files (JSON lines), takes each task once, and appends its events to a Parquet table.

    handle(requests) indexes a micro-batch and returns task_id, error (null: done). Batches are written by number, so a
    batch that runs again replaces its own events.
    """
    stream = spark.readStream.schema(REQUEST).json(requests)
    once = stream.withWatermark("requested_at", watermark).dropDuplicatesWithinWatermark(["task_id"])

    def each(batch: DataFrame, number: int) -> None:
        rows = checked(batch)
        if handle is not None:
            done = handle(rows.filter("error IS NULL")).select("task_id", F.col("error").alias("_e"))
            rows = rows.join(done, "task_id", "left").withColumn("error", F.coalesce("error", "_e")).drop("_e")
        life_cycle(rows).write.mode("overwrite").parquet(f"{events}/batch={number}")

    return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; on a stream, windows close once they are later than the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
