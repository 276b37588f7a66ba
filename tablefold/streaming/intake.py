"""Incremental result intake (R1) and the running scoreboard (R2).

Results arrive as new JSONL files in a folder (a file stream sees new files,
not lines appended to old ones). The intake drops empty responses and
de-duplicates on ``metadata`` (so a restart that re-delivers results does not
count them twice); the checkpoint is the resume point. A result has no event
time, so without ``within`` the de-dup state grows with the number of distinct
queries. With it, the time of the micro-batch that first sees a result is its
event time: no result is ever late, and state older than ``within`` is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.operators.score import score_responses
from tablefold.session import scratch_path

RESPONSE_SCHEMA = ("prompt string, metadata string, response string, prompt_tokens bigint, "
                   "completion_tokens bigint, time_taken double, model_name string")


def stream_results(spark: SparkSession, folder: str, schema: str = RESPONSE_SCHEMA,
                   max_files_per_trigger: int | None = None, within: str | None = None) -> DataFrame:
    """Streaming DataFrame of non-empty, de-duplicated results.

    ``within`` (e.g. ``"7 days"``) bounds the state: copies that come later than that after the first one count again.
    """
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.json(folder)
    s = s.filter(F.coalesce(F.length("response"), F.lit(0)) > 0)
    if within is None:
        return s.dropDuplicates(["metadata"])
    # a micro-batch's time is in the offset log, so that a repeated batch sees the same one
    seen = s.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", within)
    return seen.dropDuplicatesWithinWatermark(["metadata"]).drop("seen_at")


def stream_scoreboard(results: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """R2: per task, count and mean score of the results seen so far (complete mode)."""
    scored = score_responses(results, tasks)
    return scored.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over everything available now; return its result table."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def write_batches(batches: list[DataFrame], folder: str) -> None:
    """Deliver result batches as new files, one append per batch (test and replay helper)."""
    for b in batches:
        b.write.mode("append").json(folder)


def new_run_folder(spark: SparkSession, prefix: str = "stream") -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return scratch_path(spark, f"{prefix}-{uuid.uuid4().hex[:12]}")
