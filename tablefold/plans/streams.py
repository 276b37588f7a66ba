"""Streaming queries (R1, R2) run with availableNow and compared with the batch result (F8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablefold.functions.extract import metadata_field
from tablefold.plans.base import R, register
from tablefold.plans.oracle import F1_CTE
from tablefold.sources import derived as D
from tablefold.streaming import intake as S

TASKS = ["Table-QA", "Table-Fact-Verification"]


def _deliver(spark, sf_dir) -> str:
    """F8: F1 results as four file batches by order key % 4, plus re-delivered copies of every tenth order."""
    base = S.new_run_folder(spark)
    r = D.responses_f1(spark, sf_dir)
    k = metadata_field(F.col("metadata"), "test_case", "bigint")
    batches = [r.filter(k % 4 == i) for i in range(4)] + [r.filter(k % 10 == 0)]
    S.write_batches(batches, base + "/in")
    return base


@register("stream_intake", "WITH " + F1_CTE.strip() + """
SELECT dataset, count(*) AS n FROM f1 WHERE m <> 5 GROUP BY dataset""")
def q_stream_intake(spark, sf_dir):
    """Non-empty results, each query once, counted per dataset after an availableNow run."""
    base = _deliver(spark, sf_dir)
    intake = S.stream_results(spark, base + "/in")
    counts = intake.groupBy(metadata_field(F.col("metadata"), "dataset").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"))
    name = "intake_" + uuid.uuid4().hex[:10]
    return S.run_available(counts, name, base + "/ckpt")


@register("stream_scoreboard", "WITH " + F1_CTE.strip() + f"""
SELECT task, count(*) AS n, round(avg(correct), {R}) AS acc FROM scored WHERE m <> 5 GROUP BY task""")
def q_stream_scoreboard(spark, sf_dir):
    """R2: running per-task count and accuracy over the de-duplicated intake."""
    base = _deliver(spark, sf_dir)
    board = S.stream_scoreboard(S.stream_results(spark, base + "/in"), TASKS)
    name = "board_" + uuid.uuid4().hex[:10]
    out = S.run_available(board, name, base + "/ckpt")
    return out.select("task", "n", F.round("acc", R).alias("acc"))


@register("stream_intake_bounded", "WITH " + F1_CTE.strip() + """
SELECT dataset, count(*) AS n FROM f1 WHERE m <> 5 GROUP BY dataset""")
def q_stream_intake_bounded(spark, sf_dir):
    """R1 with a state of seven days: the same counts, as every copy comes within them."""
    base = _deliver(spark, sf_dir)
    intake = S.stream_results(spark, base + "/in", max_files_per_trigger=8, within="7 days")
    counts = intake.groupBy(metadata_field(F.col("metadata"), "dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    return S.run_available(counts, "bounded_" + uuid.uuid4().hex[:10], base + "/ckpt")
