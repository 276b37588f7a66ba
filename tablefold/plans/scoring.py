"""Scoring and report queries over the derived response sets (F1, F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.operators import analyze as N
from tablefold.operators import metrics as A
from tablefold.operators.score import score_responses
from tablefold.sources import derived as D

R = 6  # digits kept for float outputs (engines sum floats in different orders)


def _r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, R).alias(name)


def scored_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_responses(D.responses_f1(spark, sf_dir), tasks=["Table-QA", "Table-Fact-Verification"])


def q_scored_rows(spark, sf_dir):
    s = scored_f1(spark, sf_dir)
    return s.select(F.col("test_case").cast("bigint").alias("test_case"), "task", "dataset", "correct", "error")


def q_group_accuracy(spark, sf_dir):
    m = A.group_accuracy(scored_f1(spark, sf_dir), ["task"] + A.GROUP_KEYS)
    return m.select("task", "dataset", "tag", "note", _r("acc", "acc"))


def q_scoreboard(spark, sf_dir):
    """Flagship: per-task score = unweighted mean over (dataset, tag, note) groups of the primary metric."""
    t = A.task_scores(A.group_metrics(scored_f1(spark, sf_dir)))
    return t.select("task", "metric", _r("score", "score"), F.col("n_groups").cast("bigint").alias("n_groups"))


def q_overall(spark, sf_dir):
    o = A.overall_score(A.task_scores(A.group_metrics(scored_f1(spark, sf_dir))))
    return o.select(_r("overall", "overall"), F.col("n_tasks").cast("bigint").alias("n_tasks"))


def q_error_counts(spark, sf_dir):
    e = A.error_counts(scored_f1(spark, sf_dir))
    from tablefold.functions.extract import ERROR_CLASSES
    return e.select("dataset", "tag", "note", *[F.col(c).cast("bigint").alias(c) for c in ERROR_CLASSES])


def q_by_size(spark, sf_dir):
    b = A.by_size(scored_f1(spark, sf_dir))
    return b.select(F.col("_size_category").alias("size_category"), F.col("count").cast("bigint").alias("count"),
                    _r("accuracy", "accuracy"), _r("correct_sum", "correct_sum"),
                    F.col("size_rank").cast("int").alias("size_rank"))


def q_by_task_size(spark, sf_dir):
    b = A.by_task_size(scored_f1(spark, sf_dir))
    return b.select("task", F.col("_size_category").alias("size_category"),
                    F.col("count").cast("bigint").alias("count"), _r("accuracy", "accuracy"))


def _eff(spark, sf_dir):
    return A.effective_correct(scored_f1(spark, sf_dir))


def q_task_size_wide(spark, sf_dir):
    w = A.task_size_wide(_eff(spark, sf_dir))
    cols = ["task"]
    out = [F.col("task")]
    for s in A.SIZE_ORDER:
        out += [_r(f"{s}_accuracy", f"{s}_accuracy"), F.coalesce(F.col(f"{s}_count"), F.lit(0)).cast("bigint")
                .alias(f"{s}_count")]
    return w.select(*out)


def q_size_stats(spark, sf_dir):
    s = A.size_stats(_eff(spark, sf_dir))
    return s.select(F.col("_size_category").alias("size_category"), F.col("count").cast("bigint").alias("count"),
                    _r("total", "total"), _r("accuracy", "accuracy"), _r("avg_cells", "avg_cells"),
                    F.col("min_cells").cast("bigint").alias("min_cells"),
                    F.col("max_cells").cast("bigint").alias("max_cells"),
                    _r("avg_rows", "avg_rows"), _r("avg_cols", "avg_cols"))


def q_by_task(spark, sf_dir):
    b = A.by_task(_eff(spark, sf_dir))
    return b.select("task", _r("accuracy", "accuracy"), F.col("count").cast("bigint").alias("count"))


def q_summary(spark, sf_dir):
    s = A.summary(_eff(spark, sf_dir))
    return s.select(_r("overall_accuracy", "overall_accuracy"), F.col("n_examples").cast("bigint").alias("n_examples"),
                    F.col("n_tasks").cast("bigint").alias("n_tasks"))


def q_token_usage(spark, sf_dir):
    """K7: prompt/completion tokens and time per (model, task)."""
    s = scored_f1(spark, sf_dir)
    g = s.groupBy("model_name", "task").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.avg("time_taken").alias("avg_time"), F.count(F.lit(1)).alias("n"))
    return g.select("model_name", "task", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                    _r("avg_time", "avg_time"),
                    F.col("n").cast("bigint").alias("n"))


# --- analysis reports (N1-N8) --------------------------------------------------
def q_extreme_tasks(spark, sf_dir):
    e = N.extreme_tasks(_eff(spark, sf_dir), k=5)
    return e.select("side", F.col("rank").cast("int").alias("rank"), "task", _r("accuracy", "accuracy"))


def q_rank_sizes(spark, sf_dir):
    r = N.rank_sizes(_eff(spark, sf_dir))
    return r.select(F.col("rank").cast("int").alias("rank"), F.col("_size_category").alias("size_category"),
                    _r("accuracy", "accuracy"))


def q_degradation(spark, sf_dir):
    d = N.degradation(_eff(spark, sf_dir), threshold=0.15)
    return d.select(F.col("from_size"), F.col("to_size"), _r("from_acc", "from_acc"), _r("to_acc", "to_acc"),
                    _r("drop", "drop"), F.col("significant"))


def q_thresholds(spark, sf_dir):
    t = N.thresholds(_eff(spark, sf_dir))
    return t.select(F.col("small_max_cells").cast("bigint").alias("small_max_cells"),
                    F.col("medium_max_cells").cast("bigint").alias("medium_max_cells"))


def q_advice(spark, sf_dir):
    return N.advice(_eff(spark, sf_dir)).select("advice")


def q_severe_tasks(spark, sf_dir):
    s = N.severe_tasks(_eff(spark, sf_dir))
    return s.select("task", _r("small_accuracy", "small_accuracy"), _r("large_accuracy", "large_accuracy"))


def q_failures(spark, sf_dir):
    f = N.failures(_eff(spark, sf_dir))
    return f.select("task", F.col("n_failed").cast("bigint").alias("n_failed"))


def q_compare_models(spark, sf_dir):
    c = N.compare_models(_eff(spark, sf_dir))
    return c.select("model_name", F.col("_size_category").alias("size_category"), _r("accuracy", "accuracy"),
                    F.col("n").cast("bigint").alias("n"))


# --- set-scored tasks (F2) ---------------------------------------------------
SET_TASKS = {
    "error_detect": "Error-Detect",
    "arithmetic_relation": "Arithmetic-Relationship",
    "functional_dependency": "Functional-Dependency",
    "string_relation": "String-Relationship",
    "semantic_join": "semantic-join",
    "equi_join_detect": "equi-join-detect",
    "schema_matching": "Schema-Matching",
}


def set_task_metrics(task: str):
    def q(spark, sf_dir):
        scored = score_responses(D.set_responses(spark, sf_dir, task), tasks=[task])
        m = A.group_metrics(scored)
        return m.select("dataset", "tag", "note", _r("prec", "prec"), _r("recall", "recall"), _r("f1", "f1"))
    q.__name__ = "q_" + task
    return q
