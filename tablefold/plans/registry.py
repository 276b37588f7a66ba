"""Named queries (Spark) and their DuckDB oracles, collected for the entry module."""

from __future__ import annotations

from tablefold.plans import base
from tablefold.plans import (all_tasks, building, compare, corpus, discovery, linking, matching, needles, readers, reshaping, streams, tables,  # noqa: F401
                             tools, transforms)
from tablefold.plans import oracle as O
from tablefold.plans import scoring as SC

QUERIES: dict[str, base.Query] = {
    "scoreboard": SC.q_scoreboard,
    "overall_score": SC.q_overall,
    "scored_rows": SC.q_scored_rows,
    "group_accuracy": SC.q_group_accuracy,
    "error_counts": SC.q_error_counts,
    "by_size": SC.q_by_size,
    "by_task_size": SC.q_by_task_size,
    "task_size_wide": SC.q_task_size_wide,
    "size_stats": SC.q_size_stats,
    "by_task": SC.q_by_task,
    "summary": SC.q_summary,
    "token_usage": SC.q_token_usage,
    "extreme_tasks": SC.q_extreme_tasks,
    "rank_sizes": SC.q_rank_sizes,
    "degradation": SC.q_degradation,
    "thresholds": SC.q_thresholds,
    "advice": SC.q_advice,
    "severe_tasks": SC.q_severe_tasks,
    "failures": SC.q_failures,
    "compare_models": SC.q_compare_models,
}
QUERIES.update({f"{name}_metrics": SC.set_task_metrics(task) for name, task in SC.SET_TASKS.items()})
QUERIES.update(base.QUERIES)

ORACLE: dict[str, str] = dict(O.F1_QUERIES)
ORACLE.update({f"{name}_metrics": sql for name, sql in O.SET_QUERIES.items()})
ORACLE.update(base.ORACLE)
