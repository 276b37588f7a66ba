"""DuckDB oracle SQL: the expected result of each registered query.

The oracle never parses generated text: it derives the expected score of
each row from the recipe (e.g. ``o_orderkey % 8``) and the shared tables, so
it checks the Spark parse + score + aggregate path end to end.
"""

from __future__ import annotations

R = 6

# F1 ------------------------------------------------------------------------
F1_CTE = """
f1 AS (
  SELECT o_orderkey AS test_case,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Table-Fact-Verification' ELSE 'Table-QA' END AS task,
         o_orderpriority AS dataset, 'v1' AS tag, '' AS note,
         o_orderkey % 8 AS m, o_orderkey % 3 AS t3,
         CAST(o_custkey % 60 AS BIGINT) AS _table_rows, CAST(50 AS BIGINT) AS _table_cols,
         CAST((o_custkey % 60) * 50 AS BIGINT) AS _table_cells,
         CASE WHEN (o_custkey % 60) * 50 < 500 THEN 'small' WHEN (o_custkey % 60) * 50 < 2000 THEN 'medium'
              ELSE 'large' END AS _size_category,
         'm' || CAST(o_custkey % 2 AS VARCHAR) AS model_name,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         CAST(10 + o_orderkey % 50 AS BIGINT) AS prompt_tokens,
         (o_orderkey % 100) / 10.0 AS time_taken,
         o_orderstatus, o_totalprice
  FROM orders),
scored AS (
  SELECT *,
    CASE WHEN m <= 1 THEN 1.0
         WHEN m = 2 THEN CASE WHEN t3 = 2 AND cents % 10 = 0 THEN 0.0 ELSE 1.0 END
         WHEN m = 3 AND t3 = 2 THEN 1.0
         ELSE 0.0 END AS correct,
    CASE m WHEN 4 THEN 'JSONParsingError' WHEN 5 THEN 'empty' WHEN 6 THEN 'timeout'
           WHEN 7 THEN 'content_filter' ELSE 'normal' END AS error
  FROM f1),
eff AS (SELECT *, correct AS effective_correct FROM scored)
"""


def _with(cte: str, body: str) -> str:
    return "WITH " + cte.strip() + "\n" + body


def f1(body: str) -> str:
    return _with(F1_CTE, body)


ERROR_CLASSES = ["None", "CompletionNotString", "content_filter", "timeout", "empty", "JSONParsingError", "normal"]

F1_QUERIES = {
    "scored_rows": f1("SELECT test_case, task, dataset, correct, error FROM scored"),
    "group_accuracy": f1(f"SELECT task, dataset, tag, note, round(avg(correct), {R}) AS acc FROM scored "
                         "GROUP BY task, dataset, tag, note"),
    "scoreboard": f1(f"""SELECT task, 'acc' AS metric, round(avg(acc), {R}) AS score, count(*) AS n_groups
        FROM (SELECT task, dataset, tag, note, avg(correct) AS acc FROM scored GROUP BY ALL) GROUP BY task"""),
    "overall_score": f1(f"""SELECT round(avg(score), {R}) AS overall, count(score) AS n_tasks FROM (
        SELECT task, avg(acc) AS score FROM (SELECT task, dataset, tag, note, avg(correct) AS acc FROM scored
        GROUP BY ALL) GROUP BY task)"""),
    "error_counts": f1("SELECT dataset, tag, note, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE error = '{e}') AS BIGINT) AS \"{e}\"" for e in ERROR_CLASSES)
        + " FROM scored GROUP BY dataset, tag, note"),
    "by_size": f1(f"""SELECT _size_category AS size_category, count(*) AS count, round(avg(correct), {R}) AS accuracy,
        round(sum(correct), {R}) AS correct_sum,
        CAST(CASE _size_category WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS size_rank
        FROM scored GROUP BY _size_category"""),
    "by_task_size": f1(f"""SELECT task, _size_category AS size_category, count(*) AS count,
        round(avg(correct), {R}) AS accuracy FROM scored GROUP BY task, _size_category"""),
    "task_size_wide": f1(f"""SELECT task,
        round(avg(effective_correct) FILTER (WHERE _size_category = 'small'), {R}) AS small_accuracy,
        count(*) FILTER (WHERE _size_category = 'small') AS small_count,
        round(avg(effective_correct) FILTER (WHERE _size_category = 'medium'), {R}) AS medium_accuracy,
        count(*) FILTER (WHERE _size_category = 'medium') AS medium_count,
        round(avg(effective_correct) FILTER (WHERE _size_category = 'large'), {R}) AS large_accuracy,
        count(*) FILTER (WHERE _size_category = 'large') AS large_count
        FROM eff GROUP BY task"""),
    "size_stats": f1(f"""SELECT _size_category AS size_category, count(*) AS count,
        round(sum(effective_correct), {R}) AS total, round(avg(effective_correct), {R}) AS accuracy,
        round(avg(_table_cells), {R}) AS avg_cells, min(_table_cells) AS min_cells, max(_table_cells) AS max_cells,
        round(avg(_table_rows), {R}) AS avg_rows, round(avg(_table_cols), {R}) AS avg_cols
        FROM eff GROUP BY _size_category"""),
    "by_task": f1(f"SELECT task, round(avg(effective_correct), {R}) AS accuracy, count(*) AS count "
                  "FROM eff GROUP BY task"),
    "summary": f1(f"""SELECT round(avg(effective_correct), {R}) AS overall_accuracy, count(*) AS n_examples,
        count(DISTINCT task) AS n_tasks FROM eff"""),
    "extreme_tasks": f1(f"""SELECT side, CAST(rank AS INTEGER) AS rank, task, round(accuracy, {R}) AS accuracy FROM (
        SELECT 'worst' AS side, task, accuracy, row_number() OVER (ORDER BY accuracy ASC, task ASC) AS rank
          FROM (SELECT task, avg(effective_correct) AS accuracy FROM eff GROUP BY task)
        UNION ALL
        SELECT 'best' AS side, task, accuracy, row_number() OVER (ORDER BY accuracy DESC, task ASC) AS rank
          FROM (SELECT task, avg(effective_correct) AS accuracy FROM eff GROUP BY task)) WHERE rank <= 5"""),
    "rank_sizes": f1(f"""SELECT CAST(row_number() OVER (ORDER BY accuracy, r) AS INTEGER) AS rank,
        _size_category AS size_category, round(accuracy, {R}) AS accuracy FROM (
        SELECT _size_category, avg(effective_correct) AS accuracy,
               CASE _size_category WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r
        FROM eff GROUP BY _size_category)"""),
    "degradation": f1(f"""SELECT from_size, to_size, round(from_acc, {R}) AS from_acc, round(to_acc, {R}) AS to_acc,
        round(d, {R}) AS "drop", d > 0.15 AS significant FROM (
        SELECT _size_category AS from_size, accuracy AS from_acc,
               lead(_size_category) OVER (ORDER BY r) AS to_size, lead(accuracy) OVER (ORDER BY r) AS to_acc,
               CASE WHEN accuracy > 0 THEN (accuracy - lead(accuracy) OVER (ORDER BY r)) / accuracy ELSE 0.0 END AS d
        FROM (SELECT _size_category, avg(effective_correct) AS accuracy,
                     CASE _size_category WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r
              FROM eff GROUP BY _size_category)) WHERE to_size IS NOT NULL"""),
    "thresholds": f1("""SELECT max(_table_cells) FILTER (WHERE _size_category = 'small') AS small_max_cells,
        max(_table_cells) FILTER (WHERE _size_category = 'medium') AS medium_max_cells FROM eff"""),
    "advice": f1("""SELECT CASE WHEN last_acc / first_acc < 0.5
          THEN 'severe degradation on large tables: route large tables to SQL tools'
          WHEN last_acc / first_acc < 0.8 THEN 'moderate degradation: use a hybrid strategy for larger tables'
          ELSE 'stable across sizes: direct prompting is fine' END AS advice FROM (
        SELECT arg_min(accuracy, r) AS first_acc, arg_max(accuracy, r) AS last_acc FROM (
          SELECT avg(effective_correct) AS accuracy,
                 CASE _size_category WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r
          FROM eff GROUP BY _size_category))"""),
    "severe_tasks": f1(f"""SELECT task, round(s, {R}) AS small_accuracy, round(l, {R}) AS large_accuracy FROM (
        SELECT task, avg(effective_correct) FILTER (WHERE _size_category = 'small') AS s,
               avg(effective_correct) FILTER (WHERE _size_category = 'large') AS l FROM eff GROUP BY task)
        WHERE s IS NOT NULL AND l IS NOT NULL AND l < 0.5 * s"""),
    "token_usage": f1(f"""SELECT model_name, task, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        round(avg(time_taken), {R}) AS avg_time, count(*) AS n FROM f1 GROUP BY model_name, task"""),
    "failures": f1("SELECT task, count(*) AS n_failed FROM eff WHERE effective_correct = 0 GROUP BY task"),
    "compare_models": f1(f"""SELECT model_name, coalesce(_size_category, 'overall') AS size_category,
        round(avg(effective_correct), {R}) AS accuracy, count(*) AS n
        FROM eff GROUP BY GROUPING SETS ((model_name, _size_category), (model_name))"""),
}

# F2 ------------------------------------------------------------------------
F2_CTE = """
li AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem),
per AS (
  SELECT k,
    count(DISTINCT p) AS n_all,
    count(DISTINCT CASE WHEN p % 5 <> 0 THEN p END) AS n_kept,
    count(DISTINCT CASE WHEN s % 7 = 0 THEN s END) AS n_extra,
    count(DISTINCT CAST(p AS VARCHAR) || '|' || CAST(s AS VARCHAR)) AS np_all,
    count(DISTINCT CASE WHEN p % 5 <> 0 THEN CAST(p AS VARCHAR) || '|' || CAST(s AS VARCHAR) END) AS np_kept
  FROM li GROUP BY k),
sets AS (
  SELECT k AS test_case, 'd' || CAST(k % 4 AS VARCHAR) AS dataset, 'v1' AS tag, '' AS note,
         k % 11 = 0 AS t_empty, k % 13 = 0 AS a_empty, n_all, n_kept, n_extra, np_all, np_kept
  FROM per)
"""


def _prf_rows(nt: str, np_: str, tp: str) -> str:
    return f"""SELECT dataset, tag, note,
      CASE WHEN {nt} = 0 THEN CASE WHEN {np_} = 0 THEN NULL ELSE 0.0 END
           WHEN {np_} = 0 THEN NULL ELSE CAST({tp} AS DOUBLE) / {np_} END AS precision,
      CASE WHEN {nt} = 0 THEN NULL WHEN {np_} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / {nt} END AS recall
    FROM sets"""


def _group_prf(rows_sql: str, variant: str = "or") -> str:
    zero = "p = 0 AND r = 0" if variant == "or" else "p = 0 OR r = 0"
    return "WITH " + F2_CTE.strip() + f""", rows AS ({rows_sql}),
g AS (SELECT dataset, tag, note, avg(precision) AS p, avg(recall) AS r FROM rows GROUP BY dataset, tag, note)
SELECT dataset, tag, note, round(p, {R}) AS prec, round(r, {R}) AS recall,
  round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN {zero} THEN 0.0 ELSE 2 * p * r / (p + r) END, {R}) AS f1
FROM g"""


_NT = "CASE WHEN t_empty THEN 0 ELSE n_all END"
_NTP = "CASE WHEN t_empty THEN 0 ELSE np_all END"

SET_QUERIES = {
    "error_detect": _group_prf(_prf_rows(_NT, "CASE WHEN a_empty THEN 0 ELSE n_kept + n_extra END",
                                         "CASE WHEN t_empty OR a_empty THEN 0 ELSE n_kept END")),
    # extras fall outside the labelled universe and are dropped before scoring
    "arithmetic_relation": _group_prf(_prf_rows(_NT, "CASE WHEN a_empty THEN 0 ELSE n_kept END",
                                                "CASE WHEN t_empty OR a_empty THEN 0 ELSE n_kept END")),
    "functional_dependency": _group_prf(_prf_rows(_NTP, "CASE WHEN a_empty THEN 0 ELSE np_kept END",
                                                  "CASE WHEN t_empty OR a_empty THEN 0 ELSE np_kept END")),
    "string_relation": _group_prf(_prf_rows(_NTP, "CASE WHEN a_empty THEN 0 ELSE np_kept + n_extra END",
                                            "CASE WHEN t_empty OR a_empty THEN 0 ELSE np_kept END")),
    "equi_join_detect": _group_prf(_prf_rows(_NTP, "CASE WHEN a_empty THEN 0 ELSE np_kept + n_extra END",
                                             "CASE WHEN t_empty OR a_empty THEN 0 ELSE np_kept END")),
    # malformed (here: empty) lists on either side -> precision NULL, recall 0
    "semantic_join": _group_prf("""SELECT dataset, tag, note,
        CASE WHEN t_empty OR a_empty OR np_kept + n_extra = 0 THEN NULL
             ELSE CAST(np_kept AS DOUBLE) / (np_kept + n_extra) END AS precision,
        CASE WHEN t_empty OR a_empty OR np_kept + n_extra = 0 THEN 0.0
             ELSE CAST(np_kept AS DOUBLE) / np_all END AS recall FROM sets"""),
    # mapping by source key (last wins): every kept source maps as in the truth
    "schema_matching": _group_prf("""SELECT dataset, tag, note,
        CASE WHEN nt = 0 THEN NULL ELSE CAST(hits AS DOUBLE) / nt END AS recall,
        CASE WHEN npred = 0 THEN NULL ELSE CAST(hits AS DOUBLE) / npred END AS precision FROM (
          SELECT dataset, tag, note, CASE WHEN t_empty THEN 0 ELSE n_all END AS nt,
                 CASE WHEN a_empty THEN 0 ELSE n_kept + n_extra END AS npred,
                 CASE WHEN t_empty OR a_empty THEN 0 ELSE n_kept END AS hits FROM sets)""", variant="and"),
}
