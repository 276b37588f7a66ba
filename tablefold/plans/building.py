"""From case files to prompts, metadata and scores (T4, T5, T7), and the report set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import metrics as A
from tablefold.operators import serialize as Z
from tablefold.operators.budget import split_budget, token_count
from tablefold.operators.build import build_prompts
from tablefold.operators.prompts import drop_failed
from tablefold.operators.reports import REPORTS, report_set
from tablefold.operators.score import score_responses
from tablefold.plans.base import R, register
from tablefold.plans.oracle import f1
from tablefold.plans.readers import RANKED, _csv
from tablefold.plans.scoring import scored_f1
from tablefold.sources.tables import table

TEMPLATE = "Read the table.\n{{{table}}}{{{hints}}}\nQuestion: {{{question}}} {{{absent}}}"
CONFIG = {
    "task": "Table-QA", "version": "v1.0", "tag": "t", "note": "",
    "fields": {
        "table": {"type": "table.csv", "path": "data.csv", "reader": "pandas", "processors": [lambda c: C.first_n_rows(c, 2)], "serializer": Z.markdown_short_line},
        "question": {"type": "text", "name": "question"}, "absent": {"type": "text", "name": "absent"},
        "hints": {"type": "list", "name": "hints", "template": "- {{{what}}}: {{{n}}}", "fields": {"what": "w", "n": "n"}},
    },
    "5-low_fields": {
        "table": {"type": "table.csv.path", "name": "file", "reader": "pandas.str", "serializer": Z.csv},
        "question": {"type": "text", "name": "question"},
    },
}


def case_inputs(spark, sf_dir):
    """Texts of the orders' lines as CSV files, and a case with its info for every order (some without a file)."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(",", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50")), "l_returnflag")
    texts = _csv(li, "l_orderkey", line, "id,qty,flag")
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    info = F.concat(F.lit('{"question": "Status of '), k, F.lit('?", "label": "'), F.col("o_orderstatus"), F.lit('", "file": "./data.csv", "hints": [{"w": "a", "n": '),
                    k, F.lit('}, {"w": "b", "n": 0.5}]}'))
    return texts, o.select(F.col("o_orderpriority").alias("dataset"), k.alias("case_id"), F.concat(F.lit("file:/ds/"), k).alias("case_path"), info.alias("info_json"))


@register("build_to_score", "WITH " + RANKED + """, l AS (SELECT l_orderkey, row_idx, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_returnflag AS f FROM ranked),
t AS (SELECT l_orderkey, '|id|qty|flag|' || chr(10) || '|---|---|---|' || chr(10) ||
        string_agg('|' || l_linenumber || '|' || q || '.5|' || f || '|', chr(10) ORDER BY row_idx) FILTER (WHERE row_idx < 2) || chr(10) AS short,
      'id,qty,flag' || chr(10) || string_agg(lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ',' || q || '.50,' || f, chr(10) ORDER BY row_idx) || chr(10) AS csv FROM l GROUP BY l_orderkey),
p AS (SELECT o_orderkey, o_orderpriority AS dataset, o_orderstatus, 'Read the table.' || chr(10) || CASE WHEN o_orderpriority = '5-LOW' THEN csv || '{{{hints}}}'
        ELSE short || '- a: ' || o_orderkey || chr(10) || '- b: 0.5' END || chr(10) || 'Question: Status of ' || o_orderkey || '? {{{absent}}}' AS prompt FROM orders JOIN t ON l_orderkey = o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS test_case, dataset, prompt, CAST(len(regexp_extract_all(prompt, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS DOUBLE) AS token_count,
  len(regexp_extract_all(prompt, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) <= 80 AS valid, 'Table-QA' AS task, 't' AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS correct FROM p""")
def q_build_to_score(spark, sf_dir):
    """Case files to prompts under a budget, answered and scored: the metadata carries the label from the info to the scorer."""
    prompts = drop_failed(build_prompts(*case_inputs(spark, sf_dir), TEMPLATE, CONFIG))
    prompts = split_budget(prompts.withColumn("token_count", token_count(F.col("prompt"))), 80)
    wrong = F.col("case_id").cast("long") % 3 == 0
    answer = F.concat(F.lit('So: {"answer": "'), F.when(wrong, F.lit("x")).otherwise(F.get_json_object("metadata", "$.label")), F.lit('"}'))
    answered = prompts.select("prompt", "metadata", answer.alias("response"), "dataset", "token_count", "valid")
    scored = score_responses(answered, ["Table-QA"], carry=("prompt", "token_count", "valid"))       # a second use would build the prompts again
    # each prompt with every score of its test case, as a join of the two would give
    scores = F.collect_list(F.struct("task", "tag", "correct")).over(Window.partitionBy("test_case"))
    return scored.withColumn("_scores", scores).where("test_case IS NOT NULL").select("test_case", "dataset", "prompt", "token_count", "valid", F.inline("_scores"))


def _reports_sql() -> str:
    keys = {"_size_category": "size_category"}
    parts = []
    for name, by in REPORTS.items():
        by = [keys.get(k, k) for k in by]
        cols = ", ".join(k if k in by else f"CAST(NULL AS VARCHAR) AS {k}" for k in ("task", "size_category", "dataset", "tag", "note"))
        order = ", ".join("CASE size_category WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END" if k == "size_category" else k for k in by) or "1"
        parts.append(f"SELECT '{name}' AS report, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, {cols}, count(*) AS count, round(avg(correct), {R}) AS accuracy, "
                     f"round(sum(correct), {R}) AS total, round(avg(cells), {R}) AS avg_cells, min(cells) AS min_cells, max(cells) AS max_cells FROM ef" + (f" GROUP BY {', '.join(by)}" if by else ""))
    return " UNION ALL ".join(parts)


@register("report_set", f1(", ef AS (SELECT *, _size_category AS size_category, _table_cells AS cells FROM scored)\n" + _reports_sql()).replace("FROM scored),\n,", "FROM scored),\n"))
def q_report_set(spark, sf_dir):
    """S17 + O1: all reports of the scored answers, each in the order of its keys."""
    r = report_set(A.effective_correct(scored_f1(spark, sf_dir)))
    return r.select("report", "position", "task", "size_category", "dataset", "tag", "note", "count", *[F.round(c, R).alias(c) for c in ("accuracy", "total", "avg_cells")],
                    "min_cells", "max_cells")
