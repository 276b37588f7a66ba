"""Text tables, SQL / tool-call extraction, profiling tools, routing and resume joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.operators import cells as C
from tablefold.operators import joins as J
from tablefold.operators import profile as Q
from tablefold.operators import serialize as Z
from tablefold.plans.base import R, register
from tablefold.plans.oracle import F1_CTE
from tablefold.plans.tables import F4_SQL, f4
from tablefold.sources import derived as D
from tablefold.sources.tables import table
from tablefold.sources.text_tables import extract_tables


def texts_with_tables(spark, sf_dir):
    """'intro' + the short-line text of each order's table + 'outro'."""
    t = Z.markdown_short_line(C.lineitem_rows(spark, sf_dir))
    return t.select("case_id", F.concat(F.lit("intro\n"), F.col("text"), F.lit("\noutro")).alias("text"))


@register("parse_text_tables", f4("SELECT case_id, 'table_0' AS table_name, row_idx, col_idx, col_name, value FROM cells"))
def q_parse_text_tables(spark, sf_dir):
    """S19 round trip: tables written as text (Z6) parse back to the same cells."""
    return extract_tables(texts_with_tables(spark, sf_dir), "case_id", "text")


def sql_completions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey").cast("string")
    c = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 5
    text = (F.when(m == 0, F.concat(F.lit("Here:\n```sql\nSELECT o_totalprice FROM orders WHERE o_orderkey = "), k,
                                    F.lit("\n```\nDone")))
            .when(m == 1, F.concat(F.lit('<tool_call>{"name": "execute_sql", "arguments": {"query": '
                                         '"SELECT count(*) FROM orders WHERE o_custkey = '), c,
                                   F.lit('"}}</tool_call>')))
            .when(m == 2, F.concat(F.lit("  select * from orders where o_orderkey = "), k, F.lit("; trailing")))
            .when(m == 3, F.lit("WITH t AS (SELECT 1) SELECT * FROM t; -- end"))
            .otherwise(F.lit("no query here")))
    return o.select("o_orderkey", text.alias("completion"))


@register("extract_sql", """SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN 'SELECT o_totalprice FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
    WHEN 1 THEN 'SELECT count(*) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS VARCHAR)
    WHEN 2 THEN 'select * from orders where o_orderkey = ' || CAST(o_orderkey AS VARCHAR) || '; trailing'
    WHEN 3 THEN 'WITH t AS (SELECT 1) SELECT * FROM t'
    ELSE 'SQLCodeBlockNotFound' END AS sql FROM orders""")
def q_extract_sql(spark, sf_dir):
    """Fenced block, then execute_sql tool call, then a leading statement, else the marker."""
    return sql_completions(spark, sf_dir).select("o_orderkey", X.extract_sql(F.col("completion")).alias("sql"))


def tool_call_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    m = F.col("o_orderkey") % 3
    p = F.col("o_orderpriority")
    call = (F.when(m == 0, F.concat(F.lit('<tool_call>count_rows({"table_name": "'), p, F.lit('"})</tool_call>')))
            .when(m == 1, F.concat(F.lit('<tool_call>count_rows(table_name="'), p, F.lit('", n=10)</tool_call>')))
            .otherwise(F.lit('<tool_call>sample_rows({"table_name": "x"})</tool_call>')))
    return o.select("o_orderkey", F.concat(F.lit("Let me check. "), call, F.lit(" Then answer.")).alias("text"))


@register("tool_call_replay", """WITH c AS (SELECT o_orderpriority AS t, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'sample_rows' ELSE 'count_rows' END AS tool,
  CASE WHEN o_orderkey % 3 = 2 THEN 'x' ELSE o_orderpriority END AS table_arg,
  CASE WHEN o_orderkey % 3 = 2 THEN 'Error: unknown tool sample_rows' ELSE CAST(c.n AS VARCHAR) END AS result,
  'Let me check.  Then answer.' AS clean
FROM orders JOIN c ON c.t = orders.o_orderpriority""")
def q_tool_call_replay(spark, sf_dir):
    """X10 + X11 + Q11: parse calls (JSON or k=v args), answer count_rows by a join, error otherwise."""
    calls = tool_call_texts(spark, sf_dir)
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("table")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    r = Q.replay_calls(calls, counts)
    return r.select("o_orderkey", "tool", "table_arg", "result", X.clean_markers(F.col("text")).alias("clean"))


@register("kv_metadata", """SELECT o_orderkey, o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS id,
  'bench' AS benchmark, '' AS note FROM orders""")
def q_kv_metadata(spark, sf_dir):
    """X14 build then X13 parse of ``k_v___k_v`` metadata (note defaults to '')."""
    o = table(spark, sf_dir, "orders")
    kv = X.build_kv_metadata(benchmark=F.lit("bench"), dataset=F.col("o_orderpriority"), id=F.col("o_orderkey"))
    m = X.parse_kv_metadata(kv)
    return o.select("o_orderkey", m["dataset"].alias("dataset"), m["id"].alias("id"),
                    m["benchmark"].alias("benchmark"), m["note"].alias("note"))


CODES = list(X.MODEL_CODES) + ["ZZ"]


@register("model_names", "SELECT o_orderkey, code, CASE code " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in X.MODEL_CODES.items()) + " ELSE NULL END AS model FROM (SELECT o_orderkey, "
    "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END AS code FROM orders)")
def q_model_names(spark, sf_dir):
    """Short model code -> full name (unknown -> NULL)."""
    o = table(spark, sf_dir, "orders")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return o.select("o_orderkey", code.alias("code")).select("o_orderkey", "code",
                                                              X.model_name(F.col("code")).alias("model"))


@register("route_strategy", "WITH " + F1_CTE.strip() + """
SELECT test_case, CASE WHEN task = 'NL2SQL' THEN 'direct_sql' WHEN _table_cells > 1842 THEN 'sql_only'
  WHEN _table_cells > 488 THEN 'hybrid' ELSE 'direct' END AS strategy FROM f1""")
def q_route_strategy(spark, sf_dir):
    """Q8 + Q9: strategy by task and table size."""
    r = D.responses_f1(spark, sf_dir)
    cells = X.metadata_field(F.col("metadata"), "_table_cells", "bigint")
    task = X.metadata_field(F.col("metadata"), "task")
    return r.select(X.metadata_field(F.col("metadata"), "test_case", "bigint").alias("test_case"),
                    Q.route_task(task, cells).alias("strategy"))


def _results_with_gaps(spark, sf_dir):
    """F1 results with every fifth order never answered (J2) and empty answers (m = 5) to retry."""
    r = D.responses_f1(spark, sf_dir)
    key = X.metadata_field(F.col("metadata"), "test_case", "bigint")
    return r.filter(key % 5 != 0)


@register("todo_queries", "SELECT o_orderkey AS test_case FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 8 = 5")
def q_todo_queries(spark, sf_dir):
    """J2 + J3: queries never answered or answered empty."""
    queries = D.responses_f1(spark, sf_dir).select("metadata")
    todo = J.todo_queries(queries, _results_with_gaps(spark, sf_dir))
    return todo.select(X.metadata_field(F.col("metadata"), "test_case", "bigint").alias("test_case"))


@register("attach_sizes", "WITH " + F1_CTE.strip() + """
SELECT _size_category, count(*) AS n, CAST(sum(_table_cells) AS BIGINT) AS cells FROM f1 GROUP BY 1""")
def q_attach_sizes(spark, sf_dir):
    """Size columns attached to results by test case from a de-duplicated size table."""
    r = D.responses_f1(spark, sf_dir)
    key = X.metadata_field(F.col("metadata"), "test_case", "bigint")
    results = r.select(key.alias("test_case"), "response")
    sizes = r.select(key.alias("test_case"),
                     X.metadata_field(F.col("metadata"), "_size_category").alias("_size_category"),
                     X.metadata_field(F.col("metadata"), "_table_cells", "bigint").alias("_table_cells"))
    sizes = sizes.unionByName(sizes.filter(F.col("test_case") % 10 == 0))   # duplicates on the right side
    j = J.attach_sizes(results, sizes)
    return j.groupBy("_size_category").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("_table_cells").cast("bigint").alias("cells"))


@register("row_counts", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}"
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]) + ")")
def q_row_counts(spark, sf_dir):
    """Q2."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    return Q.count_rows({t: table(spark, sf_dir, t) for t in names})


@register("distinct_values", "SELECT DISTINCT c_name FROM customer")
def q_distinct_values(spark, sf_dir):
    """Q5: every distinct value."""
    return Q.distinct_values(table(spark, sf_dir, "customer"), "c_name")


@register("distinct_values_top", """SELECT c_name, (SELECT count(DISTINCT c_name) FROM customer) > 100 AS truncated
    FROM (SELECT DISTINCT c_name FROM customer ORDER BY c_name LIMIT 100)""")
def q_distinct_values_top(spark, sf_dir):
    """Q5 with the caller's limit (a top-k report)."""
    return Q.distinct_values(table(spark, sf_dir, "customer"), "c_name", limit=100)


@register("column_stats", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(min({c}), {R}) AS min, round(max({c}), {R}) AS max, round(avg({c}), {R}) AS avg "
    "FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + ")")
def q_column_stats(spark, sf_dir):
    """Q6: numeric column stats in one pass (unpivot)."""
    s = Q.column_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return s.select("column", *[F.round(c, R).alias(c) for c in ("min", "max", "avg")])


@register("run_select", """SELECT o_custkey, n, (SELECT count(DISTINCT o_custkey) FROM orders) AS total_rows
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def q_run_select(spark, sf_dir):
    """Q4: a SELECT over temp views: all rows, and their number."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows, total = Q.run_select(spark, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
    return rows.select("*", total.scalar().alias("total_rows"))


HYBRID_ROWS = 100
CONTEXT_CASES = ["'part ' || {p}", "'supplier ' || {s} || ' ' || l_returnflag", "'supplier ' || {s}"]   # direct, hybrid, sql_only
CONTEXT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _case_union(body: str) -> str:
    return " UNION ALL ".join(body.replace("$CASE", c.format(p="CAST(l_partkey AS VARCHAR)", s="CAST(l_suppkey AS VARCHAR)")) for c in CONTEXT_CASES)


@register("context_text", f"""WITH l AS ({_case_union("SELECT $CASE AS case_id, * FROM lineitem")}),
r AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {CONTEXT_ORDER}) AS i,
   5 * count(*) OVER (PARTITION BY case_id) AS n_cells,
   '|' || l_linenumber || '|' || l_partkey || '|' || CAST(l_quantity AS INTEGER) || '|' || l_returnflag || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' AS line
   FROM l),
s AS (SELECT *, CASE WHEN n_cells > 1842 THEN 'sql_only' WHEN n_cells > 488 THEN 'hybrid' ELSE 'direct' END AS strategy FROM r)
SELECT case_id, 'lineitem' AS table_name, strategy, 'Columns: l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate' ||
   CASE WHEN strategy = 'sql_only' THEN '' ELSE chr(10) || '|l_linenumber|l_partkey|l_quantity|l_returnflag|l_shipdate|' || chr(10) ||
     '|---|---|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (WHERE strategy = 'direct' OR i <= {HYBRID_ROWS}) || chr(10) END AS context
FROM s GROUP BY case_id, strategy""")
def q_context_text(spark, sf_dir):
    """Q10 on tables of all three sizes: lines by part, by supplier and flag, by supplier."""
    li = table(spark, sf_dir, "lineitem")
    cases = F.array(*[F.expr(c.format(p="CAST(l_partkey AS STRING)", s="CAST(l_suppkey AS STRING)")) for c in CONTEXT_CASES])
    rows = li.withColumn("case_key", F.explode(cases))
    texts = {"l_quantity": F.col("l_quantity").cast("int").cast("string"), "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")}
    t = C.frame_to_rows(rows, "case_key", "lineitem", C.F4_COLUMNS, C.F4_ORDER, texts)
    return Q.context_text(t, C.table_shape(t), HYBRID_ROWS)
