"""Queries over the ``cells`` layout: serialisers, shapes, processors, prompt build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import serialize as Z
from tablefold.operators.budget import token_count
from tablefold.operators.prompts import fill
from tablefold.plans.base import register

# DuckDB twin of cells.lineitem_cells
F4_SQL = """
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS row_idx
  FROM lineitem),
cells AS (
  SELECT l_orderkey AS case_id, 'lineitem' AS table_name, row_idx, 0 AS col_idx, 'l_linenumber' AS col_name,
         CAST(l_linenumber AS VARCHAR) AS value FROM ranked
  UNION ALL SELECT l_orderkey, 'lineitem', row_idx, 1, 'l_partkey', CAST(l_partkey AS VARCHAR) FROM ranked
  UNION ALL SELECT l_orderkey, 'lineitem', row_idx, 2, 'l_quantity', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM ranked
  UNION ALL SELECT l_orderkey, 'lineitem', row_idx, 3, 'l_returnflag', l_returnflag FROM ranked
  UNION ALL SELECT l_orderkey, 'lineitem', row_idx, 4, 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d') FROM ranked)
"""


def f4(body: str) -> str:
    return "WITH " + F4_SQL.strip() + ",\n" + body


def _lines(line_expr: str, hdr_expr: str = "NULL") -> str:
    return f"""rows AS (SELECT case_id, table_name, row_idx, {line_expr} AS line, {hdr_expr} AS hdr
      FROM cells GROUP BY case_id, table_name, row_idx)"""


def _text_sql(line_expr, hdr_expr="NULL", head="", tail="") -> str:
    return f4(_lines(line_expr, hdr_expr) + f"""
SELECT case_id, table_name, {head} string_agg(line, chr(10) ORDER BY row_idx) {tail} AS text
FROM rows GROUP BY case_id, table_name""")


PIPE_VALUES = "'|' || string_agg(value, '|' ORDER BY col_idx) || '|'"
PIPE_NAMES = "'|' || string_agg(col_name, '|' ORDER BY col_idx) || '|'"
RULE = "'|' || string_agg('---', '|' ORDER BY col_idx) || '|'"


@register("cells_lineitem", f4("SELECT case_id, table_name, row_idx, col_idx, col_name, value FROM cells"))
def q_cells(spark, sf_dir):
    return C.lineitem_cells(spark, sf_dir)


@register("table_shapes", f4("""SELECT case_id, table_name, CAST(max(row_idx) + 1 AS BIGINT) AS n_rows,
    CAST(max(col_idx) + 1 AS BIGINT) AS n_cols, count(*) AS n_cells,
    CASE WHEN count(*) < 500 THEN 'small' WHEN count(*) < 2000 THEN 'medium' ELSE 'large' END AS size_category
    FROM cells GROUP BY case_id, table_name"""))
def q_table_shapes(spark, sf_dir):
    return C.table_shape(C.lineitem_cells(spark, sf_dir))


@register("first_rows_shapes", f4("""SELECT case_id, count(*) AS n_cells FROM cells WHERE row_idx < 3
    GROUP BY case_id"""))
def q_first_rows(spark, sf_dir):
    c = C.first_n_rows(C.lineitem_cells(spark, sf_dir), 3)
    return c.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_cells"))


@register("serialize_shortline", f4(_lines(PIPE_VALUES, PIPE_NAMES + " || chr(10) || " + RULE) + """
SELECT case_id, table_name, arg_min(hdr, row_idx) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)
       || chr(10) AS text FROM rows GROUP BY case_id, table_name"""))
def q_shortline(spark, sf_dir):
    return Z.markdown_short_line(C.lineitem_rows(spark, sf_dir))


@register("serialize_short", f4(_lines(PIPE_VALUES, PIPE_NAMES) + """
SELECT case_id, table_name, arg_min(hdr, row_idx) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)
       || chr(10) AS text FROM rows GROUP BY case_id, table_name"""))
def q_short(spark, sf_dir):
    return Z.markdown_short(C.lineitem_rows(spark, sf_dir))


@register("serialize_values", _text_sql(PIPE_VALUES, tail="|| chr(10)"))
def q_values(spark, sf_dir):
    return Z.values_only(C.lineitem_rows(spark, sf_dir))


@register("serialize_keyvalue", _text_sql(
    "'|' || string_agg(col_name || ': ' || value, '|' ORDER BY col_idx) || '|'", tail="|| chr(10)"))
def q_keyvalue(spark, sf_dir):
    return Z.key_value(C.lineitem_rows(spark, sf_dir))


@register("serialize_text", _text_sql("string_agg(ltrim(col_name || ': ' || trim(value)), '. ' ORDER BY col_idx)"))
def q_text(spark, sf_dir):
    return Z.text_rows(C.lineitem_rows(spark, sf_dir))


@register("serialize_jsonl", _text_sql(
    "'{' || string_agg(to_json(col_name) || ':' || to_json(value), ',' ORDER BY col_idx) || '}'", tail="|| chr(10)"))
def q_jsonl(spark, sf_dir):
    return Z.json_lines(C.lineitem_rows(spark, sf_dir))


@register("serialize_jsonl_index", _text_sql(
    "'{\"index\":' || CAST(row_idx AS VARCHAR) || ',' || string_agg(to_json(col_name) || ':' || to_json(value), ',' "
    "ORDER BY col_idx) || '}'", tail="|| chr(10)"))
def q_jsonl_index(spark, sf_dir):
    return Z.json_lines(C.lineitem_rows(spark, sf_dir), index=True)


@register("serialize_csv", f4(_lines("string_agg(value, ',' ORDER BY col_idx)",
                                     "string_agg(col_name, ',' ORDER BY col_idx)") + """
SELECT case_id, table_name, arg_min(hdr, row_idx) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)
       || chr(10) AS text FROM rows GROUP BY case_id, table_name"""))
def q_csv(spark, sf_dir):
    return Z.csv(C.lineitem_rows(spark, sf_dir))


@register("serialize_csv_index", f4(_lines("CAST(row_idx AS VARCHAR) || ',' || string_agg(value, ',' ORDER BY col_idx)",
                                           "',' || string_agg(col_name, ',' ORDER BY col_idx)") + """
SELECT case_id, table_name, arg_min(hdr, row_idx) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)
       AS text FROM rows GROUP BY case_id, table_name"""))
def q_csv_index(spark, sf_dir):
    return Z.csv(C.lineitem_rows(spark, sf_dir), index=True)


@register("serialize_csv_noheader", _text_sql("string_agg(value, ',' ORDER BY col_idx)"))
def q_csv_noheader(spark, sf_dir):
    return Z.csv(C.lineitem_rows(spark, sf_dir), header=False)


@register("serialize_markdown", f4("""w AS (SELECT *, greatest(max(length(value)) OVER (PARTITION BY case_id, table_name, col_idx), length(col_name), 3) AS w FROM cells),
rows AS (SELECT case_id, table_name, row_idx, '| ' || string_agg(rpad(value, CAST(w AS INTEGER), ' '), ' | ' ORDER BY col_idx) || ' |' AS line,
  '| ' || string_agg(rpad(col_name, CAST(w AS INTEGER), ' '), ' | ' ORDER BY col_idx) || ' |' || chr(10) || '|' || string_agg(':' || repeat('-', w + 1), '|' ORDER BY col_idx) || '|' AS hdr
  FROM w GROUP BY ALL)
SELECT case_id, table_name, any_value(hdr) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) AS text FROM rows GROUP BY case_id, table_name"""))
def q_markdown(spark, sf_dir):
    """Own aligned layout."""
    return Z.markdown(C.lineitem_rows(spark, sf_dir))


@register("serialize_html", f4("""rows AS (SELECT case_id, table_name, row_idx, '<tr>' || string_agg('<td>' || value || '</td>', '' ORDER BY col_idx) || '</tr>' AS line,
  '<table>' || chr(10) || '<thead><tr>' || string_agg('<th>' || col_name || '</th>', '' ORDER BY col_idx) || '</tr></thead>' || chr(10) || '<tbody>' AS hdr FROM cells GROUP BY ALL)
SELECT case_id, table_name, any_value(hdr) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) || chr(10) || '</tbody>' || chr(10) || '</table>' AS text
FROM rows GROUP BY case_id, table_name"""))
def q_html(spark, sf_dir):
    """Own HTML layout."""
    return Z.html(C.lineitem_rows(spark, sf_dir))


TEMPLATE = "Answer using the table.\n{{{table}}}\nQuestion: how many lines does order {{{order}}} have?{{{unknown}}}"
TOKEN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


@register("prompt_build", f4(_lines(PIPE_VALUES, PIPE_NAMES + " || chr(10) || " + RULE) + f""",
t AS (SELECT case_id, arg_min(hdr, row_idx) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS tbl
      FROM rows WHERE row_idx < 10 GROUP BY case_id),
p AS (SELECT case_id, 'Answer using the table.' || chr(10) || tbl || chr(10) || 'Question: how many lines does order '
      || CAST(case_id AS VARCHAR) || ' have?{{{{{{unknown}}}}}}' AS prompt FROM t)
SELECT case_id, prompt, CAST(len(regexp_extract_all(prompt, '{TOKEN}')) AS DOUBLE) AS token_count FROM p"""))
def q_prompt_build(spark, sf_dir):
    """T2+T4+P1+Z6+K1: fill a template with each order's first 10 rows as a short-line table."""
    cells = C.first_n_rows(C.lineitem_cells(spark, sf_dir), 10)
    t = Z.markdown_short_line(cells)
    p = t.select("case_id", fill(TEMPLATE, {"table": F.col("text"), "order": F.col("case_id")}).alias("prompt"))
    return p.select("case_id", "prompt", token_count(F.col("prompt")).alias("token_count"))
