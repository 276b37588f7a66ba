"""Reshape queries (D13-D21) on each order's table (F4), with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import reshape as RS
from tablefold.operators import serialize as Z
from tablefold.plans.base import register
from tablefold.plans.tables import f4

OUT = "SELECT case_id, table_name, CAST(row_idx AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, col_name, value FROM "


def _cells(spark, sf_dir):
    return C.lineitem_cells(spark, sf_dir)


@register("reshape_stack", f4("""n AS (SELECT 1)
""" + OUT + """(
  SELECT case_id, table_name, row_idx * 2 + j AS row_idx, CASE WHEN col_idx < 1 THEN col_idx ELSE col_idx - 2 END AS col_idx,
         col_name, value FROM cells, (SELECT unnest([0, 1]) AS j) WHERE col_idx NOT BETWEEN 1 AND 2
  UNION ALL SELECT case_id, table_name, row_idx * 2 + col_idx - 1, 3, 'variable', col_name FROM cells WHERE col_idx BETWEEN 1 AND 2
  UNION ALL SELECT case_id, table_name, row_idx * 2 + col_idx - 1, 4, 'value', value FROM cells WHERE col_idx BETWEEN 1 AND 2)"""))
def q_stack(spark, sf_dir):
    """Stack columns 1..2 (l_partkey, l_quantity)."""
    return RS.stack(C.lineitem_rows(spark, sf_dir), 1, 2)


@register("reshape_transpose", f4("x AS (SELECT 1)\n" + OUT + """(SELECT case_id, table_name, col_idx AS row_idx,
  row_idx AS col_idx, CAST(row_idx AS VARCHAR) AS col_name, value FROM cells)"""))
def q_transpose(spark, sf_dir):
    """D15 (values; twice = identity)."""
    return RS.transpose(_cells(spark, sf_dir))


@register("reshape_pivot", f4("x AS (SELECT 1)\n" + OUT + """(SELECT case_id, table_name, floor(row_idx / 2) AS row_idx,
  (row_idx % 2) * 5 + col_idx AS col_idx, col_name || '_' || CAST(row_idx % 2 AS VARCHAR) AS col_name, value FROM cells)"""))
def q_pivot(spark, sf_dir):
    """Row groups of 2 become one row."""
    return RS.pivot(C.lineitem_rows(spark, sf_dir), 2)


def _holes(c):
    """Input for ffill: return-flag cells of odd rows emptied."""
    return c.withColumn("vals", F.zip_with("idx", "vals", lambda i, v: F.when((i == 3) & (F.col("row_idx") % 2 == 1), F.lit("")).otherwise(v)))


@register("reshape_ffill", f4("""h AS (SELECT case_id, table_name, row_idx, col_idx, col_name,
  CASE WHEN col_idx = 3 AND row_idx % 2 = 1 THEN '' ELSE value END AS value FROM cells)
""" + OUT + """(SELECT case_id, table_name, row_idx, col_idx, col_name,
  CASE WHEN col_idx <= 3 THEN coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY case_id, table_name, col_idx
       ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') ELSE value END AS value FROM h)"""))
def q_ffill(spark, sf_dir):
    """Fill emptied return flags from the row above (columns 0..3)."""
    return C.as_cells(RS.ffill(_holes(C.lineitem_rows(spark, sf_dir)), 3))


@register("reshape_explode", f4("""p AS (SELECT case_id, table_name, row_idx, string_split(value, '-') AS ps FROM cells WHERE col_idx = 4),
o AS (SELECT *, coalesce(sum(len(ps)) OVER (PARTITION BY case_id, table_name ORDER BY row_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
e AS (SELECT case_id, table_name, row_idx, off, trim(unnest(ps)) AS piece, generate_subscripts(ps, 1) - 1 AS j FROM o)
""" + OUT + """(SELECT c.case_id, c.table_name, e.off + e.j AS row_idx, c.col_idx, c.col_name,
  CASE WHEN c.col_idx = 4 THEN e.piece ELSE c.value END AS value
  FROM cells c JOIN e ON c.case_id = e.case_id AND c.table_name = e.table_name AND c.row_idx = e.row_idx)"""))
def q_explode(spark, sf_dir):
    """Explode the ship date on '-' (three rows per line)."""
    return RS.explode(C.lineitem_rows(spark, sf_dir), 4, "-")


def _subtitled(c):
    """Input for subtitles: every third row keeps only its first cell."""
    return c.withColumn("value", F.when((F.col("row_idx") % 3 == 0) & (F.col("col_idx") > 0), F.lit(""))
                        .otherwise(F.col("value")))


@register("reshape_subtitles", f4("""s AS (SELECT case_id, table_name, row_idx, col_idx, col_name,
  CASE WHEN row_idx % 3 = 0 AND col_idx > 0 THEN '' ELSE value END AS value FROM cells),
r AS (SELECT case_id, table_name, row_idx, count(*) FILTER (WHERE value <> '') AS ne,
      max(CASE WHEN col_idx = 0 THEN value END) AS first FROM s GROUP BY ALL),
r2 AS (SELECT *, ne = 1 AND first <> '' AS is_sub FROM r),
r3 AS (SELECT *, last_value(CASE WHEN is_sub THEN first END IGNORE NULLS) OVER (PARTITION BY case_id, table_name
       ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sub FROM r2),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id, table_name ORDER BY row_idx) - 1 AS new FROM r3 WHERE NOT is_sub)
""" + OUT + """(SELECT s.case_id, s.table_name, k.new AS row_idx, s.col_idx + 1 AS col_idx, s.col_name, s.value
  FROM s JOIN k ON s.case_id = k.case_id AND s.table_name = k.table_name AND s.row_idx = k.row_idx
  UNION ALL SELECT case_id, table_name, new, 0, 'subtitle', coalesce(sub, '') FROM k)"""))
def q_subtitles(spark, sf_dir):
    """Subtitle rows become a leading column."""
    return RS.subtitles(_subtitled(_cells(spark, sf_dir)))


def _renamed(c):
    """Input for wide_to_long: columns 1..4 named a_1, b_1, a_2, b_2."""
    return c.withColumn("names", F.array(F.lit("l_linenumber"), F.lit("a_1"), F.lit("b_1"), F.lit("a_2"), F.lit("b_2")))


@register("reshape_wide_to_long", f4("""x AS (SELECT 1)
""" + OUT + """(
  SELECT case_id, table_name, row_idx * 2 + j AS row_idx, col_idx, 'l_linenumber' AS col_name, value
    FROM cells, (SELECT unnest([0, 1]) AS j) WHERE col_idx = 0
  UNION ALL SELECT case_id, table_name, row_idx * 2 + (col_idx - 1) // 2, 1, 'suffix',
    CAST((col_idx - 1) // 2 + 1 AS VARCHAR) FROM cells WHERE col_idx IN (1, 3)
  UNION ALL SELECT case_id, table_name, row_idx * 2 + (col_idx - 1) // 2, 2 + (col_idx - 1) % 2,
    CASE WHEN (col_idx - 1) % 2 = 0 THEN 'a' ELSE 'b' END, value FROM cells WHERE col_idx BETWEEN 1 AND 4)"""))
def q_wide_to_long(spark, sf_dir):
    """(a_1, b_1, a_2, b_2) -> rows per suffix with columns suffix, a, b."""
    return RS.wide_to_long(_renamed(C.lineitem_rows(spark, sf_dir)), 1, 4)


@register("reshape_steps", f4("""h AS (SELECT case_id, table_name, row_idx, col_idx, col_name,
  CASE WHEN col_idx = 3 AND row_idx % 2 = 1 THEN '' ELSE value END AS value FROM cells),
f AS (SELECT case_id, table_name, row_idx, col_idx, col_name,
  CASE WHEN col_idx <= 3 THEN coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY case_id, table_name, col_idx
       ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') ELSE value END AS value FROM h)
""" + OUT + """(SELECT case_id, table_name, floor(row_idx / 2) AS row_idx,
  (row_idx % 2) * 5 + col_idx AS col_idx, col_name || '_' || CAST(row_idx % 2 AS VARCHAR) AS col_name, value FROM f)"""))
def q_steps(spark, sf_dir):
    """An operator list (ffill then pivot), names as the reshape answers write them."""
    steps = [{"transformation": "ffill", "ffill_end_idx": 3}, {"operator": "pivot", "pivot_row_frequency": 2}]
    return RS.run_steps(_holes(C.lineitem_rows(spark, sf_dir)), steps)


@register("list_to_table", f4("""r AS (SELECT case_id, row_idx, string_agg(value, ';' ORDER BY col_idx) AS line,
  string_agg(value, '||' ORDER BY col_idx) AS t FROM cells GROUP BY ALL)
SELECT case_id, ';' AS delimiter, string_agg(t, chr(10) ORDER BY row_idx) AS "table" FROM r GROUP BY case_id"""))
def q_list_to_table(spark, sf_dir):
    """Each order's rows written with ';' are recovered as a '||' table."""
    c = _cells(spark, sf_dir)
    rows = c.groupBy("case_id", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]),
                     ";").alias("line"))
    texts = rows.groupBy("case_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return RS.list_to_table(texts, "case_id", "text")
