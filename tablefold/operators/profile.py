"""Table profiling and routing (Q1-Q11): the six table tools as DataFrame operators.

Tables are Spark tables or temp views; each tool is one small query. Results
are whole unless the caller passes a limit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablefold.functions import extract as X

SQL_ONLY_CELLS, HYBRID_CELLS = 1842, 488   # fixed values: size cut-offs of the strategy choice
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def schema_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Q1: (table, col_idx, column, type) for every table (driver metadata only)."""
    rows = [(t, i, c, d) for t, df in tables.items() for i, (c, d) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, col_idx int, column string, type string")


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2: row count per table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
             for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """Q3/M6: the first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


_SELECT_ONLY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


def run_select(spark: SparkSession, sql: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Q4: run a SELECT; return (rows, total row count). Anything else is refused.

    All rows come back unless the caller asks for ``limit``; order the SELECT to make that cut stable.
    """
    if not _SELECT_ONLY.match(sql):
        raise ValueError("only SELECT statements are allowed")
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit), df.agg(F.count(F.lit(1)).alias("total_rows"))


def distinct_values(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Q5: all distinct values, ordered.

    With ``limit`` the first so many and a ``truncated`` flag: one value more is taken to see whether
    any is left (a top-k, so the window runs over at most ``limit + 1`` rows).
    """
    d = df.select(col).distinct().orderBy(col)
    if limit is None:
        return d
    first = d.limit(limit + 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return first.orderBy(col).limit(limit).select(col, (F.col("_n") > limit).alias("truncated"))


def column_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q6: min / max / avg of numeric columns, one output row per column (unpivot, one pass)."""
    cols = cols or [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "v")
    return long.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"))


def route(cells: Column) -> Column:
    """Q8: > 1842 cells -> sql_only, > 488 -> hybrid, else direct."""
    return F.when(cells > SQL_ONLY_CELLS, "sql_only").when(cells > HYBRID_CELLS, "hybrid").otherwise("direct")


def route_task(task: Column, cells: Column) -> Column:
    """Q9: in auto mode NL2SQL goes straight to SQL, other tasks by size."""
    return F.when(task == "NL2SQL", F.lit("direct_sql")).otherwise(route(cells))


def context_text(cells_df: DataFrame, shapes: DataFrame, hybrid_rows: int) -> DataFrame:
    """Q10: per table: schema line, then all rows of a direct table, the first ``hybrid_rows`` of a
    hybrid one and none of a sql_only one (it is read by queries; ``strategy`` says so). Takes cells or table rows."""
    from tablefold.operators.cells import as_rows
    from tablefold.operators.serialize import markdown_short_line
    rows = as_rows(cells_df)
    s = shapes.withColumn("strategy", route(F.col("n_cells")))
    heads = rows.filter(F.col("row_idx") == 0).select("case_id", "table_name", F.array_join("names", ", ").alias("schema"))
    shown = s.select("case_id", "table_name", F.when(F.col("strategy") == "hybrid", hybrid_rows).alias("_rows"), "strategy")
    keep = rows.join(shown.filter(F.col("strategy") != "sql_only").drop("strategy"), ["case_id", "table_name"])
    body = markdown_short_line(keep.filter(F.col("_rows").isNull() | (F.col("row_idx") < F.col("_rows"))).drop("_rows"))
    out = s.join(heads, ["case_id", "table_name"], "left").join(body, ["case_id", "table_name"], "left")
    return out.select("case_id", "table_name", "strategy", F.concat(
        F.lit("Columns: "), F.col("schema"),
        F.when(F.col("text").isNotNull(), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.lit(""))).alias("context"))


def replay_calls(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """Q11: tool calls parsed from text (X10), dispatched by tool name.

    ``count_rows`` answers from a per-table count table (``counts(table, n_rows)``)
    by one join; unknown tools get an error text. Each tool is one join/aggregate.
    """
    c = calls.withColumn("_call", X.parse_tool_call(F.col("text")))
    c = c.withColumn("tool", F.col("_call.name")).withColumn(
        "table_arg", F.try_element_at(F.col("_call.arguments"), F.lit("table_name")))
    cr = c.filter(F.col("tool") == "count_rows").join(
        counts.withColumnRenamed("table", "table_arg"), "table_arg", "left")
    cr = cr.withColumn("result", F.coalesce(F.col("n_rows").cast("string"), F.lit("Error: table not found")))
    other = c.filter((F.col("tool") != "count_rows") | F.col("tool").isNull()).withColumn(
        "result", F.concat(F.lit("Error: unknown tool "), F.coalesce(F.col("tool"), F.lit(""))))
    cols = [x for x in calls.columns] + ["tool", "table_arg", "result"]
    return cr.select(*cols).unionByName(other.select(*cols))
