"""The long ``cells`` layout and the per-table row/column processors.

``cells(case_id, table_name, row_idx, col_idx, col_name, value)`` holds many
small tables of different shapes in one DataFrame. Every per-table operator
is a window or aggregate keyed by ``(case_id, table_name)``; when the input is
already hash-partitioned by ``case_id`` (as :func:`lineitem_cells` leaves it)
the planner reuses that partitioning and adds no shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.sources.tables import table

TABLE_KEYS = ["case_id", "table_name"]
CELL_COLUMNS = ["case_id", "table_name", "row_idx", "col_idx", "col_name", "value"]

# the case table of each order (fixed recipe: 5 columns, rows in line order)
F4_COLUMNS = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
F4_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


def frame_to_rows(df: DataFrame, case_col: str, name: str, columns: list[str], order: list[str],
                  texts: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` grouped into one table per ``case_col`` -> table rows (:func:`as_rows`).

    ``row_idx`` is dense per case in ``order``; every value is text ('' for NULL).
    One shuffle (the window) on ``case_col``; its order by case is kept, which windows over tables use.
    """
    texts = texts or {}
    w = Window.partitionBy(case_col).orderBy(*order)
    ranked = df.select(case_col, *{c for c in columns + order}, (F.row_number().over(w) - 1).alias("row_idx"))
    return ranked.select(F.col(case_col).alias("case_id"), F.lit(name).alias("table_name"), F.col("row_idx").cast("int").alias("row_idx"),
                         F.array(*[F.lit(i) for i in range(len(columns))]).alias("idx"), F.array(*[F.lit(c) for c in columns]).alias("names"),
                         F.array(*[F.coalesce(texts.get(c, F.col(c).cast("string")), F.lit("")) for c in columns]).alias("vals"))


def as_rows(data: DataFrame) -> DataFrame:
    """Table rows: the table keys, ``row_idx`` and the row's cells in column order as the arrays ``idx``, ``names`` and
    ``vals``. Cells are gathered by row; table rows are returned as they are, so that operators take either."""
    if "vals" in data.columns:
        return data
    cell = F.struct(F.col("col_idx").cast("int").alias("col_idx"), "col_name", "value")
    g = data.groupBy(*TABLE_KEYS, "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("cs"))
    of = lambda f: F.transform("cs", lambda x: x[f])
    return g.select(*TABLE_KEYS, "row_idx", of("col_idx").alias("idx"), of("col_name").alias("names"), of("value").alias("vals"))


def row_cells() -> Column:
    """The cells of a table row as an array of (col_idx, col_name, value)."""
    return F.arrays_zip(F.col("idx").alias("col_idx"), F.col("names").alias("col_name"), F.col("vals").alias("value"))


def as_cells(rows: DataFrame) -> DataFrame:
    """Table rows -> cells; cells are returned as they are."""
    if "vals" not in rows.columns:
        return rows
    return rows.select(*TABLE_KEYS, "row_idx", F.inline(row_cells()))


def frame_to_cells(df: DataFrame, case_col: str, name: str, columns: list[str], order: list[str],
                   texts: dict[str, Column] | None = None) -> DataFrame:
    """:func:`frame_to_rows` as cells."""
    return as_cells(frame_to_rows(df, case_col, name, columns, order, texts))


def lineitem_rows(spark, sf_dir: str) -> DataFrame:
    """one 5-column table per order (case_id = order key), as table rows."""
    li = table(spark, sf_dir, "lineitem")
    texts = {"l_quantity": F.col("l_quantity").cast("int").cast("string"),
             "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")}
    return frame_to_rows(li, "l_orderkey", "lineitem", F4_COLUMNS, F4_ORDER, texts)


def lineitem_cells(spark, sf_dir: str) -> DataFrame:
    """F4 as cells."""
    return as_cells(lineitem_rows(spark, sf_dir))


def dataframe_cells(df: DataFrame, case_id: str, name: str, order: list[str]) -> DataFrame:
    """One whole DataFrame as one table (e.g. ``region``, ``nation``)."""
    d = df.withColumn("_case", F.lit(case_id))
    return frame_to_cells(d, "_case", name, [c for c in df.columns], order)


# P1 ------------------------------------------------------------------------
def first_n_rows(cells: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every table (row_idx is dense, so a plain filter)."""
    return cells.filter(F.col("row_idx") < n)


# P2 / P3 / P4 ----------------------------------------------------------------
def _hash_rank(cells: DataFrame, idx: str, seed: int, keep_first: int = 0) -> DataFrame:
    """Reassign ``idx`` by a seeded hash order inside each table; the first ``keep_first`` stay."""
    keys = TABLE_KEYS
    ids = cells.select(*keys, idx).distinct()
    h = F.xxhash64(*[F.col(k) for k in keys], F.col(idx), F.lit(seed))
    moving = F.col(idx) >= keep_first
    w = Window.partitionBy(*keys, moving).orderBy(h, F.col(idx))
    new = F.when(moving, F.row_number().over(w) - 1 + keep_first).otherwise(F.col(idx))
    mapping = ids.select(*keys, idx, new.cast("int").alias("_new"))
    return cells.join(mapping, keys + [idx]).drop(idx).withColumnRenamed("_new", idx).select(*cells.columns)


def shuffle_rows(cells: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a seeded pseudo-random order (reproducible, not pandas' order; ledger L21)."""
    return _hash_rank(cells, "row_idx", seed)


def shuffle_columns(cells: DataFrame, seed: int = 42, keep: int = 0) -> DataFrame:
    """Columns in a seeded order; ``keep=3`` leaves the first three in place."""
    return _hash_rank(cells, "col_idx", seed, keep_first=keep)


# P5 ------------------------------------------------------------------------
def apply(cells: DataFrame, processors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """P5: processors applied left to right."""
    return reduce(lambda d, p: d.transform(p), processors, cells)


# P6 / P7 -------------------------------------------------------------------
def dedup_headers(cells: DataFrame, start: int = 2, blank: str | None = None) -> DataFrame:
    """Repeated column names get ``_<k>`` suffixes (k from ``start``); blank -> ``blank``.

    ``start=2``: first copy keeps its name, later ones ``_2, _3``; ``start=1``
    (parsed text tables) suffixes every later copy from ``_1``.
    """
    name = F.col("col_name")
    if blank is not None:
        name = F.when(F.trim(name) == "", F.lit(blank)).otherwise(name)
    heads = cells.select(*TABLE_KEYS, "col_idx", name.alias("_n")).distinct()
    w = Window.partitionBy(*TABLE_KEYS, "_n").orderBy("col_idx")
    k = F.row_number().over(w)
    suffix = (k if start == 2 else k - 1)
    new = F.when(k == 1, F.col("_n")).otherwise(F.concat(F.col("_n"), F.lit("_"), suffix.cast("string")))
    m = heads.select(*TABLE_KEYS, "col_idx", new.alias("_name"))
    return cells.join(m, TABLE_KEYS + ["col_idx"]).drop("col_name").withColumnRenamed("_name", "col_name") \
        .select(*cells.columns)


# P8 ------------------------------------------------------------------------
def repair_width(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Every row gets exactly the header's columns: missing cells '' , extra cells dropped."""
    rows = cells.select(*TABLE_KEYS, "row_idx").distinct()
    full = rows.join(header.select(*TABLE_KEYS, "col_idx", "col_name"), TABLE_KEYS)
    return full.join(cells.select(*TABLE_KEYS, "row_idx", "col_idx", "value"),
                     TABLE_KEYS + ["row_idx", "col_idx"], "left") \
        .select(*TABLE_KEYS, "row_idx", "col_idx", "col_name", F.coalesce("value", F.lit("")).alias("value"))


# P9 ------------------------------------------------------------------------
def with_index(cells: DataFrame, name: str = "index") -> DataFrame:
    """Prepend a row-number column (col_idx 0), shifting the others right, to cells or, inside each row, to table rows; a row without cells is none."""
    if "vals" in cells.columns:
        return cells.where(F.size("idx") > 0).select(
            *TABLE_KEYS, "row_idx", F.concat(F.array(F.lit(0)), F.transform("idx", lambda i: i + 1)).alias("idx"),
            F.concat(F.array(F.lit(name)), F.col("names")).alias("names"), F.concat(F.array(F.col("row_idx").cast("string")), F.col("vals")).alias("vals"))
    idx = cells.select(*TABLE_KEYS, "row_idx").distinct().select(
        *TABLE_KEYS, "row_idx", F.lit(0).alias("col_idx"), F.lit(name).alias("col_name"),
        F.col("row_idx").cast("string").alias("value"))
    shifted = cells.withColumn("col_idx", F.col("col_idx") + 1)
    return shifted.unionByName(idx.select(*shifted.columns))


# P10 -----------------------------------------------------------------------
def drop_empty_tables(cells: DataFrame) -> DataFrame:
    """P10: only tables with rows: one whose cells are all '' stays; one without rows has no cells, or cells without a row number."""
    return cells.where(F.col("row_idx").isNotNull())


# Q7 ------------------------------------------------------------------------
def table_shape(cells: DataFrame) -> DataFrame:
    """Q7: rows, cols, cells and size band per table (bands: < 500 small, < 2000 medium), of cells or table rows."""
    whole = "vals" in cells.columns
    g = cells.groupBy(*TABLE_KEYS).agg(
        (F.max("row_idx") + 1).cast("bigint").alias("n_rows"),
        (F.max(F.array_max("idx") if whole else "col_idx") + 1).cast("bigint").alias("n_cols"),
        (F.sum(F.size("vals")) if whole else F.count(F.lit(1))).cast("bigint").alias("n_cells"))
    return g.withColumn("size_category", F.when(F.col("n_cells") < 500, "small")
                        .when(F.col("n_cells") < 2000, "medium").otherwise("large"))
