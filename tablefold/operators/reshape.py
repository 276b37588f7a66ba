"""Table reshaping on ``cells``.

Every reshape maps cells to cells with index arithmetic and takes cells or table rows
(``cells.as_rows``). Per-table facts (column count, piece counts) are windows over table rows,
which are a fifth of the cells here and mostly come in table order: cells are made last, in one
explode, and never sorted. Parameters are column indexes, as in the reshape task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators.cells import CELL_COLUMNS, TABLE_KEYS, as_cells, as_rows, row_cells


def _rows(data: DataFrame) -> DataFrame:
    """One row per table row: ``cs``, its cells in order, and ``_ncols``, the table's column count (a window, no join)."""
    rows = as_rows(data).withColumn("_ncols", F.max(F.element_at("idx", -1)).over(Window.partitionBy(*TABLE_KEYS)) + 1)
    return rows.withColumn("cs", row_cells())


def _cell(row: Column, col: Column, name: Column, value: Column) -> Column:
    return F.struct(row.cast("int").alias("row_idx"), col.cast("int").alias("col_idx"), name.alias("col_name"), value.alias("value"))


def _exploded(rows: DataFrame, *made: Column) -> DataFrame:
    return rows.select(*TABLE_KEYS, F.explode(F.concat(*made)).alias("_c")).select(*TABLE_KEYS, "_c.*").select(*CELL_COLUMNS)


def _out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("int").alias(c) if c in ("row_idx", "col_idx") else F.col(c)
                       for c in CELL_COLUMNS])


# D13 -----------------------------------------------------------------------
def stack(cells: DataFrame, start: int, end: int, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Columns ``start..end`` collapse into (variable, value) rows; other columns repeat.

    A row becomes its new cells in one explode.
    """
    k = end - start + 1
    inside = lambda x: (x["col_idx"] >= start) & (x["col_idx"] <= end)
    at, ids = F.col("row_idx") * k, F.col("_ncols") - k
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.transform(
        F.filter("cs", lambda x: ~inside(x)),
        lambda x: _cell(at + j, F.when(x["col_idx"] < start, x["col_idx"]).otherwise(x["col_idx"] - k), x["col_name"], x["value"]))))
    rng = F.filter("cs", inside)
    var = F.transform(rng, lambda x: _cell(at + x["col_idx"] - start, ids, F.lit(var_name), x["col_name"]))
    val = F.transform(rng, lambda x: _cell(at + x["col_idx"] - start, ids + 1, F.lit(value_name), x["value"]))
    return _exploded(_rows(cells), kept, var, val)


# D14 -----------------------------------------------------------------------
def wide_to_long(cells: DataFrame, start: int, end: int, sep_pattern: str = r"^(.*?)[_ ]?(\d+)$",
                 j_name: str = "suffix") -> DataFrame:
    """Repeating column groups ``stub<sep><n>`` in ``start..end`` collapse into rows per suffix.

    Stubs and suffixes are those of the first row's names, in column order; a table whose first row
    has no cell there has no result. The groups reach the rows by a window over the table's rows.
    """
    k = end - start + 1
    inside = lambda x: (x["col_idx"] >= start) & (x["col_idx"] <= end)
    part = lambda x, i: F.regexp_extract(x["col_name"], sep_pattern, i)
    rows = _rows(cells).withColumn("_h", F.when(F.col("row_idx") == 0, F.transform(F.filter("cs", inside), lambda x: F.struct(
        x["col_idx"].alias("c"), part(x, 1).alias("stub"), part(x, 2).alias("sfx")))))
    distinct = lambda f: F.array_distinct(F.transform("_h", lambda h: h[f]))
    rows = rows.withColumn("_sfx", distinct("sfx")).withColumn("_stub", distinct("stub"))
    # what becomes of each column from start to end: its suffix and stub with their places, NULL if the header lacks it
    slots = F.transform(F.sequence(F.lit(start), F.lit(end)), lambda c: F.get(F.transform(F.filter("_h", lambda h: h["c"] == c), lambda h: F.struct(
        h["sfx"].alias("sfx"), h["stub"].alias("stub"), (F.array_position(F.col("_sfx"), h["sfx"]) - 1).alias("row"),
        (F.array_position(F.col("_stub"), h["stub"]) - 1).alias("col"))), F.lit(0)))
    head = F.max(F.when(F.size("_h") > 0, F.struct(F.size("_sfx").alias("n"), slots.alias("slots"))))
    rows = rows.withColumn("_head", head.over(Window.partitionBy(*TABLE_KEYS))).where("_head IS NOT NULL")
    at, ids = F.col("row_idx") * F.col("_head.n"), F.col("_ncols") - k
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_head.n") - 1), lambda j: F.transform(
        F.filter("cs", lambda x: ~inside(x)),
        lambda x: _cell(at + j, F.when(x["col_idx"] < start, x["col_idx"]).otherwise(x["col_idx"] - k), x["col_name"], x["value"]))))
    rows = rows.withColumn("_named", F.filter(F.transform(F.filter("cs", inside), lambda x: F.struct(
        x["value"].alias("v"), F.get(F.col("_head.slots"), x["col_idx"] - start).alias("s"))), lambda y: y["s"].isNotNull()))
    vals = F.transform("_named", lambda y: _cell(at + y["s"]["row"], ids + 1 + y["s"]["col"], y["s"]["stub"], y["v"]))
    js = F.transform(F.array_distinct(F.transform("_named", lambda y: F.struct(y["s"]["row"].alias("row"), y["s"]["sfx"].alias("sfx")))),
                     lambda x: _cell(at + x["row"], ids, F.lit(j_name), x["sfx"]))
    return _exploded(rows, kept, vals, js)


# D15 -----------------------------------------------------------------------
def transpose(cells: DataFrame, header_as_column: bool = False) -> DataFrame:
    """Rows become columns. Values only by default (twice = identity, names positional);
    with ``header_as_column`` the old header becomes column 0 named ``column``."""
    cells = as_cells(cells)
    if not header_as_column:
        return _out(cells.select(*TABLE_KEYS, F.col("col_idx").alias("row_idx"), F.col("row_idx").alias("col_idx"),
                                 F.col("row_idx").cast("string").alias("col_name"), "value"))
    body = cells.select(*TABLE_KEYS, F.col("col_idx").alias("row_idx"), (F.col("row_idx") + 1).alias("col_idx"),
                        F.col("row_idx").cast("string").alias("col_name"), "value")
    names = cells.select(*TABLE_KEYS, "col_idx", "col_name").distinct().select(
        *TABLE_KEYS, F.col("col_idx").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("column").alias("col_name"),
        F.col("col_name").alias("value"))
    return _out(body.unionByName(names))


# D16 -----------------------------------------------------------------------
def pivot(cells: DataFrame, row_frequency: int) -> DataFrame:
    """Every ``row_frequency`` consecutive rows become one row; column ``c`` of the
    ``p``-th row in a group lands at ``p * ncols + c`` named ``<name>_<p>``."""
    f, p = row_frequency, F.col("row_idx") % row_frequency
    made = F.transform("cs", lambda x: _cell(F.floor(F.col("row_idx") / f), p * F.col("_ncols") + x["col_idx"],
                                             F.concat(x["col_name"], F.lit("_"), p.cast("string")), x["value"]))
    return _exploded(_rows(cells), made)


# D17 -----------------------------------------------------------------------
MOST_CARRIED = 32    # columns that ffill carries down table rows; beyond, cells are filled column by column


def ffill(cells: DataFrame, end: int) -> DataFrame:
    """Empty cells of columns ``0..end`` take the last non-empty value above them.

    Table rows give table rows: the values are carried down the rows, a column each.
    """
    if "vals" in cells.columns and end < MOST_CARRIED:
        w = Window.partitionBy(*TABLE_KEYS).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
        held = lambda c: F.nullif(F.get("vals", (F.array_position("idx", F.lit(c)) - 1).cast("int")), F.lit(""))
        above = cells.select("*", *[F.last(held(c), ignorenulls=True).over(w).alias(f"_above{c}") for c in range(end + 1)])
        fill = F.array(*[F.coalesce(f"_above{c}", F.lit("")) for c in range(end + 1)])
        vals = F.zip_with("idx", "vals", lambda c, v: F.when(c <= end, F.get(fill, c)).otherwise(v))
        return above.select(*[vals.alias(c) if c == "vals" else F.col(c) for c in cells.columns])
    cells = as_cells(cells)
    w = Window.partitionBy(*TABLE_KEYS, "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col("value") == "", None).otherwise(F.col("value"))
    filled = F.coalesce(F.last(v, ignorenulls=True).over(w), F.lit(""))
    return _out(cells.withColumn("value", F.when(F.col("col_idx") <= end, filled).otherwise(F.col("value"))))


# D18 -----------------------------------------------------------------------
def explode(cells: DataFrame, column: int, sep: str = ",") -> DataFrame:
    """The cell of ``column`` splits on ``sep`` into one row per piece (trimmed);
    the other cells repeat. Rows are renumbered by a running sum of piece counts."""
    rows = as_rows(cells).where(F.col("case_id").isNotNull() & F.col("table_name").isNotNull() & F.col("row_idx").isNotNull())
    cs = row_cells()
    split = F.flatten(F.transform(F.filter(cs, lambda x: (x["col_idx"] == column) & x["value"].isNotNull()), lambda x: F.split(x["value"], sep)))
    w = Window.partitionBy(*TABLE_KEYS).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ps", F.transform(split, lambda x: F.trim(x)))
    rows = rows.withColumn("_off", F.coalesce(F.sum(F.size("_ps")).over(w), F.lit(0))).withColumn("cs", cs)
    made = F.flatten(F.transform("_ps", lambda p, j: F.transform("cs", lambda x: _cell(
        F.col("_off") + j, x["col_idx"], x["col_name"], F.when(x["col_idx"] == column, p).otherwise(x["value"])))))
    return _exploded(rows, made)


# D19 -----------------------------------------------------------------------
def subtitles(cells: DataFrame, name: str = "subtitle") -> DataFrame:
    """Rows whose only non-empty cell is the first become a ``subtitle`` column for the rows below."""
    cells = as_cells(cells)
    rows = cells.groupBy(*TABLE_KEYS, "row_idx").agg(
        F.count_if(F.col("value") != "").alias("_ne"),
        F.max(F.when(F.col("col_idx") == 0, F.col("value"))).alias("_first"))
    rows = rows.withColumn("_is_sub", (F.col("_ne") == 1) & (F.col("_first") != ""))
    w = Window.partitionBy(*TABLE_KEYS).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sub", F.last(F.when(F.col("_is_sub"), F.col("_first")), ignorenulls=True).over(w))
    keep = rows.filter(~F.col("_is_sub"))
    keep = keep.withColumn("_new", F.row_number().over(Window.partitionBy(*TABLE_KEYS).orderBy("row_idx")) - 1)
    c = cells.join(keep.select(*TABLE_KEYS, "row_idx", "_new", "_sub"), TABLE_KEYS + ["row_idx"])
    body = c.select(*TABLE_KEYS, F.col("_new").alias("row_idx"), (F.col("col_idx") + 1).alias("col_idx"),
                    "col_name", "value")
    sub = keep.select(*TABLE_KEYS, F.col("_new").alias("row_idx"), F.lit(0).alias("col_idx"),
                      F.lit(name).alias("col_name"), F.coalesce("_sub", F.lit("")).alias("value"))
    return _out(body.unionByName(sub))


# D20 -----------------------------------------------------------------------
OPERATORS = {
    "stack": lambda c, a: stack(c, int(a["stack_start_idx"]), int(a["stack_end_idx"])),
    "wide_to_long": lambda c, a: wide_to_long(c, int(a["wide_to_long_start_idx"]), int(a["wide_to_long_end_idx"])),
    "transpose": lambda c, a: transpose(c, header_as_column=True),
    "pivot": lambda c, a: pivot(c, int(a["pivot_row_frequency"])),
    "ffill": lambda c, a: ffill(c, int(a["ffill_end_idx"])),
    "explode": lambda c, a: explode(c, int(a["explode_column_idx"])),
    "subtitles": lambda c, a: subtitles(c),
}


def run_steps(cells: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply a reshape operator list (``operator`` or ``transformation`` names the step)."""
    def one(c, step):
        op = step.get("operator", step.get("transformation"))
        return OPERATORS[op](c, step)
    return reduce(one, steps, cells)


# D21 -----------------------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|", " "]   # fixed values: tried in this order


def list_to_table(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pick the first delimiter that splits every line into the same number (> 1) of
    pieces, and rewrite the text with ``||`` between pieces; NULL when none fits."""
    lines = F.split(F.col(text_col), "\n")
    best = F.lit(None).cast("string")
    for d in reversed(DELIMITERS):
        pat = "\\" + d if d in "|" else d
        counts = F.transform(lines, lambda ln: F.size(F.split(ln, pat)))
        ok = (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 1)
        best = F.when(ok, F.lit(d)).otherwise(best)
    table = F.array_join(F.transform(lines, lambda ln: F.replace(ln, best, F.lit("||"))), "\n")
    return texts.select(F.col(id_col), best.alias("delimiter"), F.when(best.isNotNull(), table).alias("table"))
