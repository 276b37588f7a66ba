"""Pipe tables embedded in text -> cells (S19, with P7, P8, P10 and W4).

Each text is read within its row: runs of ``|...|`` lines are its blocks, the first line of a block
is the header, rule lines are dropped, the rest are rows; cells are split on ``|``. Nothing is
shuffled or sorted. Texts without an id are left out; texts that share one give tables of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.functions.extract import pystrip

RULE_CELL = r"^\s*:?-+:?\s*$"


def _names(header: Column) -> Column:
    """Blank -> unnamed, repeats -> _1, _2 ..."""
    named = F.transform(header, lambda x: F.when(x == "", F.lit("unnamed")).otherwise(x))
    before = lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x))
    suffixed = F.transform(named, lambda x, i: F.when(before(x, i) == 0, x).otherwise(F.concat(x, F.lit("_"), before(x, i).cast("string"))))
    return F.when(F.size(F.array_distinct(named)) == F.size(named), named).otherwise(suffixed)


def extract_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts -> cells(case_id, table_name='table_<k>', row_idx, col_idx, col_name, value)."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: pystrip(x))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.startswith("|") & x.endswith("|"), x).otherwise(F.lit(""))), "\n")
    blocks = F.filter(F.split(F.regexp_replace(marked, r"^\n+|\n+$", ""), r"\n\n+"), lambda b: b != "")     # an empty line ends a block
    cells_of = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: pystrip(c))
    parts = F.transform(blocks, lambda b: F.transform(F.split(b, "\n"), cells_of))
    rule = lambda p: F.forall(p, lambda c: c.rlike(RULE_CELL))
    tables = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("case_id"), parts.alias("parts"))
    tables = tables.select("case_id", F.transform("parts", lambda p: F.struct(
        F.get(p, F.lit(0)).alias("header"), F.filter(F.slice(p, F.lit(2), F.size(p)), lambda r: ~rule(r)).alias("rows"))).alias("tables"))
    # tables with at least one data row, numbered in text order (P10)
    tables = tables.select("case_id", F.posexplode(F.filter("tables", lambda t: F.size(t["rows"]) > 0)).alias("k", "t"))
    rows = tables.select("case_id", F.concat(F.lit("table_"), F.col("k").cast("string")).alias("table_name"), _names(F.col("t.header")).alias("names"),
                         F.posexplode("t.rows").alias("row_idx", "parts"))
    # every row gets exactly the header's columns
    cells = F.transform("names", lambda n, i: F.struct(i.alias("col_idx"), n.alias("col_name"), F.coalesce(F.get("parts", i), F.lit("")).alias("value")))
    return rows.select("case_id", "table_name", "row_idx", F.inline(cells))
