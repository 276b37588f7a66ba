"""Table serialisers (Z1-Z17): cells -> one text per table.

Each takes cells or table rows (``cells.as_rows``): cells -> table rows (``array_sort`` of
``(col_idx, value)`` structs, so order is exact) -> one text per table. The
row-level key contains the table key, so when the input is already partitioned
by ``case_id`` both levels run without a new shuffle; otherwise the planner
shuffles once per level. A single enormous table becomes one string by
definition: bound it with ``first_n_rows`` (P1) first, as the prompts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.operators.cells import TABLE_KEYS, as_rows, row_cells, with_index


def _json_str(c: Column) -> Column:
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _csv_field(c: Column) -> Column:
    """Minimal CSV quoting: quote when the value holds , " CR or LF; double inner quotes."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))) \
        .otherwise(c)


def _html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _rows(cells: DataFrame, cell_text) -> DataFrame:
    """(table keys, row_idx, cs: the row's cells in column order) of cells or table rows."""
    return as_rows(cells).select(*TABLE_KEYS, "row_idx", row_cells().alias("cs"))


def _by_column(rows: DataFrame, fact, worst) -> DataFrame:
    """Whole tables from their rows: ``rs``, an array of (row_idx, idx, names, vals, by), where ``by`` holds per cell what
    ``worst`` makes of the ``fact`` of all values of its column.

    A text of a table is one string, so its rows may be one group; rows of equal columns are folded position by position.
    """
    row = F.struct("row_idx", "idx", "names", "vals")
    t = rows.groupBy(*TABLE_KEYS).agg(F.array_sort(F.collect_list(row)).alias("rs"))
    even = F.forall("rs", lambda r: r["idx"] == F.get("rs", F.lit(0))["idx"])
    folded = F.aggregate("rs", F.transform(F.get("rs", F.lit(0))["vals"], fact), lambda acc, r: F.zip_with(acc, F.transform(r["vals"], fact), worst))
    t = t.withColumn("_even", even).withColumn("_folded", F.when(F.col("_even"), folded))
    cells = F.flatten(F.transform("rs", lambda r: F.arrays_zip(r["idx"].alias("i"), F.transform(r["vals"], fact).alias("f"))))
    t = t.withColumn("_cells", F.when(~F.col("_even"), cells))

    def of(i: Column) -> Column:
        mine = F.transform(F.filter("_cells", lambda x: x["i"] == i), lambda x: x["f"])
        return F.aggregate(mine, F.get(mine, F.lit(0)), worst)

    return t.select(*TABLE_KEYS, F.transform("rs", lambda r: F.struct(
        r["row_idx"].alias("row_idx"), r["idx"].alias("idx"), r["names"].alias("names"), r["vals"].alias("vals"),
        F.when(F.col("_even"), F.col("_folded")).otherwise(F.transform(r["idx"], of)).alias("by"))).alias("rs"))


def _text(rows: DataFrame, line: Column, header: Column | None, sep: str = "\n", trailing: str = "",
          leading_rule: Column | None = None) -> DataFrame:
    r = rows.select(*TABLE_KEYS, "row_idx", line.alias("line"),
                    (header if header is not None else F.lit(None).cast("string")).alias("hdr"))
    t = r.groupBy(*TABLE_KEYS).agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("ls"),
                                   F.min_by("hdr", "row_idx").alias("hdr"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), sep)
    parts = []
    if header is not None:
        parts += [F.col("hdr"), F.lit(sep)]
        if leading_rule is not None:
            parts += [leading_rule, F.lit(sep)]
    parts += [body, F.lit(trailing)]
    return t.select(*TABLE_KEYS, F.concat(*parts).alias("text"))


def _vals(cs: Column, f) -> Column:
    return F.transform(cs, f)


def _pipe(items: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(items, "|"), F.lit("|"))


# Z1 ------------------------------------------------------------------------
def text_rows(cells: DataFrame, sep: str = ".", nan_token: str = "") -> DataFrame:
    """``name: value. name: value`` per row, rows joined by newline (values stripped)."""
    rows = _rows(cells, None)
    line = F.array_join(_vals(F.col("cs"), lambda c: F.ltrim(F.concat(
        c["col_name"], F.lit(": "), F.when(c["value"] == "", F.lit(nan_token)).otherwise(F.trim(c["value"]))))),
        sep + " ")
    return _text(rows, line, None)


# Z6 / Z7 / Z8 / Z9 -----------------------------------------------------------
def markdown_short_line(cells: DataFrame) -> DataFrame:
    """``|a|b|`` header, ``|---|---|`` rule, ``|x|y|`` rows, each line ending in newline."""
    rows = _rows(cells, None)
    hdr = _pipe(_vals(F.col("cs"), lambda c: c["col_name"]))
    rule = _pipe(_vals(F.col("cs"), lambda c: F.lit("---")))
    line = _pipe(_vals(F.col("cs"), lambda c: c["value"]))
    return _text(rows, line, F.concat(hdr, F.lit("\n"), rule), trailing="\n")


def key_value(cells: DataFrame) -> DataFrame:
    """``|c: x|c: y|`` per row."""
    rows = _rows(cells, None)
    line = _pipe(_vals(F.col("cs"), lambda c: F.concat(c["col_name"], F.lit(": "), c["value"])))
    return _text(rows, line, None, trailing="\n")


def markdown_short(cells: DataFrame) -> DataFrame:
    """Header line and rows, no rule line."""
    rows = _rows(cells, None)
    return _text(rows, _pipe(_vals(F.col("cs"), lambda c: c["value"])),
                 _pipe(_vals(F.col("cs"), lambda c: c["col_name"])), trailing="\n")


def values_only(cells: DataFrame) -> DataFrame:
    """Rows only."""
    rows = _rows(cells, None)
    return _text(rows, _pipe(_vals(F.col("cs"), lambda c: c["value"])), None, trailing="\n")


# Z2 / Z3 / Z4 / Z5 -----------------------------------------------------------
def markdown(cells: DataFrame, header: bool = True, float_digits: int | None = None) -> DataFrame:
    """Z2 (Z4 with ``float_digits=10``, Z5 with ``header=False``): aligned pipe table.

    Our own layout rule: every column as wide as its longest text, left aligned,
    ``| a | b |`` lines and a ``|:---|`` rule.
    """
    rows = as_rows(cells)
    if float_digits is not None:
        def plain(v: Column) -> Column:
            num = v.try_cast("double")
            return F.when(num.isNotNull() & v.contains("."), F.format_string(f"%.{float_digits}f", num)).otherwise(v)
        rows = rows.withColumn("vals", F.transform("vals", plain))
    t = _by_column(rows, lambda v: F.length(v), lambda a, b: F.greatest(a, b))
    width = lambda r: F.zip_with(r["by"], r["names"], lambda n, name: F.greatest(n, F.length(name) if header else F.lit(1), F.lit(3)))
    padded = lambda texts, wid: F.concat(F.lit("| "), F.array_join(F.zip_with(texts, wid, lambda x, n: F.rpad(x, n, " ")), " | "), F.lit(" |"))
    line = F.array_join(F.transform("rs", lambda r: padded(r["vals"], width(r))), "\n")
    first = F.get("rs", F.lit(0))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(width(first), lambda n: F.concat(F.lit(":"), F.repeat(F.lit("-"), n + 1))), "|"), F.lit("|"))
    parts = [padded(first["names"], width(first)), F.lit("\n"), rule, F.lit("\n")] if header else []
    return t.select(*TABLE_KEYS, F.concat(*parts, line).alias("text"))


def markdown_with_index(cells: DataFrame) -> DataFrame:
    """Z3."""
    return markdown(with_index(cells, ""))


# Z10 / Z11 / Z12 -----------------------------------------------------------
def html(cells: DataFrame, header: bool = True) -> DataFrame:
    """Z10 (Z12 with ``header=False``): ``<table>`` with escaped cells (own layout)."""
    rows = _rows(cells, None)
    line = F.concat(F.lit("<tr>"), F.array_join(_vals(F.col("cs"), lambda c: F.concat(
        F.lit("<td>"), _html(c["value"]), F.lit("</td>"))), ""), F.lit("</tr>"))
    hdr = F.concat(F.lit("<table>\n<thead><tr>"), F.array_join(_vals(F.col("cs"), lambda c: F.concat(
        F.lit("<th>"), _html(c["col_name"]), F.lit("</th>"))), ""), F.lit("</tr></thead>\n<tbody>"))
    t = _text(rows, line, hdr if header else F.lit("<table>\n<tbody>"))
    return t.withColumn("text", F.concat("text", F.lit("\n</tbody>\n</table>")))


def html_with_index(cells: DataFrame) -> DataFrame:
    """Z11."""
    return html(with_index(cells, ""))


# Z13 / Z14 -----------------------------------------------------------------
#: text of a JSON number
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _own_names(names: Column) -> Column:
    """P6 inside a row: names of its cells in order, later copies suffixed ``_2, _3``; only rows with a copy compare names."""
    nth = lambda x, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x))
    suffixed = F.transform(names, lambda x, i: F.when(nth(x, i) == 1, x).otherwise(F.concat(x, F.lit("_"), nth(x, i).cast("string"))))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(suffixed)


def json_lines(cells: DataFrame, index: bool = False, typed: bool = False) -> DataFrame:
    """One JSON object per row, repeated headers suffixed ``_2, _3``.

    ``typed`` writes the values of a column as numbers if all of them are (the typed reader's columns); otherwise values are texts.
    """
    head = lambda i: F.concat(F.lit('{"index":'), i.cast("string"), F.lit(",")) if index else F.lit("{")
    if not typed:
        rows = _rows(cells, None).withColumn("names", _own_names(F.transform("cs", lambda x: x["col_name"])))
        parts = F.zip_with("cs", "names", lambda x, name: F.concat(_json_str(name), F.lit(":"), _json_str(x["value"])))
        return _text(rows, F.concat(head(F.col("row_idx")), F.array_join(parts, ","), F.lit("}")), None, trailing="\n")
    t = _by_column(as_rows(cells), lambda v: v.rlike(_NUMBER), lambda a, b: F.least(a, b))
    part = lambda x: F.concat(_json_str(x["names"]), F.lit(":"), F.when(x["by"], x["vals"]).otherwise(_json_str(x["vals"])))
    line = lambda r: F.concat(head(r["row_idx"]), F.array_join(F.transform(F.arrays_zip(
        _own_names(r["names"]).alias("names"), r["vals"].alias("vals"), r["by"].alias("by")), part), ","), F.lit("}"))
    return t.select(*TABLE_KEYS, F.concat(F.array_join(F.transform("rs", line), "\n"), F.lit("\n")).alias("text"))


# Z15 / Z16 / Z17 -----------------------------------------------------------
def csv(cells: DataFrame, header: bool = True, index: bool = False) -> DataFrame:
    """Z15 (Z16 with ``index=True``, Z17 with ``header=False``): minimal quoting.

    Z15 ends with a newline; the index and no-header variants are stripped.
    """
    c = with_index(cells, "") if index else cells
    rows = _rows(c, None)
    line = F.array_join(_vals(F.col("cs"), lambda x: _csv_field(x["value"])), ",")
    hdr = F.array_join(_vals(F.col("cs"), lambda x: _csv_field(x["col_name"])), ",")
    plain = header and not index
    t = _text(rows, line, hdr if header else None, trailing="\n" if plain else "")
    return t


SERIALIZERS = {
    "text": text_rows,
    "markdown": markdown,
    "markdown_index": markdown_with_index,
    "markdown_float10": lambda c: markdown(c, float_digits=10),
    "markdown_noheader": lambda c: markdown(c, header=False),
    "markdown_shortline": markdown_short_line,
    "key_value": key_value,
    "markdown_short": markdown_short,
    "values_only": values_only,
    "html": html,
    "html_index": html_with_index,
    "html_noheader": lambda c: html(c, header=False),
    "json": json_lines,
    "json_index": lambda c: json_lines(c, index=True),
    "json_typed": lambda c: json_lines(c, typed=True),
    "csv": csv,
    "csv_index": lambda c: csv(c, index=True),
    "csv_noheader": lambda c: csv(c, header=False),
}
