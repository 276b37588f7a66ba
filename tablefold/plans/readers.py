"""Case reading queries (S1-S6, T8): CSV texts written by Spark from the given tables, read back as cells.

Each text has quoted commas, quotes and line breaks, a blank line and leading zeros; the ragged
ones have short and long rows and run to hundreds of rows, some are a header alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.operators.prompts import build_metadata
from tablefold.plans.base import register
from tablefold.sources import tables as T
from tablefold.sources.tables import table

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
NAMES = ["id", "qty", "note", "late", "note.1"]
HEADER = "id,qty,note,late,note"          # a repeated name

RANKED = f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INTEGER) AS row_idx FROM lineitem)"""
NOTE = "l_returnflag || ', \"' || l_linestatus || '\"' || chr(10) || 'line ' || CAST(l_linenumber AS VARCHAR)"


def _csv(df, key, body, header):
    """(file_path, text) with one CSV text for each value of ``key``."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*ORDER.split(", "), body.alias("line")))).alias("xs"))
    text = F.concat(F.lit(header + "\r\n\r\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"))
    return g.select(F.concat(F.lit("file:/ds/"), F.col(key).cast("string"), F.lit("/data.csv")).alias("file_path"), text.alias("text"))


def order_texts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    note = F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(', ""'), F.col("l_linestatus"), F.lit('""\nline '), F.col("l_linenumber").cast("string"), F.lit('"'))
    line = F.concat_ws(",", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50")),
                       note, F.when(F.col("l_linestatus") == "O", "TRUE").otherwise("False"), F.lit(""))
    return _csv(li, "l_orderkey", line, HEADER)


def _cells_sql(values: list[str]) -> str:
    return "WITH " + RANKED + " " + " UNION ALL ".join(
        f"SELECT CAST(l_orderkey AS VARCHAR) AS case_id, row_idx, {i} AS col_idx, '{n}' AS col_name, {v} AS value FROM ranked"
        for i, (n, v) in enumerate(zip(NAMES, values)))


TYPED = ["CAST(l_linenumber AS VARCHAR)", "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5'", NOTE,
         "CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END", "''"]
TEXTS = ["lpad(CAST(l_linenumber AS VARCHAR), 3, '0')", "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.50'", NOTE,
         "CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'False' END", "''"]
COLUMNS = ["case_id", "row_idx", "col_idx", "col_name", "value"]


@register("read_cases_typed", _cells_sql(TYPED))
def q_read_typed(spark, sf_dir):
    """Types inferred per column; a float or a truth value is printed as read."""
    return T.case_cells(T.parse_case_texts(order_texts(spark, sf_dir), "pandas")).select(*COLUMNS)


@register("read_cases_text", _cells_sql(TEXTS))
def q_read_text(spark, sf_dir):
    """Every value as written."""
    return T.case_cells(T.parse_case_texts(order_texts(spark, sf_dir), "pandas.str")).select(*COLUMNS)


@register("read_cases_labels", "WITH " + RANKED + " " + " UNION ALL ".join(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS case_id, row_idx, {i} AS col_idx, '{n}' AS col_name, {v} AS value, {TEXTS[0]} AS row_label FROM ranked"
    for i, (n, v) in enumerate(list(zip(NAMES, TEXTS))[1:])))
def q_read_labels(spark, sf_dir):
    """S3: the first column labels the rows."""
    return T.case_cells(T.parse_case_texts(order_texts(spark, sf_dir), "pandas.w_idx")).select(*COLUMNS, "row_label")


def ragged_texts(spark, sf_dir):
    """One text for each supplier (hundreds of rows): line 1 lacks its last field, line 2 has one too many; a part's text is a header alone."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_partkey").cast("string"),
                    F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(F.lit(","), F.col("l_returnflag"), F.lit(",surplus")))
                    .otherwise(F.concat(F.lit(","), F.col("l_returnflag"))))
    alone = table(spark, sf_dir, "part").select(F.concat(F.lit("file:/ds/part "), F.col("p_partkey").cast("string"), F.lit("/data.csv")).alias("file_path"),
                                                F.concat(F.lit("a,"), F.col("p_brand")).alias("text"))
    return _csv(li, "l_suppkey", line, "line,part,flag").unionByName(alone)


SUPPLIER_ROWS = f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS INTEGER) AS row_idx FROM lineitem)"""


@register("read_cases_ragged", "WITH " + SUPPLIER_ROWS + " " + " UNION ALL ".join(
    f"SELECT CAST(l_suppkey AS VARCHAR) AS case_id, row_idx, {i} AS col_idx, '{n}' AS col_name, {v} AS value, l_linenumber = 2 AS bad_row FROM ranked"
    for i, (n, v) in enumerate([("line", "CAST(l_linenumber AS VARCHAR)"), ("part", "CAST(l_partkey AS VARCHAR)"),
                                ("flag", "CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END")])))
def q_read_ragged(spark, sf_dir):
    """No row is lost; short rows are padded, rows with surplus fields are marked."""
    return T.case_cells(T.parse_case_texts(ragged_texts(spark, sf_dir), "pandas")).select(*COLUMNS, "bad_row")


@register("read_case_headers", """SELECT CAST(l_suppkey AS VARCHAR) AS case_id, 'line|part|flag' AS names, CAST(count(*) AS INTEGER) AS n_rows,
    CAST(count_if(l_linenumber = 2) AS INTEGER) AS n_bad FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT 'part ' || CAST(p_partkey AS VARCHAR), 'a|' || p_brand, 0, 0 FROM part""")
def q_case_headers(spark, sf_dir):
    """Tables of a header alone are there, with no rows."""
    h = T.case_headers(T.parse_case_texts(ragged_texts(spark, sf_dir), "pandas"))
    return h.select("case_id", F.array_join("col_names", "|").alias("names"), "n_rows", "n_bad")


@register("read_cases_no_header", """SELECT CAST(c_custkey AS VARCHAR) AS case_id, 0 AS row_idx, 0 AS col_idx, '0' AS col_name, c_name AS value FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0, 1, '1', CAST(c_nationkey AS VARCHAR) FROM customer""")
def q_read_no_header(spark, sf_dir):
    """Positional names, types inferred."""
    c = table(spark, sf_dir, "customer")
    texts = c.select(F.concat(F.lit("file:/ds/"), F.col("c_custkey").cast("string"), F.lit("/data.csv")).alias("file_path"),
                     F.concat(F.col("c_name"), F.lit(",0"), F.col("c_nationkey").cast("string")).alias("text"))
    return T.case_cells(T.parse_case_texts(texts, "pandas.no_header")).select(*COLUMNS)


@register("read_named_tables", "WITH " + RANKED + f""", c AS (SELECT * FROM ranked WHERE l_orderkey % 2 = 1)
SELECT 'case ' || CAST(l_orderkey AS VARCHAR) AS case_id, row_idx, 0 AS col_idx, 'id' AS col_name, {TEXTS[0]} AS value FROM c""")
def q_named_tables(spark, sf_dir):
    """Odd orders' cases name their table in the info; even ones don't."""
    cells = T.case_cells(T.parse_case_texts(order_texts(spark, sf_dir), "pandas.str"))
    o = table(spark, sf_dir, "orders")
    cases = o.select(F.concat(F.lit("case "), F.col("o_orderkey").cast("string")).alias("case_id"), F.lit("file:/ds").alias("case_path"),
                     F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit('{"table": "./'), F.col("o_orderkey").cast("string"), F.lit('/data.csv"}')))
                     .otherwise('{"question": "?"}').alias("info_json"))
    return T.named_case_tables(cells, cases, "table").where("col_idx = 0").select(*COLUMNS)


@register("metadata_types", """SELECT o_orderkey, 'T' AS task, CAST(o_orderkey % 2 AS VARCHAR) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
  '[["' || o_orderstatus || '",1]]' AS label, 'info' AS note FROM orders""")
def q_metadata_types(spark, sf_dir):
    """Lists, numbers and truth values of the info keep their types; info wins on clashes."""
    o = table(spark, sf_dir, "orders")
    info = F.concat(F.lit('{"n": '), (F.col("o_orderkey") % 2).cast("string"), F.lit(', "flag": '), (F.col("o_orderkey") % 2 == 0).cast("string"),
                    F.lit(', "note": "info", "label": [["'), F.col("o_orderstatus"), F.lit('", 1]]}'))
    m = o.select("o_orderkey", build_metadata({"task": F.lit("T"), "note": F.lit("fixed")}, info).alias("m"))
    v = F.parse_json("m")
    return m.select("o_orderkey", *[F.variant_get(v, f"$.{k}", "string").alias(k) for k in ("task", "note")],
                    *[F.to_json(F.variant_get(v, f"$.{k}", "variant")).alias(k) for k in ("n", "flag", "label")])


@register("read_two_encodings", """SELECT CAST(c_custkey AS VARCHAR) AS case_id, 0 AS row_idx, 0 AS col_idx, 'prénom' AS col_name, 'Élodie ' || c_name || ' ß' AS value FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0, 1, 'größe', CAST(c_nationkey AS VARCHAR) FROM customer""")
def q_two_encodings(spark, sf_dir):
    """Odd customers' files are Latin-1, even ones UTF-8; each is decoded by itself."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("prénom,größe\nÉlodie "), F.col("c_name"), F.lit(" ß,"), F.col("c_nationkey").cast("string"))
    content = F.when(F.col("c_custkey") % 2 == 1, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    files = c.select(F.concat(F.lit("file:/ds/"), F.col("c_custkey").cast("string"), F.lit("/data.csv")).alias("file_path"), T.decoded(content).alias("text"))
    return T.case_cells(T.parse_case_texts(files, "pandas")).select(*COLUMNS)
