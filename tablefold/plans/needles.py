"""Needle reports (A2, A16-A19), severe tasks (N6), usage by model (K7), needle placement (D12), typed JSON lines (Z13, P6), call arguments (X10), format sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.sources.derived import size_category
from tablefold.operators import analyze as N
from tablefold.operators import budget as K
from tablefold.operators import cells as C
from tablefold.operators import match as MT
from tablefold.operators import metrics as A
from tablefold.operators import serialize as Z
from tablefold.operators.score import score_responses
from tablefold.operators.sweep import format_sweep
from tablefold.plans.base import R, register
from tablefold.plans.tables import f4
from tablefold.plans.tools import tool_call_texts
from tablefold.sources.tables import table

NEEDLE = "Table-needle-in-a-haystack"
KEYS = ["dataset"]
VALUES = ["correct", "row_correct", "col_correct"]

NEEDLE_SQL = """b AS (SELECT CASE WHEN l_suppkey % 17 <> 0 THEN 'd' || (l_suppkey % 2) END AS dataset, l_partkey % 23 AS r, l_suppkey % 12 AS c,
  CAST(l_quantity AS INTEGER) AS q, l_partkey AS p, l_suppkey AS s, 'm' || (l_partkey % 2) AS model_name,
  CAST((l_partkey * 37 + CAST(l_quantity AS INTEGER)) % 5003 + (l_suppkey % 2) * 1000 AS DOUBLE) AS len FROM lineitem),
scored AS (SELECT *, CASE WHEN q * 60 < 500 THEN 'small' WHEN q * 60 < 2000 THEN 'medium' ELSE 'large' END AS size,
  CASE WHEN p % 41 = 0 THEN 'JSONParsingError' ELSE 'normal' END AS error,
  CASE WHEN p % 41 <> 0 AND p % 3 <> 0 AND (q * 60 < 2000 OR p % 4 = 0) THEN 1.0 ELSE 0.0 END AS row_correct,
  CASE WHEN p % 41 <> 0 AND (s + p) % 5 <> 0 THEN 1.0 ELSE 0.0 END AS col_correct FROM b),
e AS (SELECT *, row_correct * col_correct AS correct, CASE WHEN r = 0 THEN 5 ELSE ((r - 1) // 5 + 1) * 5 END AS row_bin,
  CASE WHEN c = 0 THEN 5 ELSE ((c - 1) // 5 + 1) * 5 END AS col_bin FROM scored)"""


def needle_responses(spark, sf_dir):
    """One needle answer per line: the row is right for two of three part keys (fewer on large tables), the column for four of five sums of keys."""
    li = table(spark, sf_dir, "lineitem")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    r, c = p % 23, s % 12
    text = lambda x: x.cast("string")
    row = F.when((p % 3 != 0) & ((q * 60 < 2000) | (p % 4 == 0)), r).otherwise(r + 1)
    col = F.when((s + p) % 5 != 0, F.concat(F.lit(" COL"), text(c), F.lit(" "))).otherwise(F.lit("other"))
    response = F.when(p % 41 == 0, F.lit("I can't find it")).otherwise(F.concat(
        F.lit('It is {"row": "'), text(row), F.lit('", "column": "'), col, F.lit('"}')))
    meta = F.to_json(F.struct(
        F.lit(NEEDLE).alias("task"), F.when(s % 17 != 0, F.concat(F.lit("d"), text(s % 2))).alias("dataset"), F.lit("").alias("tag"), F.lit("").alias("note"),
        r.alias("needle_row_idx"), c.alias("needle_col_idx"), F.concat(F.lit("col"), text(c)).alias("needle_col_name"),
        ((p * 37 + q) % 5003 + (s % 2) * 1000).alias("context_length"), (q * 60).alias("_table_cells"), size_category(q * 60).alias("_size_category")))
    return li.select(F.lit("Where?").alias("prompt"), meta.alias("metadata"), response.alias("response"), (100 + p % 50).cast("bigint").alias("prompt_tokens"),
                     (1 + p % 97).cast("bigint").alias("completion_tokens"), (q / 10.0).alias("time_taken"), F.concat(F.lit("m"), text(p % 2)).alias("model_name"))


def scored_needles(spark, sf_dir):
    return A.needle_columns(score_responses(needle_responses(spark, sf_dir), tasks=[NEEDLE]))


def _joined(name):
    """Means as millionths, joined: '-' for a cell without rows."""
    return F.array_join(F.transform(name, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",", "-").alias(name)


def _matrix_sql(row: str, col: str, keys: str = "dataset", source: str = "e") -> str:
    cell = lambda v: f"string_agg(coalesce(CAST(CAST(round({v} * 1e6) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY col_bin) AS {v}"
    return f"""h AS (SELECT {keys}, {row} AS row_bin, {col} AS col_bin, avg(correct) AS correct, avg(row_correct) AS row_correct, avg(col_correct) AS col_correct, count(*) AS n
  FROM {source} WHERE dataset IS NOT NULL GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT {keys}, row_bin FROM h) JOIN (SELECT DISTINCT {keys}, col_bin FROM h) USING ({keys}))
SELECT {keys}, CAST(row_bin AS BIGINT) AS row_bin, string_agg(CAST(col_bin AS VARCHAR), ',' ORDER BY col_bin) AS col_bins, {", ".join(cell(v) for v in VALUES)},
  string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY col_bin) AS n FROM grid LEFT JOIN h USING ({keys}, row_bin, col_bin) GROUP BY {keys}, row_bin"""


def _matrix(heatmap, keys=KEYS):
    return A.heatmap_matrix(heatmap, keys, VALUES).select(*keys, "row_bin", F.array_join("col_bins", ",").alias("col_bins"), *[_joined(v) for v in VALUES],
                                                          F.array_join("n", ",").alias("n"))


@register("needle_heatmap", "WITH " + NEEDLE_SQL + ", " + _matrix_sql("row_bin", "col_bin"))
def q_needle_heatmap(spark, sf_dir):
    """Matrices of five by five cells per data set."""
    return _matrix(A.needle_heatmap(scored_needles(spark, sf_dir), keys=KEYS, values=VALUES))


@register("needle_grid", "WITH " + NEEDLE_SQL + ", " + _matrix_sql("r", "c"))
def q_needle_grid(spark, sf_dir):
    """The same, unbinned."""
    return _matrix(A.needle_heatmap(scored_needles(spark, sf_dir), step=1, keys=KEYS, values=VALUES))


BINNED_SQL = NEEDLE_SQL + """, ends AS (SELECT dataset, min(len) AS lo, max(len) AS hi FROM e WHERE dataset IS NOT NULL GROUP BY dataset),
l AS (SELECT e.*, (""" + " + ".join([f"CAST(lo + {i} * ((hi - lo) / 10) < len AS INTEGER)" for i in range(10)] + ["CAST(hi < len AS INTEGER)"]) + """) AS len_bin FROM e JOIN ends USING (dataset))"""


@register("context_lengths", "WITH " + BINNED_SQL + f"""
SELECT dataset, len_bin, round(avg(len), {R}) AS mean_length, round(avg(correct), {R}) AS correct, count(*) AS n FROM l GROUP BY ALL""")
def q_context_lengths(spark, sf_dir):
    """Ten parts of each data set's context lengths."""
    g = A.context_lengths(A.context_bins(scored_needles(spark, sf_dir), keys=KEYS), keys=KEYS)
    return g.select("dataset", "len_bin", F.round("mean_length", R).alias("mean_length"), F.round("correct", R).alias("correct"), "n")


@register("context_heatmaps", "WITH " + BINNED_SQL + ", " + _matrix_sql("row_bin", "col_bin", "dataset, len_bin", "l"))
def q_context_heatmaps(spark, sf_dir):
    """A matrix per data set and part."""
    keys = ["dataset", "len_bin"]
    return _matrix(A.needle_heatmap(A.context_bins(scored_needles(spark, sf_dir), keys=KEYS), keys=keys, values=VALUES), keys)


@register("extra_rates", "WITH " + NEEDLE_SQL + f"""
SELECT dataset, round(avg(correct), {R}) AS acc, round(avg(row_correct), {R}) AS row_acc, round(avg(col_correct), {R}) AS col_acc FROM e
WHERE dataset IS NOT NULL GROUP BY dataset""")
def q_extra_rates(spark, sf_dir):
    """A2: row and column rates beside the rate of right answers."""
    g = A.group_accuracy(scored_needles(spark, sf_dir), KEYS, extra=True)
    return g.select("dataset", *[F.round(c, R).alias(c) for c in ("acc", "row_acc", "col_acc")])


@register("error_counts_long", "WITH " + NEEDLE_SQL + " SELECT dataset, error, count(*) AS count FROM e WHERE dataset IS NOT NULL GROUP BY ALL")
def q_error_counts_long(spark, sf_dir):
    """A19."""
    return A.error_count_long(scored_needles(spark, sf_dir), KEYS)


@register("severe_needles", "WITH " + NEEDLE_SQL + f"""
SELECT '{NEEDLE}' AS task, round(s, {R}) AS small_accuracy, round(l, {R}) AS large_accuracy
FROM (SELECT avg(correct) FILTER (WHERE size = 'small') AS s, avg(correct) FILTER (WHERE size = 'large') AS l FROM e) WHERE l < 0.5 * s""")
def q_severe_needles(spark, sf_dir):
    """N6 where it fires: right on large tables for a quarter of the rows only."""
    s = N.severe_tasks(scored_needles(spark, sf_dir), "correct")
    return s.select("task", F.round("small_accuracy", R).alias("small_accuracy"), F.round("large_accuracy", R).alias("large_accuracy"))


@register("model_usage", "WITH " + NEEDLE_SQL + f"""
SELECT model_name, '{NEEDLE}' AS task, count(*) AS n, CAST(sum(100 + p % 50) AS BIGINT) AS prompt_tokens, round(avg(100 + p % 50), {R}) AS prompt_mean,
  round(quantile_cont(100 + p % 50, 0.5), {R}) AS prompt_p50, round(quantile_cont(100 + p % 50, 0.95), {R}) AS prompt_p95,
  CAST(sum(1 + p % 97) AS BIGINT) AS completion_tokens, round(avg(1 + p % 97), {R}) AS completion_mean,
  round(quantile_cont(1 + p % 97, 0.5), {R}) AS completion_p50, round(quantile_cont(1 + p % 97, 0.95), {R}) AS completion_p95,
  round(avg(q / 10.0), {R}) AS avg_time, max(q / 10.0) AS max_time FROM e GROUP BY model_name""")
def q_model_usage(spark, sf_dir):
    """K7: tokens, percentiles and times per model."""
    g = K.model_usage(scored_needles(spark, sf_dir))
    return g.select(*[c if c in ("model_name", "task", "n", "prompt_tokens", "completion_tokens") else F.round(c, R).alias(c) for c in g.columns])


@register("place_needle", f4("""x AS (SELECT *, max(row_idx) OVER (PARTITION BY case_id) + 1 AS nr, case_id % 4 = 0 AS stays FROM cells)
SELECT case_id, table_name, CAST(CASE WHEN stays THEN row_idx ELSE ((row_idx + case_id % 7) % nr + nr) % nr END AS INTEGER) AS row_idx,
  CAST(CASE WHEN stays THEN col_idx ELSE ((col_idx - 1 + case_id % 3) % 5 + 5) % 5 END AS INTEGER) AS col_idx, col_name, value FROM x"""))
def q_place_needle(spark, sf_dir):
    """The needle at row 0, column 1 of three of four orders' tables goes to row key % 7 and column key % 3."""
    cells = C.lineitem_cells(spark, sf_dir)
    k = F.col("o_orderkey")
    needles = table(spark, sf_dir, "orders").where(k % 4 != 0).select(k.alias("case_id"), F.lit("lineitem").alias("table_name"), F.lit(0).alias("from_row"),
                                                                      F.lit(1).alias("from_col"), (k % 7).alias("to_row"), (k % 3).alias("to_col"))
    return MT.place_needle(cells, needles)


@register("serialize_jsonl_typed", f4("""j AS (SELECT case_id, table_name, row_idx, '{' || string_agg(to_json(CASE col_idx WHEN 2 THEN 'l_partkey_2' WHEN 4 THEN 'l_partkey_3' ELSE col_name END) || ':' ||
    CASE WHEN col_idx < 3 THEN value ELSE to_json(value) END, ',' ORDER BY col_idx) || '}' AS line FROM cells GROUP BY ALL)
SELECT case_id, table_name, string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS text FROM j GROUP BY ALL"""))
def q_jsonl_typed(spark, sf_dir):
    """Z13 with typed values and P6: three columns share the name of the second."""
    rows = C.lineitem_rows(spark, sf_dir)
    return Z.json_lines(rows.withColumn("names", F.array(*[F.lit("l_partkey" if i in (2, 4) else c) for i, c in enumerate(C.F4_COLUMNS)])), typed=True)


@register("tool_call_arguments", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"table_name":' || to_json(o_orderpriority) || '}'
  WHEN 1 THEN '{"table_name":' || to_json(o_orderpriority) || ',"n":10}' ELSE '{"table_name":"x"}' END AS arguments FROM orders""")
def q_tool_call_arguments(spark, sf_dir):
    """JSON arguments, and k=v pairs with integers."""
    return tool_call_texts(spark, sf_dir).select("o_orderkey", X.tool_arguments(F.col("text")).alias("arguments"))


SWEEP_SAMPLES, SWEEP_SHOTS = (20, 100), (0, 3)
_MD5 = "CAST('0x' || substr(md5(o_orderkey || ':7'), 1, 15) AS BIGINT)"


def _sweep_sql() -> str:
    most, extra = max(SWEEP_SAMPLES), max(SWEEP_SHOTS)
    fill = "tbl || chr(10) || 'Q: How many lines has order ' || case_id || '?'"
    texts = {
        "csv": ("string_agg(value, ',' ORDER BY col_idx)", "string_agg(col_name, ',' ORDER BY col_idx)", "hdr || chr(10) || body || chr(10)"),
        "html": ("'<tr>' || string_agg('<td>' || value || '</td>', '' ORDER BY col_idx) || '</tr>'", "string_agg('<th>' || col_name || '</th>', '' ORDER BY col_idx)",
                 "'<table>' || chr(10) || '<thead><tr>' || hdr || '</tr></thead>' || chr(10) || '<tbody>' || chr(10) || body || chr(10) || '</tbody>' || chr(10) || '</table>'"),
        "json": ("'{' || string_agg(to_json(col_name) || ':' || to_json(value), ',' ORDER BY col_idx) || '}'", "''", "body || chr(10)"),
        "markdown_short": ("'|' || string_agg(value, '|' ORDER BY col_idx) || '|'", "'|' || string_agg(col_name, '|' ORDER BY col_idx) || '|'", "hdr || chr(10) || body || chr(10)")}
    union = " UNION ALL ".join(
        f"""SELECT case_id, '{f}' AS format, {whole} AS tbl FROM (SELECT case_id, any_value(hdr) AS hdr, string_agg(line, chr(10) ORDER BY row_idx) AS body
  FROM (SELECT case_id, row_idx, {line} AS line, {hdr} AS hdr FROM cells GROUP BY case_id, row_idx) GROUP BY case_id)""" for f, (line, hdr, whole) in texts.items())
    return f4(f"""o AS (SELECT o_orderkey AS case_id, 'd' || (o_orderkey % 3) AS dataset, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY {_MD5}, o_orderkey) AS place,
    (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS answer FROM orders),
t AS ({union}),
x AS (SELECT o.*, format, tbl FROM (SELECT * FROM o, (SELECT unnest({list(texts)!r}) AS format) WHERE place <= {most + extra}) o LEFT JOIN t USING (case_id, format)),
s AS (SELECT dataset, format, shots, coalesce(string_agg({fill} || ' A: ' || answer, chr(10) ORDER BY place) FILTER (WHERE place > {most} AND r <= shots AND tbl IS NOT NULL), '') AS ex
  FROM (SELECT *, sum(CASE WHEN place > {most} AND tbl IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, format ORDER BY place) AS r FROM x), (SELECT unnest({list(SWEEP_SHOTS)}) AS shots) GROUP BY ALL)
SELECT dataset, case_id, format, CAST(shots AS INTEGER) AS shots, CASE WHEN place <= {SWEEP_SAMPLES[0]} THEN '{SWEEP_SAMPLES[0]},{most}' ELSE '{most}' END AS samples,
  CASE WHEN tbl IS NOT NULL THEN 'Examples:' || chr(10) || ex || chr(10) || {fill} END AS prompt FROM x JOIN s USING (dataset, format) WHERE place <= {most}""")


@register("format_sweep", _sweep_sql())
def q_format_sweep(spark, sf_dir):
    """Four formats, none or three shots, 20 or 100 cases of each of three data sets; the sample is the feature."""
    k = F.col("o_orderkey")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    cases = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select(
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"), k.alias("case_id"), F.concat(F.lit("How many lines has order "), k.cast("string"), F.lit("?")).alias("question"),
        F.coalesce("n", F.lit(0)).cast("string").alias("answer"))
    number = F.conv(F.substring(F.md5(F.concat(F.col("case_id").cast("string"), F.lit(":7")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    out = format_sweep(C.lineitem_cells(spark, sf_dir), cases, "Examples:\n{{{shots}}}\n{{{table}}}\nQ: {{{question}}}", "{{{table}}}\nQ: {{{question}}} A: {{{answer}}}",
                       ("csv", "html", "json", "markdown_short"), SWEEP_SHOTS, SWEEP_SAMPLES, hashed=number)
    return out.withColumn("samples", F.array_join("samples", ","))
