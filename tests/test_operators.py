"""Invariants and small fixtures for the table operators."""

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import compare as CMP
from tablefold.operators import reshape as RS
from tablefold.operators import serialize as Z
from tablefold.operators.joins import completeness
from tablefold.sources.text_tables import extract_tables

SMOKE = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_transpose_twice_is_identity(spark):
    c = C.lineitem_cells(spark, SMOKE)
    back = RS.transpose(RS.transpose(c))
    assert _rows(back.select("case_id", "row_idx", "col_idx", "value")) == \
        _rows(c.select("case_id", "row_idx", "col_idx", "value"))


def test_unordered_compare_ignores_row_shuffle(spark):
    c = C.lineitem_cells(spark, SMOKE)
    s = C.shuffle_rows(c, seed=7)
    r = CMP.unordered_rows_equal(c, s)
    assert r.filter(F.col("correct") != 1.0).count() == 0


def test_shortline_roundtrip(spark):
    c = C.lineitem_cells(spark, SMOKE)
    text = Z.markdown_short_line(c)
    back = extract_tables(text, "case_id", "text")
    assert _rows(back.drop("table_name")) == _rows(c.drop("table_name"))


def test_text_table_variants(spark):
    texts = [
        (1, "x\n|a|a| |\n|---|---|---|\n|1|2|3|\n|4|5|\ntext\n|k|v|\n|-|-|\n|p|q|r|\n"),
        (2, "|only|header|\nno rows\n"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    got = _rows(extract_tables(df, "id", "text").select("case_id", "table_name", "row_idx", "col_idx", "col_name",
                                                        "value"))
    assert (1, "table_0", 0, 1, "a_1", "2") in got        # repeated header gets _1
    assert (1, "table_0", 1, 2, "unnamed", "") in got      # blank header and short row padded
    assert (1, "table_1", 0, 1, "v", "q") in got           # second table, long row truncated
    assert not any(r[0] == 2 for r in got)                 # header-only table dropped
    assert not any(r[2] == 0 and r[5] == "r" for r in got)


def test_resume_partitions_queries(spark):
    q = spark.createDataFrame([(f"m{i}",) for i in range(10)], "metadata string")
    r = spark.createDataFrame([("m1", "a"), ("m2", ""), ("m3", "b"), ("m3", "b")], "metadata string, response string")
    row = completeness(q, r).first()
    assert (row.n_all, row.n_done, row.n_todo, row.ok) == (10, 2, 8, True)


def test_stack_then_shape(spark):
    c = C.dataframe_cells(spark.read.parquet(f"{SMOKE}/region.parquet"), "region", "region", ["r_regionkey"])
    s = RS.stack(c, 0, 1)
    shape = C.table_shape(s).first()
    assert (shape.n_rows, shape.n_cols) == (10, 2)
