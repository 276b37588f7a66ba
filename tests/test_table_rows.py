"""Operators on table rows (cells.as_rows): equal to those on cells, and without a sort of cells."""

import pytest

from tablefold.operators import cells as C
from tablefold.operators import reshape as RS
from tablefold.operators import serialize as Z

ROWS = [(1, 1, "a-b", ""), (1, 2, "c", "x"), (1, 3, "d - e-", ""), (2, 1, "", "y"), (2, 2, None, ""), (None, 1, "p-q", "z")]


def _frame(spark):
    return spark.createDataFrame(ROWS, "k long, line int, s string, t string")


def _rows(spark):
    return C.frame_to_rows(_frame(spark), "k", "t", ["line", "s", "t"], ["line", "s", "t"])


def _got(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("step", [lambda d: RS.explode(d, 1, "-"), lambda d: RS.pivot(d, 2), lambda d: C.as_cells(RS.ffill(d, 2)),
                                  lambda d: RS.stack(d, 1, 2), lambda d: RS.wide_to_long(d, 1, 2, "(.)(.*)"), RS.subtitles, RS.transpose])
def test_rows_and_cells_give_the_same(spark, step):
    cells = C.frame_to_cells(_frame(spark), "k", "t", ["line", "s", "t"], ["line", "s", "t"])
    assert "vals" in _rows(spark).columns and _got(step(_rows(spark))) == _got(step(cells)) != []


def test_exploded_cells_are_returned_whole(spark, tmp_path):
    from tablefold.plans.registry import QUERIES
    spark.sql("SELECT 7L AS l_orderkey, 1 AS l_linenumber, 5L AS l_partkey, 6L AS l_suppkey, 1.5D AS l_extendedprice, 3D AS l_quantity, 0D AS l_discount, 0D AS l_tax, "
              "'A' AS l_returnflag, 'F' AS l_linestatus, DATE'1994-02-03' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["reshape_explode"](spark, str(tmp_path))
    assert got.columns == C.CELL_COLUMNS
    assert sorted((r.row_idx, r.value) for r in got.where("col_idx = 4").collect()) == [(0, "1994"), (1, "02"), (2, "03")] and got.count() == 15


def test_cells_are_not_sorted(spark):
    for out in (RS.explode(_rows(spark), 1, "-"), RS.run_steps(_rows(spark), [{"operator": "ffill", "ffill_end_idx": 2}, {"operator": "pivot", "pivot_row_frequency": 2}])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and plan.index("Generate") < plan.index("Sort")


def test_layouts_of_whole_tables(spark):
    cells = spark.createDataFrame([(1, "t", 0, 0, "a", "1"), (1, "t", 0, 1, "b", "x"), (1, "t", 1, 1, "b", "long"), (1, "t", 1, 2, "c", "2"), (1, "t", 1, 0, "a", "1.5"),
                                   (2, "t", 0, 0, "name", "7"), (2, "t", 1, 0, "name", "x")], "case_id long, table_name string, row_idx int, col_idx int, col_name string, value string")
    text = lambda df: {r.case_id: r.text for r in df.collect()}
    assert text(Z.markdown(cells)) == {1: "| a   | b    |\n|:----|:-----|\n| 1   | x    |\n| 1.5 | long | 2   |", 2: "| name |\n|:-----|\n| 7    |\n| x    |"}
    assert text(Z.json_lines(cells, typed=True)) == {1: '{"a":1,"b":"x"}\n{"a":1.5,"b":"long","c":2}\n', 2: '{"name":"7"}\n{"name":"x"}\n'}
    for layout in Z.SERIALIZERS.values():
        plan = layout(_rows(spark))._jdf.queryExecution().executedPlan().toString()
        if layout not in (Z.markdown_with_index, Z.html_with_index, Z.SERIALIZERS["csv_index"]):
            assert plan.count("Exchange") == 1 and "Generate" not in plan
        assert _got(layout(_rows(spark))) == _got(layout(C.as_cells(_rows(spark))))


def test_index_column_is_made_inside_rows(spark):
    for layout in (Z.markdown_with_index, Z.html_with_index, Z.SERIALIZERS["csv_index"]):
        plan = layout(_rows(spark))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Generate" not in plan and "Union" not in plan
        assert _got(layout(_rows(spark))) == _got(layout(C.as_cells(_rows(spark))))
    empty = _rows(spark).limit(0).unionByName(spark.sql("SELECT 3L AS case_id, 't' AS table_name, 0 AS row_idx, cast(array() AS array<int>) AS idx, "
                                                        "cast(array() AS array<string>) AS names, cast(array() AS array<string>) AS vals"))
    assert C.with_index(empty).count() == C.with_index(C.as_cells(empty)).count() == 0
