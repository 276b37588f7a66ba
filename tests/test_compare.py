"""Table comparison on cases that the given tables don't hold."""

from pyspark.sql import functions as F

from tablefold.operators import cells as C
from tablefold.operators import compare as CMP
from tablefold.operators import match as MT
from tablefold.operators import profile as Q
from tablefold.operators import reshape as RS
from tablefold.plans.compare import produced_rows, with_produced_rows
from tablefold.sources.text_tables import extract_tables

SCHEMA = "case_id long, table_name string, row_idx int, col_idx int, col_name string, value string"


def cells(spark, tables):
    rows = [(case, name, r, c, col, row[c]) for (case, name), (cols, body) in tables.items() for r, row in enumerate(body) for c, col in enumerate(cols)]
    return spark.createDataFrame(rows, SCHEMA)


def test_result_lists(spark):
    ab = ["a", "b"]
    truth = {(1, "t"): (ab, [["1", "x"], ["2", None]]), (2, "t"): (ab, [["1", "x"]]), (3, "t"): (ab, [["100", "x"]]), (4, "t"): (["a"], [["None"]]),
             (5, "t"): (ab, [["1", "x"], ["2", "y"]]), (6, "t"): (["a"], [["1"]])}
    made = {(1, "t"): (ab, [["1.0", "x"], ["2", "None"]]), (2, "t"): (ab, [["x", "1.00"]]), (3, "t"): (ab, [["100.5", "x"]]),
            (5, "t"): (ab, [["1", "x"], ["1.0", "x"]]), (6, "t"): (["a"], [["1"]])}
    got = {r.case_id: (r.correct, r.sql_diff) for r in CMP.result_list_equal(
        cells(spark, truth), cells(spark, made), spark.createDataFrame([(6,), (7,)], "case_id long")).collect()}
    assert got == {1: (1.0, ""), 2: (0.0, "superset"), 3: (0.0, "others"), 4: (1.0, ""), 5: (0.0, "subset"),
                   6: (0.0, CMP.FAILED), 7: (0.0, CMP.FAILED)}


def test_tables_of_one_case(spark):
    ab, keys = ["a", "b"], ["case_id", "table_name"]
    truth = cells(spark, {(1, "s"): (ab, [["1", "x"], ["2", "y"]]), (1, "t"): (ab, [["1", "x"]])})
    made = cells(spark, {(1, "s"): (ab, [["2.0", "y"], ["1", "x"]]), (1, "t"): (["a", "c"], [["1", "x"]])})
    as_dict = lambda d: {r.table_name: tuple(r)[2:] for r in d.orderBy("table_name").collect()}
    assert as_dict(CMP.ordered_equal(truth, made, keys)) == {"s": (0.0, True, True), "t": (0.0, False, True)}
    assert as_dict(CMP.unordered_rows_equal(truth, made, keys)) == {"s": (1.0, 0.0, True), "t": (0.0, 0.0, False)}
    assert as_dict(CMP.cell_multiset_equal(truth, made, keys)) == {"s": (1.0, 0.0), "t": (1.0, 1.0)}
    assert as_dict(CMP.columns_match(truth, made, keys)) == {"s": (True,), "t": (False,)}


def test_wide_to_long_per_table(spark):
    c = cells(spark, {(1, "t"): (["id", "a_1", "a_2"], [["k", "p", "q"]]), (2, "t"): (["id", "a_1", "b_1"], [["m", "r", "s"]])})
    got = sorted((r.case_id, r.row_idx, r.col_idx, r.col_name, r.value) for r in RS.wide_to_long(c, 1, 2).collect())
    assert got == [(1, 0, 0, "id", "k"), (1, 0, 1, "suffix", "1"), (1, 0, 2, "a", "p"), (1, 1, 0, "id", "k"), (1, 1, 1, "suffix", "2"), (1, 1, 2, "a", "q"),
                   (2, 0, 0, "id", "m"), (2, 0, 1, "suffix", "1"), (2, 0, 2, "a", "r"), (2, 0, 3, "b", "s")]


def test_cell_multisets_of_table_rows(spark):
    """Table rows and cells give the same; rows that are even in both tables are not taken apart, cells travel once."""
    schema = "case_id long, table_name string, row_idx int, idx array<int>, names array<string>, vals array<string>"
    rows = lambda *t: spark.createDataFrame([(c, "t", i, list(range(len(v))), ["n"] * len(v), v) for c, vs in t for i, v in enumerate(vs)], schema)
    truth = rows((1, [["1", None], ["2", "x"]]), (2, [["1", "2"]]), (3, [["5", "5"]]), (4, [[None, "1"]]), (None, [["7"]]), (6, []), (7, [["a"]]))
    made = rows((1, [["2", "x"], ["1", None]]), (2, [["2.0", "1"]]), (3, [["5"]]), (4, [["1"]]), (None, [["7"]]), (6, [["b"]]))
    want = {1: (1.0, 1.0), 2: (1.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), None: (1.0, 1.0), 6: (0.0, 0.0), 7: (0.0, 0.0)}
    for t, m in ((truth, made), (C.as_cells(truth), C.as_cells(made))):
        assert {r.case_id: tuple(r)[1:] for r in CMP.cell_multiset_equal(t, m).collect()} == want
    big = rows(*[(c, [[str(c), str(r), "x"] for r in range(20)]) for c in range(40)])
    plan = CMP.cell_multiset_equal(big, big)._jdf.queryExecution().toString()
    assert "more" in plan and "kind" not in plan


def test_unique_cells_in_one_aggregate(spark):
    c = cells(spark, {(1, "t"): (["a", "b"], [["1", "x"], ["1", None], ["2", "y"]]), (2, "t"): (["a"], [["1"], [None]]), (None, "t"): (["a"], [["3"]])})
    got = MT.unique_cells(c)
    assert sorted(map(tuple, got.collect())) == [(1, "t", 0, 1, "b", "x"), (1, "t", 2, 0, "a", "2"), (1, "t", 2, 1, "b", "y"), (2, "t", 0, 0, "a", "1")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_text_tables_without_shuffle(spark):
    text = "in\n|a|a||\n|-|:-|-|\n| 1 |2|\n\n|h|\n|--|\nmid\n |x|y| \n|p|q|r|\n|s|\nout"
    got = extract_tables(spark.createDataFrame([(1, text), (2, None), (None, text), (3, "no table")], "id long, t string"), "id", "t")
    assert sorted(map(tuple, got.collect())) == [
        (1, "table_0", 0, 0, "a", "1"), (1, "table_0", 0, 1, "a_1", "2"), (1, "table_1", 0, 0, "x", "p"), (1, "table_1", 0, 1, "y", "q"),
        (1, "table_1", 1, 0, "x", "s"), (1, "table_1", 1, 1, "y", "")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_context_of_table_rows(spark):
    """Table rows give what their cells give, without being taken apart."""
    schema = "case_id string, table_name string, row_idx int, idx array<int>, names array<string>, vals array<string>"
    rows = spark.createDataFrame([(f"c{n}", "t", i, [0, 1], ["a", "b"], [str(i), "x"]) for n in (1, 300, 1000) for i in range(n)], schema)
    got = [{r.case_id: tuple(r) for r in Q.context_text(t, C.table_shape(t), 2).collect()} for t in (rows, C.as_cells(rows))]
    assert got[0] == got[1] and got[0]["c300"][2:] == ("hybrid", "Columns: a, b\n|a|b|\n|---|---|\n|0|x|\n|1|x|\n") and got[0]["c1000"][2:] == ("sql_only", "Columns: a, b")
    plan = Q.context_text(rows, C.table_shape(rows), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "explode" not in plan


def test_produced_rows_change_the_first_row(spark):
    """The first row of the truth is changed, wherever it stands after the rows are reversed."""
    schema = "case_id long, table_name string, row_idx int, idx array<int>, names array<string>, vals array<string>"
    rows = spark.createDataFrame([(k, "t", i, [0, 1, 2], ["a", "b", "c"], ["x", str(i), "9"]) for k in (5, 3) for i in range(3)], schema)
    got = {(r.case_id, r.row_idx): (r.names[0], r.vals) for r in produced_rows(rows).collect()}
    assert got == {(5, 2): ("a", ["x", "1", "9"]), (5, 1): ("a", ["x", "1", "9"]), (5, 0): ("a", ["x", "2", "9"]),
                   (3, 0): ("a_r", ["x", "0", "9.0"]), (3, 1): ("a_r", ["x", "1", "9"]), (3, 2): ("a_r", ["x", "2", "9"])}


ROWS = "case_id long, table_name string, row_idx int, idx array<int>, names array<string>, vals array<string>"


def table_rows(spark, *tables):
    return spark.createDataFrame([(c, "t", i, list(range(len(v))), names, v) for c, names, body in tables for i, v in enumerate(body)], ROWS)


def both_ways(fn, truth, made, *more):
    """The verdicts on table rows and on their cells, which must be equal."""
    got = [{r.case_id: tuple(r)[1:] for r in fn(t, m, *more).collect()} for t, m in ((truth, made), (C.as_cells(truth), C.as_cells(made)))]
    assert got[0] == got[1]
    return got[0]


def test_unordered_rows_of_table_rows(spark):
    """Table rows give what their cells give; rows are counted as they are and no cell is sorted."""
    ab = ["a", "b"]
    truth = table_rows(spark, (1, ab, [["1", None], ["2", "x"]]), (2, ab, [["1", "x"], ["1", "x"]]), (3, ab, [["1", "x"]]), (4, ab, [["1.0", "x"]]),
                       (None, ab, [["1", "x"]]), (6, ab, [["N", "1995-01-02"]]))
    made = table_rows(spark, (1, ab, [["2", "x"], ["1", ""]]), (2, ab, [["1", "x"]]), (3, ["a", "c"], [["1", "x"]]), (4, ab, [["1", "x"]]),
                      (None, ab, [["1", "x"]]), (7, ab, [["1", "x"]]))
    assert both_ways(CMP.unordered_rows_equal, truth, made) == {
        1: (1.0, 1.0, True), 2: (0.0, 0.0, True), 3: (0.0, 0.0, False), 4: (1.0, 0.0, True), None: (1.0, 1.0, True), 6: (0.0, 0.0, False), 7: (0.0, 0.0, False)}
    assert "SortAggregate" not in CMP.unordered_rows_equal(truth, made)._jdf.queryExecution().executedPlan().toString()


def test_result_lists_of_table_rows(spark):
    """Table rows give what their cells give; a cell's place and value are no facts of their own."""
    ab = ["a", "b"]
    truth = table_rows(spark, (1, ab, [["1", "x"], ["2", None]]), (2, ab, [["1", "x"]]), (3, ["a"], [[""]]), (4, ab, [["5", "x"], ["7", "y"]]),
                       (None, ab, [["1", "x"]]), (6, ["a"], [["1"]]), (8, ["a"], [["N"], ["-1.5e3"]]), (9, ["a"], [["1"], ["2"]]))
    made = table_rows(spark, (1, ab, [["1.0", "x"], ["2", "None"]]), (2, ab, [["x", "1.00"]]), (4, ab, [["5", "x"], ["x", "5.0"]]),
                      (None, ab, [["1", "x"]]), (6, ["a"], [["1"]]), (8, ["a"], [["N"], [" -1500"]]), (9, ["a"], [["1"]]))
    failed = spark.createDataFrame([(6,), (7,)], "case_id long")
    assert both_ways(CMP.result_list_equal, truth, made, failed) == {
        1: (1.0, ""), 2: (0.0, "superset"), 3: (1.0, ""), 4: (0.0, "subset"), None: (1.0, ""), 6: (0.0, CMP.FAILED), 7: (0.0, CMP.FAILED), 8: (1.0, ""), 9: (0.0, "others")}


def test_ordered_rows_of_table_rows(spark):
    """Table rows give what their cells give; whole rows are compared, no cell is made."""
    ab = ["a", "b"]
    truth = table_rows(spark, (1, ab, [["1", None], ["2", "x"]]), (2, ab, [["1", "x"], ["2", "x"]]), (3, ab, [["1", "x"]]), (4, ab, [["1", "x"]]), (None, ab, [["1", "x"]]), (6, ab, [["1", "x"]]))
    made = table_rows(spark, (1, ab, [["1", "nan"], ["2", "x"]]), (2, ab, [["2", "x"], ["1", "x"]]), (3, ["a", "c"], [["1", "x"]]), (4, ab, [["1", "x"], ["1", "x"]]), (None, ab, [["1", "x"]]))
    assert both_ways(CMP.ordered_equal, truth, made) == {
        1: (1.0, True, True), 2: (0.0, True, True), 3: (0.0, False, True), 4: (0.0, True, False), None: (1.0, True, True), 6: (0.0, False, False)}
    assert "SortAggregate" not in CMP.ordered_equal(truth, made)._jdf.queryExecution().executedPlan().toString()


def test_both_tables_as_one_frame(spark):
    """Truth and variants made in one pass equal the two made apart, by each comparison; no table is numbered twice or moved again."""
    lines = [(k, i, f"{(k or 0) * 10 + i}", str(i)) for k in (None, 1, 2, 4, 5, 7, 8, 10, 12, 15, 20) for i in range(1 + (k or 3) % 4)]
    rows = C.frame_to_rows(spark.createDataFrame(lines, "k long, line int, part string, n string"), "k", "t", ["line", "part", "n"], ["line"])
    both, apart = with_produced_rows(rows), rows.withColumn("_t", F.lit(True)).unionByName(produced_rows(rows).withColumn("_t", F.lit(False)))
    key = lambda d: sorted(map(str, d.select("_t", "case_id", "table_name", "row_idx", "idx", "names", "vals").collect()))
    assert key(both) == key(apart) and len(key(both)) > len(lines)
    for compare in (CMP.result_list_equal, CMP.ordered_equal, CMP.unordered_rows_equal, CMP.cell_multiset_equal):
        one = compare(both)
        assert sorted(map(str, one.collect())) == sorted(map(str, compare(rows, produced_rows(rows)).collect()))
        assert compare(both)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        cells = both.select("case_id", "table_name", "_t", "row_idx", F.inline(C.row_cells()))
        assert sorted(map(str, compare(cells).collect())) == sorted(map(str, one.collect()))
