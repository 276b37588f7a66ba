"""Balancing, encodings, prompt building, reports and details on small tables."""

import pytest
from pyspark.sql import functions as F

from tablefold.operators import joins as J
from tablefold.operators import metrics as A
from tablefold.operators import sampling as M
from tablefold.operators import serialize as Z
from tablefold.operators.build import build_prompts
from tablefold.operators.reports import report_set, write_report_set
from tablefold.sources import tables as T


def test_balance_takes_the_smallest_hashes(spark):
    rows = [(i, "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = M.balance(df, "label", ["id"], seed=5)
    h = {r.id: r.h for r in df.select("id", F.xxhash64("id", F.lit(5)).alias("h")).collect()}
    want = {k: {i for _, i in sorted((h[i], i) for i, x in rows if x == k)[:1000]} for k in ("hot", "a", None)}
    for k, ids in want.items():
        assert {r.id for r in got.collect() if r.label == k} == ids
    assert M.balance(df, "label", ["id"], cap=7).count() == 21
    assert M.balance(df.where("false"), "label", ["id"]).count() == 0


def test_balance_two_needs_two_classes(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, label int")
    two = M.balance_two(df.where("label < 2"), "label", 11, ["id"]).collect()
    assert [r.label for r in two] == [0] * 5 + [1] * 5
    with pytest.raises(Exception, match="exactly 2 classes"):
        M.balance_two(df, "label", 11, ["id"]).collect()


def test_files_of_two_encodings(spark, tmp_path):
    for name, enc in (("c1", "utf-8"), ("c2", "latin-1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_bytes("é,ß\nÜ,12345678901234567890\n".encode(enc))
    got = T.read_case_tables(spark, f"{tmp_path}/*/data.csv").collect()
    assert sorted((r.case_id, r.col_name, r.value) for r in got) == [(c, n, v) for c in ("c1", "c2") for n, v in (("ß", "12345678901234567890"), ("é", "Ü"))]


def test_entity_pairs_with_info(spark, tmp_path):
    for name in ("tableA", "tableB", "train", "valid", "test"):
        (tmp_path / f"{name}.csv").write_bytes("id,name,x\n1,é,2\n".encode("latin-1" if name == "tableB" else "utf-8"))
    (tmp_path / "info.json").write_text('{"rename_columns": {"name": "title"}, "drop_columns": ["x", "absent"]}')
    d = T.load_entity_pairs(spark, str(tmp_path))
    assert d["tableA"].columns == d["tableB"].columns == ["id", "title"] and d["train"].columns == ["id", "name", "x"]
    assert [d[n].first()[1] for n in ("tableA", "tableB", "test")] == ["é"] * 3 and "rename_columns" in d["info"].first()[0]


def test_prompts_of_case_files(spark):
    texts = spark.createDataFrame([("d/1/a.csv", "x,y\n1,2\n"), ("d/2/b.csv", "x\n007\n")], "file_path string, text string")
    cases = spark.createDataFrame([("D1", "1", "d/1", '{"file": "./a.csv", "q": 5, "tag": "info"}'), ("Other", "2", "d/2", '{"file": "b.csv", "items": [{"k": 1}, {}]}'),
                                   ("Other", "3", "d/3", '{"file": "none.csv"}'), ("Other", "4", "d/4", None), (None, "5", "d/2", '{"file": "b.csv"}')],
                                  "dataset string, case_id string, case_path string, info_json string").where("case_id <> '5'")
    config = {"task": "t", "version": "v", "tag": "c", "note": "",
              "fields": {"t": {"type": "table.csv.path", "name": "file", "reader": "pandas.str", "serializer": Z.csv},
                         "l": {"type": "list", "name": "items", "template": "<{{{k}}}>", "fields": {"k": "k"}}},
              "d1_fields": {"t": {"type": "table.csv", "path": "a.csv", "reader": "pandas", "serializer": Z.csv}, "q": {"type": "text", "name": "q"}}}
    got = {r.case_id: r for r in build_prompts(texts, cases, "{{{t}}}|{{{l}}}|{{{q}}}", config).collect()}
    assert got["1"].prompt == "x,y\n1,2\n|{{{l}}}|5" and got["2"].prompt == "x\n007\n|<1>\n<{{{k}}}>|{{{q}}}"
    assert got["3"].prompt is None and got["4"].prompt is None and len(got) == 4
    assert '"tag":"info"' in got["1"].metadata and '"test_case":"2"' in got["2"].metadata


def test_needle_names_come_from_the_header(spark):
    h = spark.createDataFrame([("1", ["a", "b"])], "case_id string, col_names array<string>")
    r = spark.createDataFrame([("1", '{"needle_col_idx": 1}'), ("1", '{"needle_col_idx": 2}'), ("2", '{"needle_col_idx": 0}'), (None, "no json")], "case_id string, metadata string")
    assert [x.needle_col_name for x in J.needle_truth(r, h).collect()] == ["b", None, None, None]


def scored(spark):
    rows = [(f"t{i % 2}", ["small", "large", None, "huge"][i % 4], "d" if i % 5 else None, "", "", float(i % 2), i, str(i)) for i in range(40)]
    return spark.createDataFrame(rows, "task string, _size_category string, dataset string, tag string, note string, effective_correct double, _table_cells long, test_case string")


def test_reports_are_ordered(spark, tmp_path):
    rows = report_set(scored(spark)).collect()
    assert [(r.report, r.position) for r in rows] == [("summary", 1), ("by_task", 1), ("by_task", 2), ("by_size", 1), ("by_size", 2), ("task_by_size", 1), ("task_by_size", 2),
                                                      ("by_group", 1), ("by_group", 2)]
    assert [r.size_category for r in rows if r.report == "by_size"] == ["small", "large"] and rows[0]["count"] == 40
    assert sum(r["count"] for r in rows if r.report == "by_group") == 32
    write_report_set(report_set(scored(spark)), f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == 9 and {r.report for r in back.select("report").distinct().collect()} == {r.report for r in rows}


def test_group_details_are_bounded(spark):
    d = A.group_details(scored(spark), ["task"], ["test_case", "effective_correct"], most=3).collect()
    assert [(r.task, r.n_rows, [x.test_case for x in r.rows]) for r in sorted(d)] == [("t0", 20, ["0", "10", "12"]), ("t1", 20, ["1", "11", "13"])]


def test_union_of_differing_columns(spark):
    a = spark.createDataFrame([("x", 1, 0.5)], "task string, n int, correct double")
    groups = spark.createDataFrame([(1, "d"), (2, "d")], "case_id long, dataset string")
    v = A.table_scored(spark.createDataFrame([(1, 1.0, "superset")], "case_id long, correct double, sql_diff string"), "NL2SQL", groups)
    u = A.union_scored(a, v.withColumn("n", F.lit(2.5))).collect()
    assert {(r.task, r.n, r.correct, r.error, r.sql_diff) for r in u} == {("x", 1.0, 0.5, None, None), ("NL2SQL", 2.5, 1.0, None, "superset"), ("NL2SQL", 2.5, 0.0, "execution error", None)}
