"""Needle matrices, context lengths, usage, placement, typed JSON lines, call arguments and the bounded intake on small tables."""

import json

import numpy as np
from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.operators import budget as K
from tablefold.operators import discover as DV
from tablefold.operators import match as MT
from tablefold.operators import metrics as A
from tablefold.operators import serialize as Z
from tablefold.operators.sweep import format_sweep
from tablefold.streaming import intake as S

CELL = "case_id string, table_name string, row_idx int, col_idx int, col_name string, value string"


def test_matrix_rows_line_up(spark):
    rows = [("a", 0, 1, 1.0), ("a", 1, 1, 0.0), ("a", 6, 11, 1.0), ("b", 6, 3, 0.5), (None, 1, 1, 1.0), ("b", None, 3, 1.0)]
    df = spark.createDataFrame(rows, "dataset string, needle_row_idx long, needle_col_idx long, correct double")
    m = A.heatmap_matrix(A.needle_heatmap(df, keys=["dataset"]), ["dataset"])
    got = {(r.dataset, r.row_bin): (r.col_bins, r.correct, r.n) for r in m.collect()}
    assert got == {("a", 5): ([5, 15], [0.5, None], [2, 0]), ("a", 10): ([5, 15], [None, 1.0], [0, 1]), ("b", 10): ([5], [0.5], [1])}
    assert {(r.row_bin, r.col_bin) for r in A.needle_heatmap(df, step=1, keys=["dataset"]).collect()} == {(0, 1), (1, 1), (6, 11), (6, 3)}
    assert A.heatmap_matrix(A.needle_heatmap(df.where("false"), keys=["dataset"]), ["dataset"]).count() == 0


def test_context_bins_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    lengths = {"a": rng.integers(0, 1000, 300).astype(float), "b": rng.random(300) * 0.7 + 0.1, "c": np.full(4, 7.0)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in lengths.items() for x in xs] + [(None, 1.0), ("a", None)], "dataset string, context_length double")
    got = A.context_bins(df, keys=["dataset"]).collect()
    for k, xs in lengths.items():
        want = np.digitize(xs, np.linspace(xs.min(), xs.max(), 11), right=True)
        assert sorted((r.context_length, r.len_bin) for r in got if r.dataset == k) == sorted(zip(xs.tolist(), want.tolist()))
    assert len(got) == 604


def test_usage_percentiles(spark):
    df = spark.createDataFrame([("m", "t", i, 2 * i if i else None, i / 10) for i in range(11)], "model_name string, task string, prompt_tokens long, completion_tokens long, time_taken double")
    r = K.model_usage(df).first()
    assert (r.n, r.prompt_tokens, r.prompt_p50, r.prompt_p95, r.completion_tokens, r.completion_p50, r.max_time) == (11, 55, 5.0, 9.5, 110, 11.0, 1.0)


def test_needle_goes_where_it_shall(spark):
    cells = spark.createDataFrame([(c, "t", r, k, "ABC"[k], f"{r}{k}") for c in "xy" for r in range(4) for k in range(3)], CELL)
    needles = spark.createDataFrame([("x", "t", 1, 2, 3, 0), ("z", "t", 0, 0, 1, 1)], "case_id string, table_name string, from_row int, from_col int, to_row int, to_col int")
    got = MT.place_needle(cells, needles).collect()
    assert {(r.row_idx, r.col_idx): (r.col_name, r.value) for r in got if r.case_id == "x"} == {((r + 2) % 4, (k + 1) % 3): ("ABC"[k], f"{r}{k}") for r in range(4) for k in range(3)}
    assert all(r.value == f"{r.row_idx}{r.col_idx}" for r in got if r.case_id == "y") and len(got) == 24


def test_typed_json_lines(spark):
    names, rows = ["a", "a", "b", "a"], [["1", "01", 'q"', "2.50"], ["-3", "2", "4", "1e5"]]
    cells = spark.createDataFrame([("x", "t", i, k, names[k], v) for i, r in enumerate(rows) for k, v in enumerate(r)], CELL)
    want = '{"a":1,"a_2":"01","b":"q\\"","a_3":2.50}\n{"a":-3,"a_2":"2","b":"4","a_3":1e5}\n'
    assert Z.json_lines(cells, typed=True).first().text == want
    assert [json.loads(x)["index"] for x in Z.json_lines(cells, index=True).first().text.splitlines()] == [0, 1]


def test_call_arguments(spark):
    texts = {'<tool_call>f(a=1, b = "x y", c=-007, d=1_000, e=1.5, a=+2)</tool_call>': {"b": "x y", "c": -7, "d": 1000, "e": "1.5", "a": 2},
             '<tool_call>f({"n": 3, "s": "3"})</tool_call>': {"n": 3, "s": "3"}, "<tool_call>f( )</tool_call>": {}, "no call": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.a and json.loads(r.a) for r in df.select("t", X.tool_arguments(F.col("t")).alias("a")).collect()} == texts


def test_bounded_intake_counts_once(spark):
    base = S.new_run_folder(spark)
    df = spark.createDataFrame([("p", f'{{"i": {i % 7}}}', "r" if i else "", 1, 1, 0.1, "m") for i in range(20)], S.RESPONSE_SCHEMA)
    S.write_batches([df, df, df.limit(3)], base + "/in")
    s = S.stream_results(spark, base + "/in", max_files_per_trigger=1, within="1 hour")
    assert S.run_available(s.groupBy().count(), "bounded_test", base + "/ckpt").first()[0] == 7


def test_dependencies_of_both_directions(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", 2), (2, "x", 3), (3, "y", 3)], "a int, b string, c int")
    got = {(r.det, r.dep): (r.n_det_values, r.n_pairs, r.error) for r in DV.functional_dependencies(df).collect()}
    assert got == {("a", "b"): (3, 3, 0.0), ("b", "a"): (2, 3, 0.25), ("a", "c"): (3, 4, 0.25), ("c", "a"): (3, 4, 0.25), ("b", "c"): (2, 4, 0.5), ("c", "b"): (3, 4, 0.25)}


def test_sweep_shots_are_no_samples(spark):
    cells = spark.createDataFrame([(c, "t", 0, 0, "n", str(c)) for c in range(30) if c != 3], CELL.replace("case_id string", "case_id int"))
    cases = spark.createDataFrame([(f"d{c % 2}" if c % 5 else None, c, f"q{c}", f"a{c}") for c in range(30)], "dataset string, case_id int, question string, answer string")
    got = format_sweep(cells, cases, "{{{shots}}}|{{{table}}}|{{{question}}}", "{{{question}}}={{{answer}}}", ("csv", "json"), (0, 2), (2, 5)).collect()
    for d in ("d0", "d1", None):
        mine = [r for r in got if r.dataset == d]
        ids = {r.case_id for r in mine}
        assert len(mine) == len(ids) * 4 and len({r.case_id for r in mine if r.samples == [2, 5]}) == 2
        shots = {x for r in mine if r.prompt and r.shots for x in r.prompt.split("|")[0].splitlines()}
        assert not {f"q{i}=a{i}" for i in ids} & shots and len(shots) <= 2
        assert all((r.prompt is None) == (r.case_id == 3) for r in mine)
        assert all(r.prompt is None or r.prompt.startswith("|") == (not r.shots or not shots) for r in mine)


def test_arithmetic_without_all_zero_columns(spark):
    df = spark.createDataFrame([(3, 1, 2, 0), (5, 2, 3, 0)], "a int, b int, c int, z int")
    got = {r.formula: r.support for r in DV.arithmetic_relations(df, ["a", "b", "c", "z"], min_support=0.0).collect()}
    assert got["a=b+c"] == 1.0 and not [f for f in got if "z" in f]
