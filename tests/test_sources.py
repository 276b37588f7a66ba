"""Readers and writers: CSV case tables, case infos, prompt files, responses of both shapes."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tablefold.operators.prompts import build_metadata, fill, lint_configs, list_field
from tablefold.sources import io as IO
from tablefold.sources.tables import case_cells, case_headers, parse_case_texts, read_case_infos, read_case_tables

SMOKE = "/root/testdata/sf0.001"


def _case_folder():
    root = tempfile.mkdtemp(prefix="tablefold-test-")
    for case, t in [("c1", "region"), ("c2", "nation")]:
        d = os.path.join(root, "ds", case)
        os.makedirs(d)
        pd.read_parquet(f"{SMOKE}/{t}.parquet").to_csv(os.path.join(d, "data.csv"), index=False)
        with open(os.path.join(d, "info.json"), "w") as f:
            json.dump({"question": f"rows of {t}?", "label": 5}, f)
    return root


def test_read_case_tables_and_infos(spark):
    root = _case_folder()
    cells = read_case_tables(spark, os.path.join(root, "*", "*", "*.csv"), reader="pandas.str")
    got = {(r.case_id, r.row_idx, r.col_idx): (r.col_name, r.value) for r in cells.collect()}
    nation = pd.read_parquet(f"{SMOKE}/nation.parquet")
    assert got[("c2", 3, 1)] == ("n_name", str(nation.iloc[3]["n_name"]))
    assert len([k for k in got if k[0] == "c1"]) == 5 * 2
    infos = read_case_infos(spark, root).collect()
    assert sorted((r.dataset, r.case_id) for r in infos) == [("ds", "c1"), ("ds", "c2")]


def test_parse_case_texts_edges(spark):
    texts = spark.createDataFrame([
        ("d/null/t.csv", None), ("d/empty/t.csv", ""), ("d/head/t.csv", "a,b\n"),
        ("d/open/t.csv", 'a,b\n"x,1\n'), ("d/long/t.csv", "a\n" + "1\n" * 5000), ("d/wide/t.csv", "t\n\"" + "y" * 100000 + "\n\"\n"),
        ("d/names/t.csv", "a,,a\n1,2,3"), ("d/float/t.csv", "a,b\n1e20,0.00012\n12345678.5,-.5"), ("d/mixed/t.csv", "a\n007\nx"),
    ], "file_path string, text string")
    parsed = parse_case_texts(texts)
    got = {r.file_path.split("/")[1]: r for r in parsed.collect()}
    assert got["null"].header == got["empty"].header == [] and got["null"].rows == []
    assert got["head"].header == ["a", "b"] and got["head"].rows == []
    assert got["open"].rows == [['"x', "1"]]
    assert len(got["long"].rows) == 5000 and len(got["wide"].rows[0][0]) == 100001
    assert got["names"].header == ["a", "Unnamed: 1", "a.1"]
    assert got["float"].rows == [["1e+20", "0.00012"], ["12345678.5", "-0.5"]]
    assert got["mixed"].rows == [["007"], ["x"]]
    assert case_cells(parsed).where("case_id IN ('null', 'empty', 'head')").count() == 0
    assert case_headers(parsed).count() == 9


def test_prompt_io_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="tablefold-test-")
    p = spark.createDataFrame([(1, "p1", True), (2, "p2", False)], "case_id long, prompt string, valid boolean")
    IO.write_prompts(p, out + "/prompts")
    assert sorted(os.listdir(out + "/prompts"))[-2:] == ["valid=false", "valid=true"]
    IO.write_batch(p, out + "/batch", "some-model")
    b = spark.read.json(out + "/batch").orderBy("custom_id").first()
    assert b.body.messages[0].content == "p1" and b.method == "POST"


def test_read_responses_two_shapes(spark):
    out = tempfile.mkdtemp(prefix="tablefold-test-")
    with open(os.path.join(out, "tableqa.model-x.jsonl"), "w") as f:
        f.write(json.dumps({"prompt": "p", "metadata": json.dumps({"task": "Table-QA"}), "response": "r1"}) + "\n")
        f.write(json.dumps({"prompt": "p", "metadata": json.dumps({"task": "Table-QA"}),
                            "choices": [{"text": "r2"}]}) + "\n")
    df = IO.read_responses(spark, out)
    rows = sorted((r.file_dataset, r.file_model, r.task_resolved) for r in df.collect())
    assert rows == [("tableqa", "model-x", "Table-QA")] * 2
    assert IO.result_name("org/model_v1", "hybrid") == "org-model-v1-hybrid"


def test_fill_lint_and_metadata(spark):
    df = spark.createDataFrame([("A", "x")], "a string, b string")
    r = df.select(fill("{{{a}}}-{{{b}}}-{{{c}}}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first()
    assert r.t == "A-x-{{{c}}}"
    cfg = spark.createDataFrame([("ok", "{{{x}}}", ["prompt_template", "dataset_config"]),
                                 ("bad", "{{{x y}}}", ["prompt_template"])],
                                "name string, prompt_template string, keys array<string>")
    res = {r.name: r.ok for r in lint_configs(cfg).collect()}
    assert res == {"ok": True, "bad": False}
    m = df.select(build_metadata({"task": F.lit("T"), "case_path": F.lit("/home/u/x")},
                                 F.lit('{"task": "override", "k": 1}'), home="/home/u").alias("m")).first().m
    assert json.loads(m) == {"case_path": "$HOME/x", "task": "override", "k": 1}
    m = df.select(build_metadata({"task": F.lit("T")}, F.lit("not json")).alias("m")).first().m
    assert json.loads(m) == {"task": "T"}
    items = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "case_id long, pos int, v string")
    assert list_field(items, ["case_id"], "- {{{v}}}", {"v": "v"}).first().text == "- a\n- b"
