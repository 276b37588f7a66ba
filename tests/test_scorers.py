"""Hand-written (truth, completion, expected score) cases per scorer, following the reference rules."""

import json

import pytest
from pyspark.sql import functions as F

from tablefold.operators.score import score_responses


def score(spark, task, label, completion, extra=None):
    meta = {"task": task, "dataset": "d", "tag": "t", "note": "", "label": label}
    meta.update(extra or {})
    df = spark.createDataFrame([(json.dumps(meta), completion, "p")], "metadata string, response string, prompt string")
    return score_responses(df, [task]).first().asDict()


CASES = [
    # Table-QA: text equality, $ and % paths, "5" vs 5.0 is wrong (numbers only for non-strings)
    ("Table-QA", "abc", '{"answer": "ABC"}', "correct", 1.0),
    ("Table-QA", 1234.5, '{"answer": "$1,234.50"}', "correct", 1.0),
    ("Table-QA", 0.125, '{"answer": "12.5%"}', "correct", 1.0),
    ("Table-QA", 5.0, '{"answer": "5"}', "correct", 0.0),
    ("Table-QA", 5.0, '{"answer": 5}', "correct", 1.0),
    ("Table-QA", "x", "no json here", "correct", 0.0),
    # literal fallback and think stripping
    ("Table-Fact-Verification", "yes", "{'label': 'Yes'}", "correct", 1.0),
    ("Table-Fact-Verification", "yes", '<think>{"label": "no"}</think>{"label": "yes"}', "correct", 1.0),
    ("Table-Fact-Verification", "yes", 'x <think>{"label": "no"}</think>', "correct", 0.0),
    # literals the JVM cannot take (True / None) go to the Python second chance
    ("Table-Fact-Verification", True, "{'label': True}", "correct", 1.0),
    ("Table-Fact-Verification", "yes", "{'label': 'yes', 'why': None}", "correct", 1.0),
    ("Table-Fact-Verification", "yes", "{'label': 'no'} {'label': 'yes'}", "correct", 0.0),
    # Entity-Matching
    ("Entity-Matching", 1, '{"label": "match"}', "correct", 1.0),
    ("Entity-Matching", 0, '{"label": "match"}', "correct", 0.0),
    # Data-Imputation is type-sensitive
    ("Data-Imputation", "1", '{"value": 1}', "correct", 0.0),
    ("Data-Imputation", 1, '{"value": 1.0}', "correct", 1.0),
    # List-to-table trims pieces
    ("List-to-table", "a||b\nc||d", '{"table": "a || b\\nc||d "}', "correct", 1.0),
    # Formula: $ removed
    ("Formula-prediction-context", None, '{"formula": "=SUM($A$1:A3)"}', "correct", 1.0),
    # semantic-transform / header-value-matching: positional fractions
    ("semantic-transform", ["a", "b", "c", "d"], '{"output": ["a", "x", "c", "d"]}', "correct", 0.75),
    ("semantic-transform", ["a"], '{"output": ["a", "b"]}', "correct", 0.0),
    ("header-value-matching", ["a", "b"], '{"column_headers": [" a", "c"]}', "correct", 0.5),
    # Cell-entity-annotation: one of the labels
    ("Cell-entity-annotation", "Q1 Q2", '{"DBpedia entity": "Q2"}', "correct", 1.0),
]


@pytest.mark.parametrize("task,label,completion,col,expected", CASES)
def test_row_scorers(spark, task, label, completion, col, expected):
    extra = {"formula": "=SUM(A1:A3)"} if task == "Formula-prediction-context" else None
    r = score(spark, task, label, completion, extra)
    assert r[col] == pytest.approx(expected), r


def test_error_detect_sets(spark):
    r = score(spark, "Error-Detect", ["a", "b"], '{"obvious_error": ["a", "c"]}')
    assert (r["precision"], r["recall"]) == (0.5, 0.5)
    r = score(spark, "Error-Detect", [], '{"obvious_error": "null"}')
    assert (r["precision"], r["recall"]) == (None, None)
    r = score(spark, "Error-Detect", ["a"], "nothing")
    assert (r["precision"], r["recall"]) == (None, 0.0)
    r = score(spark, "Error-Detect", [], '{"obvious_error": ["x"]}')
    assert (r["precision"], r["recall"]) == (0.0, None)


def test_schema_matching_last_wins(spark):
    r = score(spark, "Schema-Matching", [["a", "x"], ["b", "y"]],
              '{"column_mappings": [["a", "z"], ["a", "x"], ["c", null]]}')
    assert (r["precision"], r["recall"]) == (1.0, 0.5)


def test_arithmetic_universe_filter(spark):
    r = score(spark, "Arithmetic-Relationship", ["A=B+C"],
              '{"Arithmetic-Relationship": ["A = B + C", "Z=X*Y"]}', {"labeled_formulas": ["A=B+C", "D=E-F"]})
    assert (r["precision"], r["recall"]) == (1.0, 1.0)


def test_functional_dependency_pairs(spark):
    r = score(spark, "Functional-Dependency", [["a", "b"], ["c", "d"]],
              '{"Functional-Dependency": [["a", "b"], ["x", "y"]]}', {"labeled_fds": [["a", "b"], ["c", "d"], ["x", "y"]]})
    assert (r["precision"], r["recall"]) == (0.5, 0.5)


def test_string_relation_order_sensitive(spark):
    r = score(spark, "String-Relationship", [[["a", "b"], "c"]], '{"String-Relationship": [[["b", "a"], "c"]]}')
    assert (r["precision"], r["recall"]) == (0.0, 0.0)


def test_equi_join_last_balanced_object(spark):
    comp = 'first {"joins": []} then {"joins": [{"from_table": "t1", "from_column": "a", "to_table": "t2", "to_column": "b"}]}'
    r = score(spark, "equi-join-detect", [["t1", "a", "t2", "b"]], comp)
    assert (r["precision"], r["recall"]) == (1.0, 1.0)


def test_semantic_join_malformed(spark):
    r = score(spark, "semantic-join", [["a", "b"]], '{"output": []}')
    assert (r["precision"], r["recall"]) == (None, 0.0)


def test_needle_both_keys(spark):
    r = score(spark, "Table-needle-in-a-haystack", None, '{"row": "3"} and {"column": " Name "}',
              {"needle_row_idx": 3, "needle_col_name": "name"})
    assert (r["correct"], r["row_correct"], r["col_correct"]) == (1.0, 1.0, 1.0)
    r = score(spark, "Table-needle-in-a-haystack", None, '{"row": 3}', {"needle_row_idx": 3, "needle_col_name": "n"})
    assert r["correct"] == 0.0 and r["error"] == "JSONParsingError"


def test_reshape_operator_lists(spark):
    label = [{"operator": "stack", "stack_start_idx": 1, "stack_end_idx": 3}]
    r = score(spark, "Data-transform-reshape", label,
              '{"transformation": "stack", "stack_start_idx": 1, "stack_end_idx": 3}',
              {"alternative_label": None})
    assert r["correct"] == 1.0


def test_error_classes(spark):
    for comp, cls in [("", "empty"), ("API Timeout (timeout=90)", "timeout"), ("Error: content filter", "content_filter"),
                      ("plain", "JSONParsingError"), ('{"answer": 1}', "normal")]:
        assert score(spark, "Table-QA", 1, comp)["error"] == cls
    df = spark.createDataFrame([(json.dumps({"task": "Table-QA", "label": 1}), None, "p")],
                               "metadata string, response string, prompt string")
    assert score_responses(df, ["Table-QA"]).first()["error"] == "empty"


def test_shared_inputs_are_computed_once(spark):
    from tablefold.functions import extract as X
    from tablefold.functions import scorers as S
    from tablefold.functions import values as V
    df = spark.sql('SELECT parse_json(\'{"y": [["a", "b"], ["a", "c"], [" d", 1]]}\') AS v, \'x {"a": {"b": 1}} y\' AS t')
    y = F.col("v")
    c = S.Ctx(y=V.field(y, "y"), found=y.isNotNull(), gt=V.field(y, "y"), meta=y, comp=F.col("t"))
    plan = lambda e: df.select(e.alias("e"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan(V.kind(y)).count("schema_of_variant(") == 1
    assert plan(S.prep_schema_match(c)[0]).count("array<array<string>>") <= 2
    assert plan(X.last_balanced_object(F.col("t"))).count("regexp_extract_all(") == 1
    assert df.select(S.prep_schema_match(c)[1].alias("e"), X.last_balanced_object(F.col("t")).alias("o")).first() == (["a\x1fc", "d\x1f1"], '{"a": {"b": 1}}')
