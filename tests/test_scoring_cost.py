"""Work that scoring and building prompts do once, and the rows that they give."""

from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.operators.build import build_prompts
from tablefold.operators.score import score_responses
from tablefold.plans import building as B


def test_second_chance_travels_as_one_text(spark):
    """Candidates and keys reach Python unchanged; a task that takes one key does not ask for all objects."""
    rows = [(["{'a': True, 'b': 'x\"y\\n'}", "{nonsense}"], ["a", "b"]), (None, ["a"]), (["{'c': None}"], ["a"])]
    d = spark.createDataFrame(rows, "cands array<string>, keys array<string>")
    got = d.select(X.fallback_keys(F.col("cands"), F.col("keys")), X.fallback_all(F.col("cands"))).collect()
    assert list(map(tuple, got)) == [('{"a": true, "b": "x\\"y\\n"}', '[{"a": true, "b": "x\\"y\\n"}]'), (None, None), ("{}", '[{"c": null}]')]
    r = spark.createDataFrame([('{"task": "Table-QA", "label": "x"}', "{'answer': 'x', 'ok': True}"), ('{"label": "x"}', "{'answer': True}")], "metadata string, response string")
    scored = score_responses(r, ["Table-QA"], carry=("response",))
    assert [(x.correct, x.response[:9]) for x in scored.collect()] == [(1.0, "{'answer'"), (None, "{'answer'")]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "fallback_keys" in plan and "fallback_all" not in plan


def test_prompts_are_built_once(spark):
    texts = spark.createDataFrame([(f"file:/ds/{i}/data.csv", "id,qty,flag\n001,5.50,A\n002,6.50,N\n003,7.50,R\n") for i in (1, 2)], "file_path string, text string")
    cases = spark.createDataFrame([(p, i, f"file:/ds/{i}", f'{{"question": "q{i}", "file": "./data.csv", "hints": []}}') for p, i in (("5-LOW", "1"), ("1-URGENT", "2"), ("1-URGENT", "3"))],
                                  "dataset string, case_id string, case_path string, info_json string")
    built = build_prompts(texts, cases, B.TEMPLATE, B.CONFIG)
    assert {r.case_id: r.prompt for r in built.collect()} == {
        "1": "Read the table.\nid,qty,flag\n001,5.50,A\n002,6.50,N\n003,7.50,R\n{{{hints}}}\nQuestion: q1 {{{absent}}}",
        "2": "Read the table.\n|id|qty|flag|\n|---|---|---|\n|1|5.5|A|\n|2|6.5|N|\n\nQuestion: q2 {{{absent}}}", "3": None}
    plan = B.q_build_to_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2
