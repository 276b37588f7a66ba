"""Test inputs derived by Spark from the shared tables (FIXTURES.md recipes).

Every builder is a lazy plan over the given parquet tables, so its work grows
with them; nothing here is made-up fixed input. Each recipe has a DuckDB twin
in :mod:`tablefold.plans.oracle` that computes the *expected* result directly
from the same tables (the Spark side parses and scores the generated text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.sources.tables import table


def _q(c: Column) -> Column:
    """JSON string literal of a text column."""
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def size_category(cells: Column) -> Column:
    """Size bands on cell count (fixed values: 500 and 2000 cells)."""
    return F.when(cells < 500, "small").when(cells < 2000, "medium").otherwise("large")


# ---------------------------------------------------------------------------
# one response per order (Table-QA / Table-Fact-Verification)
# ---------------------------------------------------------------------------
def responses_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderpriority")
    k = F.col("o_orderkey")
    m = k % 8
    t3 = k % 3
    numeric = t3 == 2
    key = F.when(t3 == 0, F.lit("label")).otherwise(F.lit("answer"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    truth_txt = F.when(numeric, price.cast("string")).otherwise(F.col("o_orderstatus"))
    truth_json = F.when(numeric, truth_txt).otherwise(_q(F.col("o_orderstatus")))
    jk = F.concat(F.lit('{"'), key, F.lit('": '))
    resp = (F.when(m == 0, F.concat(jk, truth_json, F.lit("}")))
            .when(m == 1, F.concat(F.lit("<think>"), jk, F.lit('"no"}</think> '), jk,
                                   F.when(numeric, F.concat(F.lit('"$'), F.format_number(price, 2), F.lit('"')))
                                   .otherwise(truth_json), F.lit("}")))
            .when(m == 2, F.concat(F.lit("{'"), key, F.lit("': '"), truth_txt, F.lit("'}")))
            .when(m == 3, F.when(numeric, F.concat(jk, F.lit('"'), (price * 100).cast("string"), F.lit('%"}')))
                  .otherwise(F.concat(jk, F.lit('"wrong"}'))))
            .when(m == 4, F.concat(F.lit("answer is "), truth_txt))
            .when(m == 5, F.lit(""))
            .when(m == 6, F.lit("API Timeout (timeout=90)"))
            .otherwise(F.lit("Error: content filter")))
    rows = (F.col("o_custkey") % 60)
    cells = rows * 50
    task = F.when(t3 == 0, F.lit("Table-Fact-Verification")).otherwise(F.lit("Table-QA"))
    meta = F.concat(
        F.lit('{"task": '), _q(task),
        F.lit(', "dataset": '), _q(F.col("o_orderpriority")),
        F.lit(', "tag": "v1", "note": "", "version": "v1.0", "test_case": '), k.cast("string"),
        F.lit(', "label": '), truth_json,
        F.lit(', "_table_rows": '), rows.cast("string"),
        F.lit(', "_table_cols": 50, "_table_cells": '), cells.cast("string"),
        F.lit(', "_size_category": '), _q(size_category(cells)),
        F.lit("}"))
    prompt = F.concat(F.lit("Order "), k.cast("string"), F.lit(": answer the question."))
    return o.select(
        prompt.alias("prompt"),
        meta.alias("metadata"),
        resp.alias("response"),
        (F.lit(10) + k % 50).cast("bigint").alias("prompt_tokens"),
        F.length(resp).cast("bigint").alias("completion_tokens"),
        ((k % 100) / 10.0).alias("time_taken"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("model_name"),
    )


# ---------------------------------------------------------------------------
# set answers per order with lines (Error-Detect and the other set tasks)
# ---------------------------------------------------------------------------
def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: truth set of part keys and the answer set (as text arrays).

    truth = distinct l_partkey; answer = truth minus keys with partkey % 5 = 0
    plus 'x'||suppkey where suppkey % 7 = 0. Orders with key % 11 = 0 get an
    empty truth, % 13 = 0 an empty answer. One groupBy(l_orderkey) shuffle,
    partial-aggregated per map task.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    g = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("truth_all"),
        F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string"))))
        .alias("kept"),
        F.array_sort(F.collect_set(F.when(F.col("l_suppkey") % 7 == 0,
                                          F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))))).alias("extra"),
        F.array_sort(F.collect_set(F.struct(F.col("l_partkey").cast("string").alias("a"),
                                            F.col("l_suppkey").cast("string").alias("b")))).alias("pairs_all"),
        F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 5 != 0, F.struct(
            F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b")))))
        .alias("pairs_kept"),
    )
    k = F.col("l_orderkey")
    empty = F.array().cast("array<string>")
    return g.select(
        k.alias("test_case"),
        F.concat(F.lit("d"), (k % 4).cast("string")).alias("dataset"),
        F.when(k % 11 == 0, empty).otherwise(F.col("truth_all")).alias("truth"),
        F.when(k % 13 == 0, empty).otherwise(F.concat("kept", "extra")).alias("answer"),
        F.when(k % 11 == 0, F.array().cast("array<struct<a:string,b:string>>")).otherwise(F.col("pairs_all"))
        .alias("truth_pairs"),
        F.when(k % 13 == 0, F.array().cast("array<struct<a:string,b:string>>")).otherwise(
            F.concat("pairs_kept", F.transform("extra", lambda x: F.struct(x.alias("a"), x.alias("b")))))
        .alias("answer_pairs"),
    )


def _json_list(arr: Column) -> Column:
    return F.to_json(arr)


def set_responses(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    """F2 responses for one set-scored task, built from :func:`order_sets`."""
    s = order_sets(spark, sf_dir)
    truth, ans = F.col("truth"), F.col("answer")
    tp, ap = F.col("truth_pairs"), F.col("answer_pairs")
    pair_list = lambda a: F.to_json(F.transform(a, lambda p: F.array(p["a"], p["b"])))
    extra_meta = F.lit("")
    if task == "Error-Detect":
        label = _json_list(truth)
        resp = F.concat(F.lit('Errors: {"obvious_error": '), _json_list(ans), F.lit("}"))
    elif task == "Arithmetic-Relationship":
        f = lambda a: F.transform(a, lambda x: F.concat(F.lit("P"), x, F.lit("=A+B")))
        label = _json_list(f(truth))
        # answers with blanks (stripped by the scorer); extras fall outside the universe
        spaced = F.transform(ans, lambda x: F.concat(F.lit("P"), x, F.lit(" = A + B")))
        resp = F.concat(F.lit('{"Arithmetic-Relationship": '), _json_list(spaced), F.lit("}"))
        universe = F.array_union(f(truth), f(F.filter(ans, lambda x: ~x.startswith("x"))))
        extra_meta = F.concat(F.lit(', "labeled_formulas": '), _json_list(universe))
    elif task == "Functional-Dependency":
        label = pair_list(tp)
        resp = F.concat(F.lit('{"Functional-Dependency": '), pair_list(ap), F.lit("}"))
        universe = F.array_union(tp, F.filter(ap, lambda p: ~p["a"].startswith("x")))
        extra_meta = F.concat(F.lit(', "labeled_fds": '), pair_list(universe))
    elif task == "String-Relationship":
        sr = lambda a: F.to_json(F.transform(a, lambda p: F.array(F.to_json(F.array(p["a"])), p["b"])))
        sr_json = lambda a: F.regexp_replace(F.regexp_replace(sr(a), r'"\[', "["), r'\]"', "]")
        sr_json = lambda a: F.concat(F.lit("["), F.array_join(F.transform(
            a, lambda p: F.concat(F.lit('[["'), p["a"], F.lit('"], "'), p["b"], F.lit('"]'))), ", "), F.lit("]"))
        label = sr_json(tp)
        resp = F.concat(F.lit('{"String-Relationship": '), sr_json(ap), F.lit("}"))
    elif task == "semantic-join":
        label = pair_list(tp)
        resp = F.concat(F.lit('{"output": '), pair_list(ap), F.lit("}"))
    elif task == "equi-join-detect":
        quad = lambda p: F.to_json(F.array(F.lit("lineitem"), p["a"], F.lit("part"), p["b"]))
        label = F.concat(F.lit("["), F.array_join(F.transform(tp, quad), ", "), F.lit("]"))
        obj = lambda p: F.concat(F.lit('{"from_table": "lineitem", "from_column": "'), p["a"],
                                 F.lit('", "to_table": "part", "to_column": "'), p["b"], F.lit('"}'))
        resp = F.concat(F.lit('Reasoning {"note": {"x": 1}} then {"joins": ['),
                        F.array_join(F.transform(ap, obj), ", "), F.lit("]}"))
    elif task == "Schema-Matching":
        label = pair_list(tp)
        resp = F.concat(F.lit('{"column_mappings": '), pair_list(ap), F.lit("}"))
    else:
        raise ValueError(task)
    meta = F.concat(F.lit('{"task": '), _q(F.lit(task)), F.lit(', "dataset": '), _q(F.col("dataset")),
                    F.lit(', "tag": "v1", "note": "", "test_case": '), F.col("test_case").cast("string"),
                    F.lit(', "label": '), label, extra_meta, F.lit("}"))
    return s.select(F.concat(F.lit("Order "), F.col("test_case").cast("string")).alias("prompt"),
                    meta.alias("metadata"), resp.alias("response"))
