"""The task scorers as column expressions.

Each scorer gets a :class:`Ctx` of columns for one response row and returns a
dict of score columns (``correct`` or ``precision``/``recall`` and friends).
Scorers whose truth is a whole table (E1, E5, E14, E15) compare cells and
live in :mod:`tablefold.operators.compare`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.functions import values as V


@dataclass
class Ctx:
    y: Column          # VARIANT answer, the parse-error marker text when none was found
    found: Column      # BOOLEAN: an answer object was found
    gt: Column         # VARIANT truth
    meta: Column       # VARIANT metadata object
    comp: Column       # completion text
    ts: Column | None = None   # set tasks: truth items (ARRAY<STRING>), computed once in a prep stage
    ps: Column | None = None   # set tasks: answer items (ARRAY<STRING>)


def _d(x) -> Column:
    return F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double")


def _bool01(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _is_marker(y: Column) -> Column:
    return (V.kind(y) == "string") & (V.as_string(y) == V.PARSE_ERROR)


# ---------------------------------------------------------------------------
# shared set rule
# ---------------------------------------------------------------------------
def prf(truth: Column, pred: Column) -> dict[str, Column]:
    """Precision / recall of two arrays treated as sets.

    Empty truth: recall NULL, precision NULL if the answer is empty else 0.
    Empty answer: recall 0, precision NULL.
    """
    t = F.array_distinct(F.coalesce(truth, F.array()))
    p = F.array_distinct(F.coalesce(pred, F.array()))
    nt, np_, tp = F.size(t), F.size(p), F.size(F.array_intersect(t, p))
    precision = (F.when(nt == 0, F.when(np_ == 0, F.lit(None)).otherwise(F.lit(0.0)))
                 .when(np_ == 0, F.lit(None))
                 .otherwise(tp / np_))
    recall = (F.when(nt == 0, F.lit(None))
              .when(np_ == 0, F.lit(0.0))
              .otherwise(tp / nt))
    return {"precision": precision.cast("double"), "recall": recall.cast("double")}


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


# ---------------------------------------------------------------------------
# E2 Table-QA
# ---------------------------------------------------------------------------
def score_tableqa(c: Ctx) -> dict[str, Column]:
    ts, ps = V.py_str(c.gt), V.py_str(c.y)
    same_text = F.lower(ts) == F.lower(ps)
    tf = F.round(V.py_float(c.gt), 2)
    pk = V.kind(c.y)
    ptxt = V.as_string(c.y)
    pct = V.text_to_decimal(F.replace(ptxt, F.lit("%"), F.lit("")))
    dol = V.text_to_decimal(F.replace(F.replace(ptxt, F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
    pct_ok = (tf == F.round(pct, 2)) | (tf == F.round(pct / 100, 2))
    correct = (F.when(same_text, True)
               .when(pk == "string",
                     F.when(F.contains(ptxt, F.lit("%")), F.coalesce(pct_ok, F.lit(False)))
                     .when(F.contains(ptxt, F.lit("$")), F.coalesce(tf == F.round(dol, 2), F.lit(False)))
                     .otherwise(False))
               .otherwise(F.coalesce(tf == F.round(V.py_float(c.y), 2), F.lit(False))))
    return {"correct": _bool01(correct)}


# E3 Table-Fact-Verification ---------------------------------------------------
def score_lower_equal(c: Ctx) -> dict[str, Column]:
    return {"correct": _bool01(F.lower(V.py_str(c.gt)) == F.lower(V.py_str(c.y)))}


# E4 Error-Detect --------------------------------------------------------------
def _ed_pred(y: Column) -> Column:
    k = V.kind(y)
    s = V.as_string(y)
    return (F.when(_is_marker(y) | (k == "null"), F.array())
            .when(k == "string", F.when(F.lower(s) == "null", F.array()).otherwise(F.array(s)))
            .when(k.isin("integer", "number"), F.array(V.py_str(y)))
            .when(k == "array", V.string_array(y))
            .otherwise(F.array()))


def prep_error_detect(c: Ctx) -> tuple[Column, Column]:
    return V.string_array(c.gt), _ed_pred(c.y)


def score_prf(c: Ctx) -> dict[str, Column]:
    """Set tasks: precision / recall of the prepared item arrays."""
    return prf(c.ts, c.ps)


# E6 Entity-Matching -----------------------------------------------------------
def score_entity_match(c: Ctx) -> dict[str, Column]:
    t = F.try_variant_get(c.gt, "$", "bigint")
    p = V.as_string(c.y)
    ok = ((t == 1) & (V.kind(c.y) == "string") & (p == "match")) | \
         ((t == 0) & (V.kind(c.y) == "string") & (p == "non-match"))
    return {"correct": _bool01(F.coalesce(ok, F.lit(False)))}


# E7 Table-needle-in-a-haystack (y = VARIANT object {row, column}, NULL unless both found) --
def score_needle(c: Ctx) -> dict[str, Column]:
    prow, pcol = V.field(c.y, "row"), V.field(c.y, "column")
    trow, tcol = V.field(c.gt, "row"), V.field(c.gt, "column")
    both = c.y.isNotNull()

    def as_int(v):
        k = V.kind(v)
        return (F.when(k == "integer", F.try_variant_get(v, "$", "bigint"))
                .when(k == "number", F.try_variant_get(v, "$", "double").cast("bigint"))
                .when(k == "string", F.trim(V.as_string(v)).try_cast("bigint"))
                .when(k == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), 1).otherwise(0).cast("bigint")))

    row_ok = both & F.coalesce(as_int(trow) == as_int(prow), F.lit(False))
    col_ok = both & F.coalesce(F.lower(X.pystrip(V.py_str(tcol))) == F.lower(X.pystrip(V.py_str(pcol))),
                               F.lit(False))
    return {"correct": _bool01(row_ok & col_ok), "row_correct": _bool01(row_ok), "col_correct": _bool01(col_ok)}


# E8 Table-Locate-by-Row-Col ---------------------------------------------------
def score_locate(c: Ctx) -> dict[str, Column]:
    same = V.py_str(c.gt) == V.py_str(c.y)
    tf, pf = V.py_double(c.gt), V.py_double(c.y)
    return {"correct": _bool01(same | F.coalesce(tf == pf, F.lit(False)))}


# E9 Schema-Matching -----------------------------------------------------------
def _dedup_last(ents: Column) -> Column:
    """Keep the last entry per key (Python dict semantics), in first-seen key order."""
    def last(e: Column, keys: Column) -> Column:
        # a list without a repeated key, by far the most, is left as it is
        n = F.size(keys)
        kept = V.once(F.reverse(keys), lambda back: F.transform(F.array_distinct(keys), lambda k: F.element_at(
            e, (n - F.array_position(back, k) + 1).cast("int"))))
        return F.when(F.size(F.array_distinct(keys)) == n, e).otherwise(kept)

    return V.once(ents, lambda e: V.once(F.transform(e, lambda x: x["key"]), lambda keys: last(e, keys)))


def _clean_entries(ents: Column) -> Column:
    ents = F.transform(ents, lambda e: F.struct(
        F.when(e["key"] == "nan", "None").otherwise(e["key"]).alias("key"),
        F.when(e["value"] == "nan", "None").otherwise(e["value"]).alias("value")))
    return F.filter(ents, lambda e: (F.length(e["value"]) > 0) & (e["key"] != "None") & (e["value"] != "None"))


def _mapping_entries(v: Column) -> Column:
    """Pairs of a mapping list -> deduplicated (last wins) array of struct(key, value).

    Fast path: one typed cast to ``array<array<string>>`` (JSON null -> 'None');
    other shapes take the element-wise VARIANT path.
    """
    fast = lambda typed: F.transform(F.filter(typed, lambda x: F.coalesce(F.size(x) == 2, F.lit(False))), lambda x: F.struct(
        X.pystrip(F.coalesce(x[0], F.lit("None"))).alias("key"),
        X.pystrip(F.coalesce(x[1], F.lit("None"))).alias("value")))
    arr = F.coalesce(_arr(v), F.array())
    pairs = F.filter(arr, lambda e: F.coalesce(F.size(_arr(e)) == 2, F.lit(False)))
    slow = F.transform(pairs, lambda e: F.struct(
        X.pystrip(V.py_str(F.element_at(_arr(e), 1))).alias("key"),
        X.pystrip(V.py_str(F.element_at(_arr(e), 2))).alias("value")))
    ents = V.once(F.try_variant_get(v, "$", "array<array<string>>"), lambda typed: F.when(typed.isNotNull(), fast(typed)).otherwise(slow))
    return _dedup_last(_clean_entries(ents))


def prep_schema_match(c: Ctx) -> tuple[Column, Column]:
    enc = lambda ents: F.transform(ents, lambda e: F.concat(e["key"], F.lit("\u001f"), e["value"]))
    return enc(_mapping_entries(c.gt)), enc(_mapping_entries(c.y))


def score_schema_match(c: Ctx) -> dict[str, Column]:
    # both sides hold one entry per key, so equal (key, value) items are the matching keys
    hits = F.size(F.array_intersect(c.ts, c.ps))
    nt, np_ = F.size(c.ts), F.size(c.ps)
    return {"recall": F.when(nt > 0, hits / nt).cast("double"),
            "precision": F.when(np_ > 0, hits / np_).cast("double")}


# E10 Data-transform-reshape ---------------------------------------------------
def _op_list(v: Column, rename: bool) -> Column:
    """Canonical text per operator object (sorted keys), as an array; NULL when not a list of objects."""
    k = V.kind(v)
    arr = F.when(k == "object", F.array(v)).when(k == "array", _arr(v))
    objs_ok = F.forall(arr, lambda e: V.kind(e) == "object")

    def canon(e):
        m = F.try_variant_get(e, "$", "map<string,variant>")
        if rename:
            m = F.when(F.map_contains_key(m, "transformation"),
                       F.map_concat(F.map_filter(m, lambda kk, vv: kk != "transformation"),
                                    F.create_map(F.lit("operator"), F.element_at(m, F.lit("transformation")))))\
                .otherwise(m)
        ents = F.array_sort(F.map_entries(F.transform_values(m, lambda kk, vv: F.to_json(vv))))
        return F.to_json(ents)

    return F.when(objs_ok, F.transform(arr, canon))


def score_reshape(c: Ctx) -> dict[str, Column]:
    # y is the VARIANT array of all objects found (X7), NULL when none
    pred = _op_list(c.y, rename=True)
    lab = _op_list(V.field(c.gt, "label"), rename=False)
    alt_v = V.field(c.gt, "alternative_label")
    alt = _op_list(alt_v, rename=False)
    ok = F.coalesce(pred == lab, F.lit(False)) | F.coalesce((F.size(alt) > 0) & (pred == alt), F.lit(False))
    return {"correct": _bool01(c.y.isNotNull() & ok)}


# E11 Data-Imputation ----------------------------------------------------------
def score_exact(c: Ctx) -> dict[str, Column]:
    """Type-sensitive equality (1 == 1.0 holds, "1" == 1 does not)."""
    kt, kp = V.kind(c.gt), V.kind(c.y)
    num = kt.isin("integer", "number", "boolean") & kp.isin("integer", "number", "boolean")
    whole = (kt == "integer") & (kp == "integer")
    eq = F.when(whole, F.to_json(c.gt) == F.to_json(c.y)).when(num, V.py_double(c.gt) == V.py_double(c.y)).otherwise((kt == kp) & (F.to_json(c.gt) == F.to_json(c.y)))
    return {"correct": _bool01(F.coalesce(eq, F.lit(False)))}


# E12 List-to-table ------------------------------------------------------------
def score_list_to_table(c: Ctx) -> dict[str, Column]:
    p = V.py_str(c.y)
    rows = F.transform(F.split(p, "\n"),
                       lambda r: F.array_join(F.transform(F.split(r, r"\|\|"), lambda x: X.pystrip(x)), "||"))
    return {"correct": _bool01(F.coalesce(V.py_str(c.gt) == F.array_join(rows, "\n"), F.lit(False)))}


# E13 Formula-prediction-context -----------------------------------------------
def score_formula(c: Ctx) -> dict[str, Column]:
    norm = lambda v: X.pystrip(F.replace(V.py_str(v), F.lit("$"), F.lit("")))
    return {"correct": _bool01(F.coalesce(norm(c.gt) == norm(c.y), F.lit(False)))}


# E16 semantic-transform / E18 header-value-matching ---------------------------
def _positional(truth: Column, pred: Column) -> Column:
    n = F.size(truth)
    eq = F.zip_with(truth, pred, lambda a, b: F.when(a == b, 1).otherwise(0))
    frac = F.aggregate(eq, F.lit(0), lambda acc, x: acc + x) / n
    return F.when((n > 0) & (n == F.size(pred)), frac).otherwise(F.lit(0.0)).cast("double")


def score_semantic_transform(c: Ctx) -> dict[str, Column]:
    t = F.transform(_arr(c.gt), lambda e: F.to_json(e))
    p = F.transform(_arr(c.y), lambda e: F.to_json(e))
    return {"correct": F.coalesce(_positional(t, p), F.lit(0.0))}


def score_header_match(c: Ctx) -> dict[str, Column]:
    def strs(v):
        a = _arr(v)
        return F.when(F.forall(a, lambda e: V.kind(e) == "string"),
                      F.transform(a, lambda e: X.pystrip(V.as_string(e))))
    return {"correct": F.coalesce(_positional(strs(c.gt), strs(c.y)), F.lit(0.0))}


# E17 semantic-join ------------------------------------------------------------
def _pairs(v: Column) -> Column:
    """Distinct (col1, col2) text pairs of a two-column answer; NULL when malformed or empty."""
    typed = F.try_variant_get(v, "$", "array<array<string>>")
    fast_ok = (F.size(typed) > 0) & F.forall(typed, lambda x: F.size(x) == 2)
    fast = F.array_distinct(F.transform(typed, lambda x: F.struct(F.coalesce(x[0], F.lit("None")).alias("col1"),
                                                                   F.coalesce(x[1], F.lit("None")).alias("col2"))))
    a = _arr(v)

    def two(e):
        k = V.kind(e)
        return F.when(k == "array", _arr(e)).when(
            k == "object", F.map_values(F.try_variant_get(e, "$", "map<string,variant>")))

    ok = (F.size(a) > 0) & F.forall(a, lambda e: F.coalesce(F.size(two(e)) == 2, F.lit(False)))
    slow = F.when(ok, F.array_distinct(F.transform(a, lambda e: F.struct(
        V.py_str(F.element_at(two(e), 1)).alias("col1"), V.py_str(F.element_at(two(e), 2)).alias("col2")))))
    return F.when(typed.isNotNull(), F.when(fast_ok, fast)).otherwise(slow)


def prep_semantic_join(c: Ctx) -> tuple[Column, Column]:
    enc = lambda ps: F.transform(ps, lambda x: F.concat(x["col1"], F.lit("\u001f"), x["col2"]))
    return enc(_pairs(c.gt)), enc(_pairs(c.y))


def score_semantic_join(c: Ctx) -> dict[str, Column]:
    valid = c.ts.isNotNull() & c.ps.isNotNull()
    common = F.size(F.array_intersect(c.ts, c.ps))
    return {"precision": F.when(valid, common / F.size(c.ps)).cast("double"),
            "recall": F.when(valid, common / F.size(c.ts)).otherwise(F.lit(0.0)).cast("double")}


# E19 Arithmetic-Relationship --------------------------------------------------
def prep_arithmetic(c: Ctx) -> tuple[Column, Column]:
    universe = V.string_array(V.field(c.meta, "labeled_formulas"))
    k = V.kind(c.y)
    raw = (F.when(_is_marker(c.y) | (k == "null"), F.array())
           .when(k == "string", F.array(V.as_string(c.y)))
           .when(k == "array", V.string_array(c.y))
           .otherwise(F.array()))
    cleaned = F.transform(raw, lambda x: F.regexp_replace(x, r"\s+", ""))
    kept = V.once(universe, lambda u: F.filter(cleaned, lambda x: F.coalesce(F.array_contains(u, x), F.lit(False))))
    return V.string_array(c.gt), kept


# E20 Functional-Dependency ----------------------------------------------------
def _tuple_text(e: Column) -> Column:
    return F.to_json(F.try_variant_get(e, "$", "array<variant>"))


def prep_fd(c: Ctx) -> tuple[Column, Column]:
    universe = F.transform(_arr(V.field(c.meta, "labeled_fds")), _tuple_text)
    pred = V.once(_arr(c.y), lambda a: F.when(F.forall(a, lambda e: V.kind(e) == "array"), V.once(universe, lambda u: F.filter(
        F.transform(a, _tuple_text), lambda x: F.coalesce(F.array_contains(u, x), F.lit(False))))))
    return F.transform(_arr(c.gt), _tuple_text), F.coalesce(pred, F.array())


# E21 String-Relationship ------------------------------------------------------
def _sr_item(e: Column) -> Column:
    return V.once(_arr(e), lambda parts: F.to_json(F.struct(
        F.to_json(F.try_variant_get(F.element_at(parts, 1), "$", "array<variant>")).alias("s"), F.to_json(F.element_at(parts, 2)).alias("t"))))


def prep_string_relation(c: Ctx) -> tuple[Column, Column]:
    ok = lambda a: F.forall(a, lambda e: V.once(_arr(e), lambda x: F.coalesce(
        (F.size(x) == 2) & (V.kind(F.get(x, F.lit(0))) == "array"), F.lit(False))))
    pred = V.once(_arr(c.y), lambda a: F.when(ok(a), F.transform(a, _sr_item)))
    return F.transform(_arr(c.gt), _sr_item), F.coalesce(pred, F.array())


# E22-E24 annotation tasks -----------------------------------------------------
def score_entity_annotation(c: Ctx) -> dict[str, Column]:
    labels = F.split(X.pystrip(V.py_str(c.gt)), r"\s+")
    return {"correct": _bool01((V.kind(c.y) == "string") & F.array_contains(labels, V.as_string(c.y)))}


def score_equal(c: Ctx) -> dict[str, Column]:
    return score_exact(c)


# E25 equi-join-detect ---------------------------------------------------------
def prep_equi_join(c: Ctx) -> tuple[Column, Column]:
    def quad_pred(e):
        return F.to_json(F.array(*[F.coalesce(F.to_json(V.field(e, k)), F.lit("null"))
                                   for k in ("from_table", "from_column", "to_table", "to_column")]))

    def quad_truth(e):
        return V.once(_arr(e), lambda parts: F.when(F.size(parts) == 4, F.to_json(F.transform(parts, lambda x: F.to_json(x)))))

    pred = V.once(_arr(c.y), lambda a: F.when(F.forall(a, lambda e: V.kind(e) == "object"), F.transform(a, quad_pred)))
    truth = F.filter(F.transform(_arr(c.gt), quad_truth), lambda x: x.isNotNull())
    return truth, F.coalesce(pred, F.array())


# ---------------------------------------------------------------------------
# The registry. answer key, extraction mode, scorer, group metric kind,
# primary metric (fixed values: task names and keys must equal the reference's)
# ---------------------------------------------------------------------------
@dataclass
class TaskSpec:
    task: str
    key: str | list[str] | None
    mode: str                 # first | multi | last | all | none
    scorer: Callable[[Ctx], dict]
    metric_kind: str          # acc | prf | prf_and | acc_pbe | acc_needle
    primary: str              # acc | f1
    prep: Callable[[Ctx], tuple] | None = None   # set tasks: (truth items, answer items)


REGISTRY: dict[str, TaskSpec] = {s.task: s for s in [
    TaskSpec("Table-QA", "answer", "first", score_tableqa, "acc", "acc"),
    TaskSpec("Table-Fact-Verification", "label", "first", score_lower_equal, "acc", "acc"),
    TaskSpec("Error-Detect", "obvious_error", "first", score_prf, "prf", "f1", prep_error_detect),
    TaskSpec("Entity-Matching", "label", "first", score_entity_match, "acc", "acc"),
    TaskSpec("Table-needle-in-a-haystack", ["row", "column"], "multi", score_needle, "acc_needle", "acc"),
    TaskSpec("Table-Locate-by-Row-Col", "cell", "first", score_locate, "acc", "acc"),
    TaskSpec("Schema-Matching", "column_mappings", "first", score_schema_match, "prf_and", "f1", prep_schema_match),
    TaskSpec("Data-transform-reshape", None, "all", score_reshape, "acc", "acc"),
    TaskSpec("Data-Imputation", "value", "first", score_exact, "acc", "acc"),
    TaskSpec("List-to-table", "table", "first", score_list_to_table, "acc", "acc"),
    TaskSpec("Formula-prediction-context", "formula", "first", score_formula, "acc", "acc"),
    TaskSpec("semantic-transform", "output", "first", score_semantic_transform, "acc", "acc"),
    TaskSpec("semantic-join", "output", "first", score_semantic_join, "prf", "f1", prep_semantic_join),
    TaskSpec("header-value-matching", "column_headers", "first", score_header_match, "acc", "acc"),
    TaskSpec("Arithmetic-Relationship", "Arithmetic-Relationship", "first", score_prf, "prf", "f1", prep_arithmetic),
    TaskSpec("Functional-Dependency", "Functional-Dependency", "first", score_prf, "prf", "f1", prep_fd),
    TaskSpec("String-Relationship", "String-Relationship", "first", score_prf, "prf", "f1", prep_string_relation),
    TaskSpec("Cell-entity-annotation", "DBpedia entity", "first", score_entity_annotation, "acc", "acc"),
    TaskSpec("Column-type-annotation", "DBpedia ontology class", "first", score_equal, "acc", "acc"),
    TaskSpec("Columns-property-anotation", "DBpedia property", "first", score_equal, "acc", "acc"),
    TaskSpec("equi-join-detect", "joins", "last", score_prf, "prf", "f1", prep_equi_join),
]}

# tasks scored by comparing produced tables (see operators.compare)
TABLE_TASKS = {"NL2SQL": "acc", "Data-transform-pbe": "acc",
               "Transform-by-output-target-schema": "acc", "Transform-by-input-output-table": "acc"}

PRIMARY_METRIC = {**{t: s.primary for t, s in REGISTRY.items()}, **TABLE_TASKS}
