"""Responses -> scored rows (narrow stages only, no shuffle).

Input columns (S13 shape): ``prompt, metadata, response`` and optionally
``choices, task, prompt_tokens, completion_tokens, time_taken, model_name``
and the four size columns. Output: the fixed ``scored`` schema.

The work is split into a few projections so that each costly expression
(candidate regex, JSON parse, key lookup) is computed once per row and the
25 scorers read plain columns:

1. candidates: the flat ``{...}`` pieces (or the last balanced object) per row
2. parse: candidates -> VARIANT and MAP views, first unparsable index
3. hits: for each answer key, the first candidate that holds it
4. answer: Spark's pick, or -- only for rows where a candidate Spark cannot
   parse comes first -- the Python second chance (Arrow-batched, fed NULL
   everywhere else)
5. score: one ``CASE task`` per score column
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefold.functions import extract as X
from tablefold.functions import scorers as S
from tablefold.functions import values as V
from tablefold.session import ship_package, spread

SCORE_COLUMNS = ["correct", "correct_example", "row_correct", "col_correct", "precision", "recall"]
META_KEYS = ["dataset", "tag", "note", "version", "test_case"]


def _q(c: Column) -> Column:
    """JSON string literal for a text column."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _by_task(specs, fn, default: Column) -> Column:
    e = default
    for s in specs:
        e = F.when(F.col("_task") == s.task, fn(s)).otherwise(e)
    return e


def _keys(spec: S.TaskSpec) -> list[str]:
    if spec.key is None:
        return []
    return [spec.key] if isinstance(spec.key, str) else list(spec.key)


def _truth(spec: S.TaskSpec) -> Column:
    meta = F.col("_meta")
    if spec.task == "Formula-prediction-context":
        return V.field(meta, "formula")
    if spec.task == "Table-Locate-by-Row-Col":
        return V.field(meta, "needle_value")
    if spec.task == "Data-transform-reshape":
        return F.try_parse_json(F.concat(
            F.lit('{"label":'), F.coalesce(F.to_json(V.field(meta, "label")), F.lit("null")),
            F.lit(',"alternative_label":'), F.coalesce(F.to_json(V.field(meta, "alternative_label")), F.lit("null")),
            F.lit("}")))
    if spec.task == "Table-needle-in-a-haystack":
        # the column's name comes from the table's header (S20, joins.needle_truth) or from the metadata
        return F.try_parse_json(F.to_json(F.struct(
            F.try_variant_get(meta, "$.needle_row_idx", "bigint").alias("row"),
            F.coalesce(F.col("_needle_name"), F.try_variant_get(meta, "$.needle_col_name", "string")).alias("column"))))
    return V.field(meta, "label")


def extract_answers(df: DataFrame, specs: list[S.TaskSpec]) -> DataFrame:
    """Adds ``_y`` (VARIANT answer; object {row, column} for the needle task) and ``_found``."""
    pat = F.lit(X.FLAT_OBJECT_PATTERN)
    comp = F.col("completion")
    stripped = X.strip_think(comp)
    modes = {m: [s.task for s in specs if s.mode == m] for m in ("first", "multi", "last", "all")}
    of = lambda *ms: F.col("_task").isin([t for m in ms for t in modes[m]]) if any(modes[m] for m in ms) else F.lit(False)
    last_obj = X.last_balanced_object(stripped)
    cands = (F.when(of("first", "multi"), F.regexp_extract_all(stripped, pat, 0))
             .when(of("all"), F.regexp_extract_all(comp, pat, 0))
             .when(of("last"), F.filter(F.array(last_obj), lambda x: x.isNotNull())))
    keys = _by_task(specs, lambda s: F.array(*[F.lit(k) for k in _keys(s)]) if _keys(s)
                    else F.array().cast("array<string>"), F.array().cast("array<string>"))
    s1 = df.select("*", cands.alias("_cands"), keys.alias("_keys"), of("all").alias("_is_all"))

    s2 = s1.select("*", F.transform("_cands", lambda c: X.parse_candidate(c)).alias("_parsed"))
    s3 = s2.select(
        "*",
        F.transform("_parsed", lambda p: F.try_variant_get(p, "$", "map<string,variant>")).alias("_maps"),
        F.array_position(F.transform("_parsed", lambda p: p.isNull()), F.lit(True)).alias("_first_bad"))
    s4 = s3.select("*", F.transform("_keys", lambda k: F.array_position(
        F.transform("_maps", lambda m: F.coalesce(F.map_contains_key(m, k), F.lit(False))), F.lit(True)))
        .alias("_hits"))

    fb = F.col("_first_bad")
    need_py = (F.when(F.col("_is_all"), F.exists("_parsed", lambda p: p.isNull()))
               .otherwise(F.exists("_hits", lambda h: (fb > 0) & ((h == 0) | (fb < h)))))
    s5 = s4.select("*", F.coalesce(need_py, F.lit(False)).alias("_need_py"))

    zipped = F.arrays_zip(F.col("_keys").alias("k"), F.col("_hits").alias("h"))
    spark_obj = F.concat(F.lit("{"), F.array_join(F.transform(
        F.filter(zipped, lambda z: z["h"] > 0),
        lambda z: F.concat(_q(z["k"]), F.lit(":"),
                           F.to_json(F.element_at(F.element_at("_maps", z["h"].cast("int")), z["k"])))), ","), F.lit("}"))
    spark_all = F.when(F.size("_parsed") > 0, F.concat(
        F.lit("["), F.array_join(F.transform("_parsed", lambda p: F.to_json(p)), ","), F.lit("]")))
    py_obj = X.fallback_keys(F.when(F.col("_need_py") & ~F.col("_is_all"), F.col("_cands")), F.col("_keys"))
    py_all = X.fallback_all(F.when(F.col("_need_py") & F.col("_is_all"), F.col("_cands")))
    ans_text = (F.when(F.col("_is_all"), F.when(F.col("_need_py"), py_all).otherwise(spark_all))
                .otherwise(F.when(F.col("_need_py"), py_obj).otherwise(spark_obj)))
    s6 = s5.select("*", F.try_parse_json(ans_text).alias("_ans"))

    def pick(s):
        ks = _keys(s)
        if s.mode == "all":
            return F.col("_ans")
        if s.mode == "multi":
            ok = F.lit(True)
            for k in ks:
                ok = ok & V.field(F.col("_ans"), k).isNotNull()
            return F.when(ok, F.col("_ans"))
        return V.field(F.col("_ans"), ks[0])

    y = _by_task(specs, pick, F.lit(None).cast("variant"))
    drop = ["_cands", "_keys", "_is_all", "_parsed", "_maps", "_first_bad", "_hits", "_need_py", "_ans"]
    return s6.select("*", y.alias("_y")).drop(*drop).withColumn("_found", F.col("_y").isNotNull())


def score_responses(responses: DataFrame, tasks: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """X1-X17 + E-scorers: one row in, one scored row out.

    Only the task branches named in ``tasks`` (default: all text-scored tasks)
    are built; rows of other tasks keep NULL scores. ``carry`` names further columns that the scored rows keep.
    """
    ship_package(responses.sparkSession)
    responses = spread(responses)
    cols = set(responses.columns)
    task = F.coalesce(F.col("task"), X.metadata_field(F.col("metadata"), "task")) if "task" in cols \
        else X.metadata_field(F.col("metadata"), "task")
    comp = X.completion(F.col("response") if "response" in cols else F.lit(None).cast("string"),
                        F.col("choices") if "choices" in cols else None)
    base = responses.select("*", task.alias("_task"), V.json_variant(F.col("metadata")).alias("_meta"),
                            comp.alias("completion"),
                            (F.col("needle_col_name") if "needle_col_name" in cols else F.lit(None)).cast("string").alias("_needle_name"))
    specs = [S.REGISTRY[t] for t in (tasks or list(S.REGISTRY))]

    a = extract_answers(base, specs)
    marker = F.parse_json(F.lit('"' + V.PARSE_ERROR + '"'))
    a = a.select("*", _by_task(specs, _truth, F.lit(None).cast("variant")).alias("_gt"),
                 F.coalesce(F.col("_y"), marker).alias("_yv"))

    def ctx_of(spec, ts=None, ps=None):
        return S.Ctx(y=F.col("_y") if spec.mode in ("multi", "all") else F.col("_yv"), found=F.col("_found"),
                     gt=F.col("_gt"), meta=F.col("_meta"), comp=F.col("completion"), ts=ts, ps=ps)

    # set tasks: truth and answer item arrays in their own projection, so the
    # (interpreted) array lambdas run once per row however often scores use them
    set_specs = [s for s in specs if s.prep is not None]
    if set_specs:
        empty = F.lit(None).cast("array<string>")
        ts = _by_task(set_specs, lambda s: s.prep(ctx_of(s))[0], empty)
        ps = _by_task(set_specs, lambda s: s.prep(ctx_of(s))[1], empty)
        a = a.select("*", ts.alias("_ts"), ps.alias("_ps"))

    scores = {k: F.lit(None).cast("double") for k in SCORE_COLUMNS}
    for spec in specs:
        ctx = ctx_of(spec, F.col("_ts"), F.col("_ps")) if spec.prep is not None else ctx_of(spec)
        out = spec.scorer(ctx)
        for k in SCORE_COLUMNS:
            if k in out:
                scores[k] = F.when(F.col("_task") == spec.task, out[k]).otherwise(scores[k])

    def mf(k, t="string"):   # fields read from the metadata VARIANT parsed once per row
        return F.try_variant_get(F.col("_meta"), "$['" + k + "']", t)
    keyed = [mf(k).alias(k) for k in META_KEYS if k not in cols]
    size = [F.coalesce(F.col(k).cast(t), mf(k, t)).alias(k) if k in cols else mf(k, t).alias(k)
            for k, t in X.SIZE_COLUMNS.items()]
    carried = [c for c in ("prompt_tokens", "completion_tokens", "time_taken", "model_name") if c in cols]
    return a.select(
        F.col("_task").alias("task"),
        *[F.col(k) for k in META_KEYS if k in cols], *keyed,
        F.col("metadata"),
        F.coalesce(F.to_json("_y"), F.lit(V.PARSE_ERROR)).alias("y_pred"),
        F.to_json(V.field(F.col("_meta"), "label")).alias("y_gt"),
        *[v.alias(k) for k, v in scores.items()],
        # a NULL completion was already made '' (so it classes as empty, as the reference does)
        X.error_class(F.col("completion"), F.col("_found")).alias("error"),
        *size, *[F.col(c) for c in (*carried, *carry)],
    )
