"""Aggregations over scored rows.

All are plain ``groupBy().agg()`` plans: Spark runs them as partial
(map-side) plus final aggregates, so only one small row per group and
partition crosses the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.functions import scorers as S

GROUP_KEYS = ["dataset", "tag", "note"]
# fixed values: size categories in report order
SIZE_ORDER = ["small", "medium", "large"]


def size_rank(c: Column) -> Column:
    return F.when(c == "small", 0).when(c == "medium", 1).when(c == "large", 2)


def _keyed_agg(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """groupBy + agg, then drop groups with a NULL key (pandas groupby drops them, ledger L13).

    The test is an aggregate output (``bool_and`` of the key checks, constant
    within a group), not a predicate on the grouping keys: a key predicate
    would be pushed below the aggregate and the scoring projections, into the
    scan, where it would rebuild the key columns.
    """
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    g = df.groupBy(*keys).agg(*aggs, F.bool_and(cond).alias("_keys_ok"))
    return g.filter(F.col("_keys_ok")).drop("_keys_ok")


def f1_of(prec: Column, rec: Column, variant: str = "or") -> Column:
    """F1 of the mean precision and recall.

    ``or``: 0 only when both are 0 (A3); ``and``: 0 when either is 0 (A4).
    NULL stays NULL (the reference's NaN, skipped by later means).
    """
    zero = (prec == 0) & (rec == 0) if variant == "or" else (prec == 0) | (rec == 0)
    return F.when(prec.isNull() | rec.isNull(), F.lit(None)) \
        .when(zero, F.lit(0.0)) \
        .otherwise(F.try_divide(2 * prec * rec, prec + rec)).cast("double")


# U1 --------------------------------------------------------------------------
def table_scored(verdicts: DataFrame, task: str, groups: DataFrame, key: str = "case_id") -> DataFrame:
    """Verdicts on produced tables (E1, E5, E14, E15: one row a case) as scored rows of ``task``.

    ``groups(case_id, dataset, tag, note, ...)`` gives the report keys; a case without a verdict scores 0 with the error class
    ``execution error``, as nothing was produced that could be compared.
    """
    rows = groups.join(verdicts, key, "left")
    return rows.withColumn("task", F.lit(task)).withColumn("test_case", F.col(key).cast("string")).withColumn(
        "error", F.when(F.col("correct").isNull(), "execution error")).withColumn("correct", F.coalesce("correct", F.lit(0.0))).drop(key)


def union_scored(*frames: DataFrame) -> DataFrame:
    """Scored rows of several tasks with differing columns, as one frame of all columns.

    A column's type is the widest that any frame gives it (numbers become DOUBLE, mixed kinds text); a frame that lacks it has NULL.
    """
    kinds: dict[str, set] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    merged = {n: k.copy().pop() if len(k) == 1 else "double" if all(x in numbers or x.startswith("decimal") for x in k) else "string" for n, k in kinds.items()}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*[F.col(n).cast(merged[n]).alias(n) for n in f.columns]) for f in frames])


# A1 / A2 -------------------------------------------------------------------
def group_accuracy(scored: DataFrame, keys: list[str] = GROUP_KEYS, extra: bool = False) -> DataFrame:
    aggs = [F.avg("correct").alias("acc")]
    if extra:
        aggs += [F.avg("correct_example").alias("acc_example"), F.avg("row_correct").alias("row_acc"),
                 F.avg("col_correct").alias("col_acc")]
    return _keyed_agg(scored, keys, *aggs)


# A3 / A4 -------------------------------------------------------------------
def group_prf(scored: DataFrame, keys: list[str] = GROUP_KEYS, variant: str = "or") -> DataFrame:
    g = _keyed_agg(scored, keys, F.avg("precision").alias("prec"), F.avg("recall").alias("recall"))
    return g.withColumn("f1", f1_of(F.col("prec"), F.col("recall"), variant))


def group_metrics(scored: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Every metric column for every (task, keys) group in one aggregate.

    ``metric`` is the task's primary metric value (acc or f1), taken from the
    registry (J4) by a small literal map -- no join needed.
    """
    k = ["task"] + keys
    g = _keyed_agg(
        scored, k,
        F.avg("correct").alias("acc"),
        F.avg("correct_example").alias("acc_example"),
        F.avg("row_correct").alias("row_acc"),
        F.avg("col_correct").alias("col_acc"),
        F.avg("precision").alias("prec"),
        F.avg("recall").alias("recall"),
        F.count(F.lit(1)).alias("n"),
    )
    kinds = {t: s.metric_kind for t, s in S.REGISTRY.items()}
    and_tasks = [t for t, v in kinds.items() if v == "prf_and"]
    f1 = F.when(F.col("task").isin(and_tasks), f1_of(F.col("prec"), F.col("recall"), "and")) \
        .otherwise(f1_of(F.col("prec"), F.col("recall"), "or"))
    prim = F.create_map(*[x for t, m in S.PRIMARY_METRIC.items() for x in (F.lit(t), F.lit(m))])
    g = g.withColumn("f1", f1)
    return g.withColumn("metric", F.try_element_at(prim, F.col("task"))) \
        .withColumn("value", F.when(F.col("metric") == "f1", F.col("f1")).otherwise(F.col("acc")))


# A5 / A6 -------------------------------------------------------------------
def task_scores(metrics: DataFrame) -> DataFrame:
    """Unweighted mean over groups of the primary metric, per task."""
    return metrics.groupBy("task").agg(F.first("metric").alias("metric"), F.avg("value").alias("score"),
                                       F.count(F.lit(1)).alias("n_groups"))


def overall_score(tasks: DataFrame) -> DataFrame:
    """Unweighted mean over tasks; tasks without a score are skipped."""
    return tasks.agg(F.avg("score").alias("overall"), F.count("score").alias("n_tasks"))


# A7 / A8 / A9 / A13 / A14 / A15 ----------------------------------------------
def by_size(scored: DataFrame, metric: str = "correct") -> DataFrame:
    return (scored.filter(F.col("_size_category").isin(SIZE_ORDER))
            .groupBy("_size_category")
            .agg(F.count(F.lit(1)).alias("count"), F.avg(metric).alias("accuracy"),
                 F.sum(metric).alias("correct_sum"))
            .withColumn("size_rank", size_rank(F.col("_size_category"))))


def by_task_size(scored: DataFrame, metric: str = "correct") -> DataFrame:
    # rows without the metric are skipped by count(metric)/avg, not by a filter (see analyze.failures)
    g = (scored.filter(F.col("_size_category").isin(SIZE_ORDER))
         .groupBy("task", "_size_category")
         .agg(F.count(metric).alias("count"), F.avg(metric).alias("accuracy"),
              F.sum(metric).alias("correct_sum")))
    return g.filter(F.col("count") > 0)


def task_size_wide(scored: DataFrame, metric: str = "effective_correct") -> DataFrame:
    """One row per task, ``<size>_accuracy`` and ``<size>_count`` columns."""
    p = (scored.filter(F.col("_size_category").isin(SIZE_ORDER))
         .groupBy("task").pivot("_size_category", SIZE_ORDER)
         .agg(F.avg(metric).alias("accuracy"), F.count(F.lit(1)).alias("count")))
    return p


def effective_correct(scored: DataFrame, compat: bool = False) -> DataFrame:
    """One score per row: correct, else F1 of the row's P/R (NULL -> 0), else 0.

    ``compat=True`` reproduces the whole-frame column choice of the reference
    (ledger L2): once any row has ``correct``, every row uses ``correct``.
    """
    p = F.coalesce(F.col("precision"), F.lit(0.0))
    r = F.coalesce(F.col("recall"), F.lit(0.0))
    f1_row = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    if compat:
        # one scalar (does any row carry `correct`?) decided by a global aggregate
        any_correct = scored.agg(F.max(F.col("correct").isNotNull().cast("int"))).first()[0] == 1
        eff = F.coalesce(F.col("correct"), F.lit(0.0)) if any_correct else f1_row
    else:
        eff = F.when(F.col("correct").isNotNull(), F.col("correct")) \
            .when(F.col("precision").isNotNull() | F.col("recall").isNotNull(), f1_row) \
            .otherwise(F.lit(0.0))
    return scored.withColumn("effective_correct", eff.cast("double"))


def size_stats(scored: DataFrame, metric: str = "effective_correct") -> DataFrame:
    """Per size: count, total and mean score, and cell/row/col stats."""
    return (scored.filter(F.col("_size_category").isNotNull())
            .groupBy("_size_category").agg(
                F.count(F.lit(1)).alias("count"), F.sum(metric).alias("total"), F.avg(metric).alias("accuracy"),
                F.avg("_table_cells").alias("avg_cells"), F.min("_table_cells").alias("min_cells"),
                F.max("_table_cells").alias("max_cells"), F.avg("_table_rows").alias("avg_rows"),
                F.avg("_table_cols").alias("avg_cols")))


def by_task(scored: DataFrame, metric: str = "effective_correct") -> DataFrame:
    return scored.groupBy("task").agg(F.avg(metric).alias("accuracy"), F.count(F.lit(1)).alias("count"))


def summary(scored: DataFrame, metric: str = "effective_correct") -> DataFrame:
    return scored.agg(F.avg(metric).alias("overall_accuracy"), F.count(F.lit(1)).alias("n_examples"),
                      F.count_distinct("task").alias("n_tasks"))


# A10 / A19 -----------------------------------------------------------------
def error_counts(scored: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """A10: one column per error class (fixed list, so no extra pass to find values)."""
    from tablefold.functions.extract import ERROR_CLASSES
    aggs = [F.count_if(F.col("error") == e).alias(e) for e in ERROR_CLASSES]
    return _keyed_agg(scored, keys, *aggs)


def error_count_long(scored: DataFrame, keys: list[str] = GROUP_KEYS) -> DataFrame:
    return _keyed_agg(scored, keys + ["error"], F.count(F.lit(1)).alias("count"))


# A11 -----------------------------------------------------------------------
def group_details(scored: DataFrame, keys: list[str] = GROUP_KEYS, cols: list[str] | None = None, order_by: str = "test_case",
                  most: int = 100, salts: int = 64) -> DataFrame:
    """Per group its number of rows and the first ``most`` of them as a list of structs, ordered by ``order_by`` and the other columns.

    ``most`` is the report's length, not a cap on what is read: the number counts every row. The first rows are taken in two steps, by
    (group, salt) and then by group, so that a group of a third of all rows is spread over ``salts`` tasks and no list is longer than ``most``.
    """
    cols = cols or ["test_case", "y_pred", "y_gt", "correct", "error"]
    item = F.struct(order_by, *[c for c in cols if c != order_by])
    rows = scored.select(*keys, item.alias("_item"), F.pmod(F.xxhash64(item), F.lit(salts)).alias("_salt"))
    w = Window.partitionBy(*keys, "_salt").orderBy("_item")
    ranked = rows.select("*", F.row_number().over(w).alias("_r"))
    part = ranked.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("_r") <= most, F.col("_item"))).alias("_top"))
    return _keyed_agg(part, keys, F.sum("_n").alias("n_rows"), F.slice(F.array_sort(F.flatten(F.collect_list("_top"))), 1, most).alias("rows"))


# A16 / A17 / A18 -----------------------------------------------------------
def needle_columns(scored: DataFrame) -> DataFrame:
    """Adds the needle's place and the length of the context, read from the metadata in one pass (NULL where absent)."""
    m = F.from_json("metadata", "needle_row_idx bigint, needle_col_idx bigint, context_length double")
    return scored.withColumn("_m", m).select("*", "_m.*").drop("_m")


def needle_bin(c: Column, step: int) -> Column:
    """``(int((i-1)/step)+1)*step`` with truncation toward zero (ledger L22)."""
    return ((((c - 1) / step).cast("int")) + 1) * step


def needle_heatmap(scored: DataFrame, row_col: str = "needle_row_idx", col_col: str = "needle_col_idx",
                   step: int = 5, keys: list[str] = GROUP_KEYS, values: list[str] = ["correct"]) -> DataFrame:
    """Mean of each of ``values`` per (row bin, column bin), and the rows; ``step=1`` leaves indices unbinned.

    Groups with a NULL key and rows without a place are left out.
    """
    bin_of = lambda c: needle_bin(F.col(c), step) if step > 1 else F.col(c)
    placed = scored.withColumn("row_bin", bin_of(row_col).cast("bigint")).withColumn("col_bin", bin_of(col_col).cast("bigint"))
    return _keyed_agg(placed, [*keys, "row_bin", "col_bin"], *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def heatmap_matrix(heatmap: DataFrame, keys: list[str] = GROUP_KEYS, values: list[str] = ["correct"]) -> DataFrame:
    """A16/A17 as matrices: one row per group and row bin, its cells as arrays over ``col_bins``.

    ``col_bins`` are all column bins of the group, ascending, so the rows of a group line up; a cell without rows is NULL (``n``: 0).
    The columns come from the data inside the plan, so no job runs to find them; the arrays are as long as the widest table has bins.
    """
    every = F.array_sort(F.collect_set("col_bin").over(Window.partitionBy(*keys)))
    cell = F.struct(*[F.col(v) for v in values], F.col("n"))
    g = heatmap.withColumn("col_bins", every).groupBy(*keys, "row_bin").agg(
        F.first("col_bins").alias("col_bins"), F.map_from_entries(F.collect_list(F.struct("col_bin", cell))).alias("_m"))
    get = lambda v: F.transform("col_bins", lambda b: F.try_element_at(F.col("_m"), b)[v])
    return g.select(*keys, "row_bin", "col_bins", *[get(v).alias(v) for v in values],
                    F.transform(get("n"), lambda n: F.coalesce(n, F.lit(0))).alias("n"))


def context_bins(scored: DataFrame, length_col: str = "context_length", bins: int = 10, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Adds ``len_bin``, one of ``bins`` equal, right-closed parts of the group's own [min, max]; the minimum is alone in bin 0.

    A bin is the number of edges below the length. The edges come from one aggregate, joined by the keys, so nothing runs while
    the query is planned. Groups with a NULL key and rows without a length are left out.
    """
    rows = scored.where(F.col(length_col).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(length_col).cast("double").alias("_lo"), F.max(length_col).cast("double").alias("_hi"))
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col(length_col)
    edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
    below = reduce(lambda a, b: a + b, [(e < x).cast("int") for e in edges])
    return rows.join(ends, keys).withColumn("len_bin", below).drop("_lo", "_hi")


def context_lengths(binned: DataFrame, length_col: str = "context_length", keys: list[str] = GROUP_KEYS) -> DataFrame:
    """Per group and length bin the mean length, the rows and the mean score."""
    return _keyed_agg(binned, [*keys, "len_bin"], F.avg(length_col).alias("mean_length"), F.avg("correct").alias("correct"), F.count(F.lit(1)).alias("n"))
