"""Analysis reports over scored rows.

Inputs carry ``effective_correct`` (A12). Every report is a small aggregate
(one row per task or size); windows run over those aggregates, never over
the scored rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators.metrics import SIZE_ORDER, size_rank

METRIC = "effective_correct"


def task_means(df: DataFrame, metric: str = METRIC) -> DataFrame:
    return df.groupBy("task").agg(F.avg(metric).alias("accuracy"))


def extreme_tasks(df: DataFrame, k: int = 5, metric: str = METRIC) -> DataFrame:
    """Worst k and best k tasks by mean (ties by task name)."""
    t = task_means(df, metric)
    worst = Window.partitionBy(F.lit(1)).orderBy(F.col("accuracy").asc(), F.col("task").asc())
    best = Window.partitionBy(F.lit(1)).orderBy(F.col("accuracy").desc(), F.col("task").asc())
    w = t.withColumn("rank", F.row_number().over(worst)).filter(F.col("rank") <= k).withColumn("side", F.lit("worst"))
    b = t.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("side", F.lit("best"))
    return w.unionByName(b)


def size_means(df: DataFrame, metric: str = METRIC) -> DataFrame:
    return (df.filter(F.col("_size_category").isin(SIZE_ORDER)).groupBy("_size_category")
            .agg(F.avg(metric).alias("accuracy"), F.max("_table_cells").alias("max_cells"))
            .withColumn("size_rank", size_rank(F.col("_size_category"))))


def rank_sizes(df: DataFrame, metric: str = METRIC) -> DataFrame:
    """Sizes ordered by mean ascending (ties by size order)."""
    s = size_means(df, metric)
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("accuracy").asc(), F.col("size_rank").asc())
    return s.withColumn("rank", F.row_number().over(w))


def degradation(df: DataFrame, threshold: float = 0.15, metric: str = METRIC) -> DataFrame:
    """Relative drop between consecutive present sizes; flag drops above ``threshold``."""
    s = size_means(df, metric)
    w = Window.partitionBy(F.lit(1)).orderBy("size_rank")
    d = (s.withColumn("to_size", F.lead("_size_category").over(w))
         .withColumn("to_acc", F.lead("accuracy").over(w))
         .filter(F.col("to_size").isNotNull())
         .withColumnRenamed("_size_category", "from_size").withColumnRenamed("accuracy", "from_acc"))
    drop = F.when(F.col("from_acc") > 0, (F.col("from_acc") - F.col("to_acc")) / F.col("from_acc")) \
        .otherwise(F.lit(0.0))
    return d.withColumn("drop", drop).withColumn("significant", F.col("drop") > threshold)


def thresholds(df: DataFrame) -> DataFrame:
    """Largest cell count seen in small and in medium tables."""
    return df.agg(F.max(F.when(F.col("_size_category") == "small", F.col("_table_cells"))).alias("small_max_cells"),
                  F.max(F.when(F.col("_size_category") == "medium", F.col("_table_cells"))).alias("medium_max_cells"))


def advice(df: DataFrame, metric: str = METRIC) -> DataFrame:
    """Compare the last present size with the first: < 50%, < 80%, else stable."""
    s = size_means(df, metric)
    first_last = s.agg(F.min_by("accuracy", "size_rank").alias("first_acc"),
                       F.max_by("accuracy", "size_rank").alias("last_acc"))
    ratio = F.when(F.col("first_acc") > 0, F.col("last_acc") / F.col("first_acc"))
    # fixed values: advice texts
    return first_last.select(
        F.when(ratio < 0.5, F.lit("severe degradation on large tables: route large tables to SQL tools"))
        .when(ratio < 0.8, F.lit("moderate degradation: use a hybrid strategy for larger tables"))
        .otherwise(F.lit("stable across sizes: direct prompting is fine")).alias("advice"),
        "first_acc", "last_acc")


def severe_tasks(df: DataFrame, metric: str = METRIC) -> DataFrame:
    """Tasks whose large-table mean is below half of their small-table mean."""
    p = (df.filter(F.col("_size_category").isin("small", "large")).groupBy("task")
         .agg(F.avg(F.when(F.col("_size_category") == "small", F.col(metric))).alias("small_accuracy"),
              F.avg(F.when(F.col("_size_category") == "large", F.col(metric))).alias("large_accuracy")))
    return p.filter(F.col("small_accuracy").isNotNull() & F.col("large_accuracy").isNotNull()
                    & (F.col("large_accuracy") < 0.5 * F.col("small_accuracy")))


def failures(df: DataFrame, metric: str = METRIC) -> DataFrame:
    """Rows scored 0, counted per task.

    A conditional count rather than a filter: a filter on a score column would
    be pushed below the scoring projections and re-inline them.
    """
    g = df.groupBy("task").agg(F.count_if(F.col(metric) == 0).alias("n_failed"))
    return g.filter(F.col("n_failed") > 0)


def compare_models(df: DataFrame, metric: str = METRIC) -> DataFrame:
    """Mean per (model, size) plus an ``overall`` row per model (grouping sets)."""
    g = df.rollup("model_name", "_size_category").agg(F.avg(metric).alias("accuracy"),
                                                      F.count(F.lit(1)).alias("n"),
                                                      F.grouping("_size_category").alias("_g"),
                                                      F.grouping("model_name").alias("_gm"))
    return (g.filter(F.col("_gm") == 0)
            .withColumn("_size_category", F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.col("_size_category")))
            .drop("_g", "_gm"))
