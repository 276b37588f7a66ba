"""The report set (S17, O1): summary, by task, by size, task by size and by group, from one scan of the scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators.metrics import GROUP_KEYS, size_rank

KEYS = ["task", "_size_category", *GROUP_KEYS]
#: Report: the keys that it is grouped and ordered by.
REPORTS = {"summary": [], "by_task": ["task"], "by_size": ["_size_category"], "task_by_size": ["task", "_size_category"], "by_group": ["task", *GROUP_KEYS]}


def report_set(scored: DataFrame, metric: str = "effective_correct") -> DataFrame:
    """One row for each group of each report: (report, position, keys, count, accuracy, total, cells).

    All reports are grouping sets of one aggregate, so that the scored rows are read once and partial sums combine
    map-side. Groups with a NULL key are left out, as are sizes outside the three bands. ``position`` numbers a report's
    groups in the order of its keys (sizes from small to large); rows come in the order of the reports.
    """
    bits = {name: sum(1 << len(KEYS) - 1 - i for i, k in enumerate(KEYS) if k not in keys) for name, keys in REPORTS.items()}
    g = scored.groupingSets([[F.col(k) for k in keys] for keys in REPORTS.values()], *KEYS).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("count"), F.avg(metric).alias("accuracy"), F.sum(metric).alias("total"),
        F.avg("_table_cells").alias("avg_cells"), F.min("_table_cells").alias("min_cells"), F.max("_table_cells").alias("max_cells"))
    name = F.element_at(F.create_map(*[x for n, b in bits.items() for x in (F.lit(b).cast("bigint"), F.lit(n))]), F.col("_id"))
    place = F.element_at(F.create_map(*[x for i, b in enumerate(bits.values()) for x in (F.lit(b).cast("bigint"), F.lit(i))]), F.col("_id"))
    whole = F.lit(True)
    for i, k in enumerate(KEYS):
        grouped = F.col("_id").bitwiseAND(F.lit(1 << len(KEYS) - 1 - i)) == 0
        whole = whole & (~grouped | (size_rank(F.col(k)).isNotNull() if k == "_size_category" else F.col(k).isNotNull()))
    g = g.where(whole).select(name.alias("report"), place.alias("_place"), size_rank(F.col("_size_category")).alias("_rank"), "*")
    order = ["task", "_rank", *GROUP_KEYS]
    g = g.withColumn("position", F.row_number().over(Window.partitionBy("report").orderBy(*order)))      # groups, not rows
    return g.orderBy("_place", "position").select("report", "position", F.col("task"), F.col("_size_category").alias("size_category"), *GROUP_KEYS,
                                                  "count", "accuracy", "total", "avg_cells", "min_cells", "max_cells")


def write_report_set(reports: DataFrame, folder: str, fmt: str = "json") -> None:
    """One folder for each report under ``folder``, a single ordered file each, with the keys that the report has.

    The reports are groups, not rows, and come from one plan: they are written once, partitioned by report.
    """
    writer = reports.repartition(1).sortWithinPartitions("report", "position").write.mode("overwrite").partitionBy("report")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(folder)
