"""Format sweep (T12): the same cases as prompts in several table formats, few-shot counts and sample sizes, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators import serialize as Z
from tablefold.operators.prompts import fill
from tablefold.operators.sampling import smallest_hashes

# fixed values: the benchmark's grid
FORMATS = ("markdown", "csv", "html", "json")
SHOTS = (0, 3)
SAMPLES = (200, 1000)


def format_sweep(cells: DataFrame, cases: DataFrame, template: str, shot_template: str, formats=FORMATS, shots=SHOTS, samples=SAMPLES,
                 seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """(dataset, case_id, format, shots, samples, prompt): one prompt per chosen case and grid point.

    ``cases(dataset, case_id, question, answer)``; a case's table is its one table in ``cells``. Per data set the cases are taken in
    the order of a seeded hash (``hashed`` replaces it): the first of them are the samples, the smaller inside the larger, and the next ones are
    the shots, so that no case is an example of itself. ``samples`` lists the sample sizes that a case is part of: a
    prompt is written once, however many samples share it. ``{{{shots}}}`` in ``template`` takes the filled ``shot_template`` s, one a line.
    Only chosen cases' cells are serialised, once per format; a case without a table has a NULL prompt.
    """
    most, extra = max(samples), max(shots)
    wanted = cases.select("dataset").distinct().withColumn("want", F.lit(most + extra).cast("long"))
    order = F.xxhash64("case_id", F.lit(seed)) if hashed is None else hashed
    chosen = smallest_hashes(cases.withColumn("_order", order), ["dataset"], wanted, ["case_id"], seed, hashed=F.col("_order"))
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("_order", "case_id"))     # over most + extra rows
    chosen = chosen.withColumn("place", place).drop("_order")
    mine = cells.join(chosen.select("case_id"), "case_id", "left_semi")
    texts = reduce(DataFrame.unionByName, [Z.SERIALIZERS[f](mine).select("case_id", F.lit(f).alias("format"), F.col("text").alias("table")) for f in formats])
    grid = F.explode(F.array(*[F.lit(f) for f in formats])).alias("format")
    rows = chosen.select("*", grid).join(texts, ["case_id", "format"], "left")
    filled = lambda t, **more: fill(t, {"table": F.col("table"), "question": F.col("question"), "answer": F.col("answer"), **more})
    example = F.when(F.col("place") > most, F.struct("place", F.when(F.col("table").isNotNull(), filled(shot_template)).alias("text")))
    # every row of a data set and format sees its few shots; the window holds most + extra rows
    examples = F.array_sort(F.collect_list(example).over(Window.partitionBy("dataset", "format")))
    rows = rows.withColumn("_shots", F.filter(F.transform(examples, lambda x: x["text"]), lambda t: t.isNotNull())).where(F.col("place") <= most)
    inside = F.filter(F.array(*[F.lit(n) for n in sorted(samples)]), lambda n: n >= F.col("place"))
    rows = rows.withColumn("samples", inside).withColumn("shots", F.explode(F.array(*[F.lit(k) for k in shots])))
    prompt = F.when(F.col("table").isNotNull(), filled(template, shots=F.array_join(F.slice("_shots", 1, F.col("shots")), "\n")))
    return rows.select("dataset", "case_id", "format", "shots", "samples", prompt.alias("prompt"))
