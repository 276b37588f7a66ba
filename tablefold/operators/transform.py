"""By-example column transform (D24) and header-to-column assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators.discover import TYPE_PATTERNS
from tablefold.operators.outliers import shape
from tablefold.session import materialize


def candidate_transforms(x: Column) -> list[tuple[str, Column]]:
    """A fixed family of text transforms, tried in this order (fixed values)."""
    c = [("identity", x), ("lower", F.lower(x)), ("upper", F.upper(x)), ("trim", F.trim(x)),
         ("initcap", F.initcap(x)), ("reverse", F.reverse(x)), ("length", F.length(x).cast("string"))]
    for sep in ["_", " ", "-", "#", ",", "."]:
        for i in (1, 2, -1):
            c.append((f"split[{sep}]{i}", F.split_part(x, F.lit(sep), F.lit(i))))
    for sep_from, sep_to in [("_", " "), (" ", "_"), ("-", " "), (" ", "")]:
        c.append((f"replace[{sep_from}->{sep_to}]", F.replace(x, F.lit(sep_from), F.lit(sep_to))))
    for k in (1, 2, 3):
        c.append((f"prefix{k}", F.substring(x, 1, k)))
        c.append((f"suffix{k}", F.substring(x, -k, k)))
    return c


def learn_transform(examples: DataFrame, src: str, dst: str) -> str | None:
    """Name of the first candidate that maps ``src`` to ``dst`` on every example row.

    All candidates are checked in one aggregate over the examples (one scan);
    only the winning name (a scalar) comes back to the driver.
    """
    cands = candidate_transforms(F.col(src).cast("string"))
    row = examples.agg(*[F.bool_and(F.coalesce(e == F.col(dst).cast("string"), F.lit(False))).alias(f"c{i}")
                         for i, (_, e) in enumerate(cands)]).first()
    for i, (name, _) in enumerate(cands):
        if row[f"c{i}"]:
            return name
    return None


def apply_transform(df: DataFrame, src: str, name: str | None, out: str = "output") -> DataFrame:
    """Apply the learnt transform (NULL output when none fitted)."""
    exprs = dict(candidate_transforms(F.col(src).cast("string")))
    return df.withColumn(out, exprs[name] if name else F.lit(None).cast("string"))


def assign_headers(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Give each unnamed column (cells by ``col_idx``) the header of the known column whose
    distinct values overlap it most (Jaccard), mutual best only; others get NULL.

    Distinct values are joined on the value, so the fan-out is bounded by the
    number of columns.
    """
    u = cells.select("case_id", "table_name", "col_idx", "value").distinct()
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("header"), F.col(c).cast("string").alias("value"))
                                for c in known.columns]))
    k = known.select(items.alias("i")).select("i.*").filter(F.col("value").isNotNull()).distinct()
    inter = u.join(k, "value").groupBy("case_id", "table_name", "col_idx", "header").agg(
        F.count(F.lit(1)).alias("n_common"))
    nu = u.groupBy("case_id", "table_name", "col_idx").agg(F.count(F.lit(1)).alias("n_u"))
    nk = k.groupBy("header").agg(F.count(F.lit(1)).alias("n_k"))
    s = inter.join(nu, ["case_id", "table_name", "col_idx"]).join(nk, "header").withColumn(
        "jaccard", (F.col("n_common") / (F.col("n_u") + F.col("n_k") - F.col("n_common"))).cast("double"))
    by_col = Window.partitionBy("case_id", "table_name", "col_idx").orderBy(F.col("jaccard").desc(), "header")
    by_hdr = Window.partitionBy("case_id", "table_name", "header").orderBy(F.col("jaccard").desc(), "col_idx")
    s = s.withColumn("_rc", F.row_number().over(by_col)).withColumn("_rh", F.row_number().over(by_hdr))
    best = s.filter((F.col("_rc") == 1) & (F.col("_rh") == 1)).select(
        "case_id", "table_name", "col_idx", "header", "jaccard")
    cols = cells.select("case_id", "table_name", "col_idx").distinct()
    return cols.join(best, ["case_id", "table_name", "col_idx"], "left")


WEIGHTS = {"overlap": 0.5, "shape": 0.3, "type": 0.2}


def _profiles(values: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``values(case_id, <name>, value)``: distinct values, shapes with their shares, and the most frequent type."""
    v = values.where("value IS NOT NULL").groupBy("case_id", name, "value").agg(F.count(F.lit(1)).alias("n"))
    trimmed = F.trim("value")
    kind = F.lit("text")
    for k, pattern in reversed(TYPE_PATTERNS.items()):
        kind = F.when(trimmed.rlike(pattern), k).otherwise(kind)
    v = v.select("*", shape(F.col("value")).alias("shape"), kind.alias("kind"))
    few = materialize(v.groupBy("case_id", name, "shape", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")))      # each value is judged once
    total = few.groupBy("case_id", name).agg(F.sum("n").alias("total"), F.sum("values").alias("n_distinct"))
    shapes = few.groupBy("case_id", name, "shape").agg(F.sum("n").alias("n")).join(total, ["case_id", name])
    kinds = few.groupBy("case_id", name, "kind").agg(F.sum("n").alias("n")).groupBy("case_id", name).agg(
        F.min(F.struct((-F.col("n")).alias("m"), "kind"))["kind"].alias("kind"))
    distinct = total.select("case_id", name, "n_distinct").join(kinds, ["case_id", name])
    return v.select("case_id", name, "value"), shapes.select("case_id", name, "shape", (F.col("n") / F.col("total")).alias("share")), distinct


def header_scores(unnamed: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, col_idx, header, overlap, shape, type, score) for every column and header of a case.

    ``unnamed(case_id, col_idx, value)``, ``known(case_id, header, value)``. overlap: Jaccard of the distinct values; shape: common
    mass of the shares of text shapes; type: 1 if the most frequent syntactic type is the same. Values and shapes are
    joined after aggregation, so that fan-out is bounded by the columns of a case.
    """
    uv, us, u = _profiles(unnamed, "col_idx")
    kv, ks, k = _profiles(known, "header")
    common = uv.join(kv, ["case_id", "value"]).groupBy("case_id", "col_idx", "header").agg(F.count(F.lit(1)).alias("c"))
    alike = us.join(ks.withColumnRenamed("share", "other"), ["case_id", "shape"]).groupBy("case_id", "col_idx", "header").agg(
        F.sum(F.least("share", "other")).alias("alike"))
    keys = ["case_id", "col_idx", "header"]
    pairs = (u.join(k.select("case_id", "header", F.col("n_distinct").alias("nk"), F.col("kind").alias("kk")), "case_id")
             .join(common, keys, "left").join(alike, keys, "left"))
    c = F.coalesce("c", F.lit(0))
    pairs = pairs.select(*keys, (c / (F.col("n_distinct") + F.col("nk") - c)).alias("overlap"), F.coalesce("alike", F.lit(0.0)).alias("shape"),
                         F.when(F.col("kind") == F.col("kk"), 1.0).otherwise(0.0).alias("type"))
    return pairs.withColumn("score", sum((F.col(x) * w for x, w in WEIGHTS.items()), F.lit(0.0)))


def match_headers(scores: DataFrame, min_score: float = 0.4) -> DataFrame:
    """One header for each column and one column for each header, by deferred acceptance.

    Both sides rank partners by the same score, so that a stable matching takes the best free pair again and again (scores
    to 9 digits; ties by column, then header). A case's pairs, at most columns times headers, are one
    array that is folded once. Columns left without a header of ``min_score`` get NULL.
    """
    pair = F.struct((-F.round("score", 9)).alias("m"), "col_idx", "header")
    g = scores.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.round("score", 9) >= min_score, pair))).alias("pairs"),
                                      F.array_sort(F.collect_set("col_idx")).alias("cols"))
    taken = F.aggregate("pairs", F.filter("pairs", lambda p: F.lit(False)), lambda acc, p: F.when(
        F.exists(acc, lambda t: (t["col_idx"] == p["col_idx"]) | (t["header"] == p["header"])), acc).otherwise(F.concat(acc, F.array(p))))
    rows = g.select("case_id", F.explode("cols").alias("col_idx"), taken.alias("taken"))
    hit = F.get(F.filter("taken", lambda t: t["col_idx"] == F.col("col_idx")), F.lit(0))
    return rows.select("case_id", "col_idx", hit["header"].alias("header"), (-hit["m"]).alias("score"))
