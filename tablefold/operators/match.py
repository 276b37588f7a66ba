"""Matching operators.

No operator emits all pairs of a group: duplicates are reported as clusters
(``min(id)`` per normalized key) and value overlaps are computed from
distinct values joined on the value itself, whose fan-out is bounded by the
number of columns, not by how often a value repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.operators.discover import name_suffix


def _long_distinct(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return df.select(items.alias("i")).select(F.col("i.col").alias(tag), "i.value") \
        .filter(F.col("value").isNotNull()).distinct()


# D5 ------------------------------------------------------------------------
def schema_match(left: DataFrame, right: DataFrame, threshold: float = 0.5, name_weight: float = 0.5) -> DataFrame:
    """Best target column per source column by name similarity and value overlap.

    name_sim = 1 - levenshtein(suffixes) / max length; overlap = Jaccard of the
    distinct value sets; score = weighted sum. Best target by score, then name;
    NULL target below ``threshold``.
    """
    lv = _long_distinct(left, left.columns, "source")
    rv = _long_distinct(right, right.columns, "target")
    inter = lv.join(rv, "value").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_common"))
    ln = lv.groupBy("source").agg(F.count(F.lit(1)).alias("n_s"))
    rn = rv.groupBy("target").agg(F.count(F.lit(1)).alias("n_t"))
    spark = left.sparkSession
    # every (source, target) name pair: |left columns| x |right columns| metadata rows, built on the driver
    names = spark.createDataFrame([(a, name_suffix(a), b, name_suffix(b)) for a in left.columns for b in right.columns],
                                  "source string, s_sfx string, target string, t_sfx string")
    m = names.join(inter, ["source", "target"], "left").join(ln, "source", "left").join(rn, "target", "left")
    common = F.coalesce(F.col("n_common"), F.lit(0))
    jac = F.coalesce(F.try_divide(common, F.col("n_s") + F.col("n_t") - common), F.lit(0.0))
    name_sim = 1 - F.levenshtein("s_sfx", "t_sfx") / F.greatest(F.length("s_sfx"), F.length("t_sfx"))
    m = m.withColumn("score", (name_weight * name_sim + (1 - name_weight) * jac).cast("double")) \
        .withColumn("jaccard", jac.cast("double"))
    w = Window.partitionBy("source").orderBy(F.col("score").desc(), F.col("target"))
    best = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return best.select("source", F.when(F.col("score") >= threshold, F.col("target")).alias("target"),
                       "score", "jaccard")


# D6 ------------------------------------------------------------------------
def normalize_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def entity_clusters(df: DataFrame, id_col: str, block: list[str], attrs: list[str]) -> DataFrame:
    """Records with equal normalized attributes inside a block share a cluster id
    (the smallest id). Pairs are implied by equal cluster ids; none is materialized."""
    keyed = df.select(id_col, *block, *[normalize_text(F.col(a).cast("string")).alias(f"_n{i}")
                                        for i, a in enumerate(attrs)])
    kcols = ["_key"]                     # NULL attributes are equal to each other
    keyed = keyed.withColumn("_key", F.to_json(F.struct(*block, *[f"_n{i}" for i in range(len(attrs))])))
    cl = keyed.groupBy(*kcols).agg(F.min(id_col).alias("cluster_id"), F.count(F.lit(1)).alias("cluster_size"))
    return keyed.join(cl, kcols).select(id_col, "cluster_id", "cluster_size",
                                        (F.col("cluster_size") > 1).alias("is_duplicate"))


# D7 ------------------------------------------------------------------------
def match_key(c: Column) -> Column:
    """Normalized join key: lower case letters and digits of any script; NULL (joins nothing) if there are none."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.lit(""))


def value_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str, normalized: bool = True) -> DataFrame:
    """Distinct value pairs of two columns that are equal (or equal after normalizing)."""
    lv = left.select(F.col(lcol).cast("string").alias("left")).distinct()
    rv = right.select(F.col(rcol).cast("string").alias("right")).distinct()
    kf = match_key if normalized else (lambda c: c)
    return lv.withColumn("_k", kf(F.col("left"))).join(rv.withColumn("_k", kf(F.col("right"))), "_k") \
        .select("left", "right")


# D10 -----------------------------------------------------------------------
def locate_cells(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries(case_id, [table_name,] row_idx, col_name)`` -> the cell value (inner join on the cell key)."""
    on = [c for c in ("case_id", "table_name", "row_idx", "col_name") if c in queries.columns]
    return queries.join(cells.select(*on, "value"), on)


# D11 -----------------------------------------------------------------------
def unique_cells(cells: DataFrame) -> DataFrame:
    """Cells whose value occurs exactly once in their table (needle candidates).

    One aggregate, which keeps a cell next to each count: cells that lie by table already are not moved again.
    """
    keys = ["case_id", "table_name", "value"]
    known = cells.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    one = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("row_idx", "col_idx", "col_name")).alias("_c")).where("_n = 1")
    return one.select("case_id", "table_name", "_c.row_idx", "_c.col_idx", "_c.col_name", "value")


# D12 -----------------------------------------------------------------------
def needle_positions(cells: DataFrame, step: int = 5) -> DataFrame:
    """One needle position per (row bin, column bin) of every table -- the first cell of
    the bin (smallest row, then column). A ``min`` over structs: combined map-side, no sort."""
    g = cells.groupBy("case_id", "table_name", F.floor(F.col("row_idx") / step).cast("int").alias("row_bin"),
                      F.floor(F.col("col_idx") / step).cast("int").alias("col_bin")).agg(
        F.min(F.struct("row_idx", "col_idx", "col_name", "value")).alias("c"))
    return g.select("case_id", "table_name", "row_bin", "col_bin", "c.row_idx", "c.col_idx", "c.col_name", "c.value")


def place_needle(cells: DataFrame, needles: DataFrame) -> DataFrame:
    """Turn each table's rows and columns, both as a ring, until its needle stands where it shall.

    ``needles(case_id, table_name, from_row, from_col, to_row, to_col)`` has one row a table; places are taken modulo the table's shape.
    Columns keep their names. Tables without a needle stay as they are. The shape is a window over the table's own cells, which
    are partitioned by table already.
    """
    w = Window.partitionBy("case_id", "table_name")
    shaped = cells.withColumn("_rows", F.max("row_idx").over(w) + 1).withColumn("_cols", F.max("col_idx").over(w) + 1)
    turned = lambda at, a, b, n: F.pmod(F.col(at) + F.coalesce(F.col(b) - F.col(a), F.lit(0)), F.col(n)).cast("int").alias(at)
    return shaped.join(needles, ["case_id", "table_name"], "left").select(
        "case_id", "table_name", turned("row_idx", "from_row", "to_row", "_rows"), turned("col_idx", "from_col", "to_col", "_cols"), "col_name", "value")
