"""Cleaning operators.

D8 finds spellings one edit away from a frequent value with a deletion
neighbourhood join: every distinct value emits itself and its one-character
deletions; two values within edit distance 1 always share such a key. The
join runs over distinct values only, and candidates are verified with
``levenshtein``. No length blocks, no all-pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablefold.session import spread


def _deletions(v: Column) -> Column:
    """The value itself and every one-character deletion of it."""
    n = F.length(v)
    dels = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, n)))
    return F.array_distinct(F.concat(F.array(v), F.when(n > 0, dels).otherwise(F.array().cast("array<string>"))))


# D8 ------------------------------------------------------------------------
def near_frequent_errors(df: DataFrame, id_col: str, col: str, ratio: float = 10.0) -> DataFrame:
    """Rows whose value is one edit away from a value at least ``ratio`` times as
    frequent; suggestion = the most frequent such value (ties by value)."""
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("v").isNotNull())
    keys = counts.select("v", "n", F.explode(_deletions(F.col("v"))).alias("k"))
    a = keys.select(F.col("v").alias("rare"), F.col("n").alias("rare_n"), "k")
    b = keys.select(F.col("v").alias("freq"), F.col("n").alias("freq_n"), "k")
    cand = a.join(b, "k").filter((F.col("rare") != F.col("freq")) & (F.col("freq_n") >= ratio * F.col("rare_n"))) \
        .select("rare", "freq", "freq_n").distinct().filter(F.levenshtein("rare", "freq") <= 1)
    w = Window.partitionBy("rare").orderBy(F.col("freq_n").desc(), F.col("freq"))
    best = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1) \
        .select(F.col("rare").alias(col), F.col("freq").alias("suggestion"))
    return df.select(id_col, col).join(best, col)


# D9 ------------------------------------------------------------------------
def impute_mode(df: DataFrame, id_col: str, col: str, by: list[str], missing: Column | None = None) -> DataFrame:
    """Missing cells get the mode of their group (ties by smaller value), else the column mode."""
    miss = missing if missing is not None else (F.col(col).isNull() | (F.trim(F.col(col)) == ""))
    known = df.filter(~miss)
    g = known.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col(col))
    mode = g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(*by, F.col(col).alias("_mode"))
    overall = known.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), F.col(col)).limit(1) \
        .select(F.col(col).alias("_global")).first()
    glob = overall[0] if overall else None
    rows = df.filter(miss).select(id_col, *by)
    return rows.join(mode, by, "left").select(id_col, *by, F.coalesce(F.col("_mode"), F.lit(glob)).alias("imputed"))


def impute_lookup(df: DataFrame, id_col: str, col: str, determinants: list[str], numeric: bool = False,
                  min_confidence: float = 0.6, min_support: int = 2) -> DataFrame:
    """Missing cells filled from lookup tables learnt on the other rows, best determinant first.

    (id, imputed, source). A determinant's lookup table maps each of its values to the most frequent value of ``col`` (ties by
    smaller value); its confidence is the share of known rows that the table gets right. A missing cell takes the
    entry of the most confident determinant (then of greater support, then in the order given) that has a value in the
    row, a confidence of ``min_confidence`` and an entry of ``min_support`` rows; where there is none, the column's
    mode, or its mean if ``numeric``. Missing: NULL or blank. All tables come from one aggregate over (determinant, value, target).
    """
    text = F.col(col).cast("string")
    miss = text.isNull() | (F.trim(text) == "")
    known = df.where(~miss)

    def items(rows: DataFrame, *keep: Column) -> DataFrame:
        x = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(d).alias("det"), F.col(d).cast("string").alias("a")) for i, d in enumerate(determinants)]))
        return rows.select(*keep, x.alias("x")).select("*", "x.*").drop("x").where("a IS NOT NULL")

    counts = items(known, text.alias("y")).groupBy("det", "a", "y").agg(F.count(F.lit(1)).alias("n"))
    entry = counts.groupBy("det", "a").agg(F.min(F.struct((-F.col("n")).alias("m"), "y")).alias("top"), F.sum("n").alias("total"))
    entry = entry.select("det", "a", F.col("top.y").alias("y"), (-F.col("top.m")).alias("support"), "total")
    trust = entry.groupBy("det").agg((F.sum("support") / F.sum("total")).alias("confidence"))
    rows = df.where(miss)
    asked = items(rows, F.col(id_col)).join(entry.where(F.col("support") >= min_support), ["det", "a"]).join(trust.where(F.col("confidence") >= min_confidence), "det")
    best = asked.groupBy(id_col).agg(F.max(F.struct("confidence", "support", (-F.col("o")).alias("o"), "y", "det")).alias("b"))
    if numeric:
        rest = known.agg(F.avg(F.col(col).cast("double")).cast("string").alias("v"))
    else:
        mode = known.groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        rest = mode.agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("t")).select("t.v")
    out = rows.select(id_col).join(best, id_col, "left")
    return out.select(id_col, F.coalesce("b.y", rest.scalar()).alias("imputed"), F.coalesce("b.det", F.lit("mean" if numeric else "mode")).alias("source"))


# D25 -----------------------------------------------------------------------
# fixed values: patterns of the sensitive-data gate (portable between Java regex and RE2)
SENSITIVE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(^|[^0-9])\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -]?[0-9]{4}([^0-9]|$)",
    "ipv4": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)",
    "card": r"(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)",
}


def sensitive_flags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One flag per pattern and the yes/no gate answer."""
    df = spread(df.select(id_col, text_col))
    flags = {k: F.col(text_col).rlike(p) for k, p in SENSITIVE_PATTERNS.items()}
    anyf = F.lit(False)
    for f in flags.values():
        anyf = anyf | f
    return df.select(id_col, *[v.alias(f"has_{k}") for k, v in flags.items()],
                     F.when(anyf, "yes").otherwise("no").alias("flagged"))


# D27 -----------------------------------------------------------------------
def learn_mapping(examples: DataFrame, src: str, dst: str) -> DataFrame:
    """Value mapping from example pairs (most frequent target per source, ties by value)."""
    g = examples.groupBy(src, dst).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(src).orderBy(F.col("_n").desc(), F.col(dst))
    return g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(src, dst)


def apply_mapping(df: DataFrame, mapping: DataFrame, src: str, dst: str) -> DataFrame:
    """Map ``src`` through the learnt pairs; unseen values -> NULL (left join; AQE
    broadcasts the mapping when its runtime size is small)."""
    return df.join(mapping, src, "left").withColumnRenamed(dst, "mapped")
