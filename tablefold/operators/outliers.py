"""Outliers of a column (D8): far from the median in deviations, or of a rare text shape.

Quantiles are exact and need no sort: Spark's mergeable sketch (``percentile_approx``) brackets the
wanted rank, one aggregate counts what lies below the bracket, and the next sketch looks into the bracket
only, until few distinct values are left, which are counted one by one. Every pass is a scan with a
partial aggregate; the driver sees a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000             # of a sketch: ranks within n / ACCURACY
FEW = 20_000                  # values of a bracket that are counted one by one


def exact_quantile(df: DataFrame, x: Column, q: float) -> float | None:
    """The value at rank ceil(q * n) of the non-NULL, non-NaN values of ``x`` (the lower one between two)."""
    v = df.select(x.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    n, lo, hi = v.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = max(1, -int(-q * n // 1))
    below = 0                                                # values under the bracket
    while True:
        inside = v.where(F.col("x").between(lo, hi))
        here = inside.count() if below or n > FEW else n
        if here <= FEW or lo == hi:
            break
        step = 2 / ACCURACY
        share = (rank - below) / here
        new_lo, new_hi = inside.agg(F.percentile_approx("x", [max(0.0, share - step), min(1.0, share + step)], ACCURACY)).first()[0]
        if (new_lo, new_hi) == (lo, hi):
            break
        under, upto = v.agg(F.count_if(F.col("x") < new_lo), F.count_if(F.col("x") <= new_hi)).first()
        if not under < rank <= upto:                         # the sketch's bound did not hold: keep the bracket
            break
        lo, hi, below = new_lo, new_hi, under
    if lo == hi:
        return lo
    for value, count in inside.groupBy("x").count().orderBy("x").toLocalIterator():
        below += count
        if below >= rank:
            return value
    return hi


def numeric_outliers(df: DataFrame, id_cols: list[str], col: str, cut: float = 3.5) -> DataFrame:
    """Rows whose robust z-score ``|x - median| / (1.4826 * MAD)`` is over ``cut``.

    (ids, value, median, deviation, z). MAD is the median distance from the median; where it is 0 (over half the values are
    equal) every other value is an outlier, with z NULL. NULL and NaN are no outliers here.
    """
    x = F.col(col).cast("double")
    median = exact_quantile(df, x, 0.5)
    if median is None:
        return df.select(*id_cols, x.alias("value"), x.alias("median"), x.alias("deviation"), x.alias("z")).where("false")
    mad = exact_quantile(df, F.abs(x - F.lit(median)), 0.5)
    far = F.abs(x - F.lit(median))
    z = far / F.lit(1.4826 * mad) if mad else F.lit(None).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & ((z > cut) if mad else (far > 0)))
    return rows.select(*id_cols, x.alias("value"), F.lit(median).alias("median"), F.lit(mad).alias("deviation"), z.alias("z"))


def shape(c: Column) -> Column:
    """A text's shape: runs of capitals, small letters and digits become A, a and 9; the rest stays."""
    s = F.regexp_replace(c, r"[0-9]+", "9")
    s = F.regexp_replace(s, r"\p{Lu}+", "A")
    return F.regexp_replace(s, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")


def pattern_outliers(df: DataFrame, id_cols: list[str], col: str, rare: float = 0.02, usual: float = 0.1) -> DataFrame:
    """Rows whose shape has less than ``rare`` of the column's values, if some shape has ``usual`` of them or more.

    (ids, value, shape, share, usual_shape): the usual shape is the most frequent one (ties by shape). Shapes are
    counted with partial sums; the total and the usual shape are one row that is joined back. NULL values are no outliers.
    """
    rows = df.select(*id_cols, F.col(col).cast("string").alias("value")).where("value IS NOT NULL").withColumn("shape", shape(F.col("value")))
    counts = rows.groupBy("shape").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "shape")).alias("top"))
    total, top, most = (whole.select(x) for x in ("total", "top.shape", (-F.col("top.m")).alias("most")))
    named = counts.select("shape", (F.col("n") / total.scalar()).alias("share"), top.scalar().alias("usual_shape"), (most.scalar() / total.scalar()).alias("top_share"))
    odd = named.where((F.col("share") < rare) & (F.col("top_share") >= usual)).drop("top_share")
    return rows.join(odd, "shape").select(*id_cols, "value", "shape", "share", "usual_shape")
