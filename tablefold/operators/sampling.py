"""Sampling (M1-M6): seeded, reproducible, and safe for hot groups.

Per-group top-n by hash uses two rounds: first the n smallest hashes per
(group, salt bucket) -- so a group holding a third of all rows is split over
``salts`` tasks -- then the n smallest of the at most ``n * salts``
survivors per group. Nothing is capped: every group keeps exactly
``min(n, size)`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 64


def _h(cols: list[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def _top_n_by_hash(df: DataFrame, by: list[str], n: Column | int, id_cols: list[str], seed: int,
                   salts: int = DEFAULT_SALTS) -> DataFrame:
    n = F.lit(n) if isinstance(n, int) else n
    d = df.withColumn("_h", _h(id_cols, seed)).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    w1 = Window.partitionBy(*by, "_salt").orderBy("_h", *id_cols)
    d = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy(*by).orderBy("_h", *id_cols)
    d = d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n)
    return d.drop("_h", "_salt", "_r1", "_r")


def sample_n(df: DataFrame, by: list[str], n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """M1: ``n`` rows per group (e.g. 25 per dataset), seeded."""
    return _top_n_by_hash(df, by, n, id_cols, seed)


def smallest_hashes(df: DataFrame, by: list[str], wanted: DataFrame, id_cols: list[str], seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """Per group the rows of smallest hash, as many as ``wanted(by..., want)`` says; groups it doesn't name are left out.

    A histogram of hash buckets per group (partial sums) tells the bucket in which the last row lies: rows of lower buckets are
    taken as they are, and only that bucket's rows (a 16,384th of a group) are ranked. No window spans a group.
    ``hashed`` replaces the seeded hash of the ids by a 64-bit number of the caller's.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by])
    rows = df.withColumn("_h", _h(id_cols, seed) if hashed is None else hashed).withColumn("_b", F.shiftright("_h", 50))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
    cuts = counts.withColumn("_before", before).alias("c").join(wanted.alias("w"), named).where("_before < want")
    edge = cuts.groupBy(*[F.col(f"c.{c}").alias(c) for c in by]).agg(F.max_by(F.struct(F.col("_b").alias("edge"), (F.col("want") - F.col("_before")).alias("left")), "_b").alias("_e"))
    near = rows.alias("r").join(edge.alias("e"), on & (F.col("r._b") <= F.col("e._e.edge"))).select("r.*", "_e")
    taken = near.where("_b < _e.edge").drop("_e")
    last = near.where("_b = _e.edge").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *id_cols))).where("_r <= _e.left")
    return taken.unionByName(last.drop("_r", "_e")).drop("_h", "_b")


def balance(df: DataFrame, label: str, id_cols: list[str], seed: int = 42, cap: int | None = None,
            hashed: Column | None = None) -> DataFrame:
    """M2 (M4 with ``cap``): every class down-sampled to the minority size (and to ``cap``), the smallest seeded hashes of each.

    The minority size is an aggregate inside the plan; no job runs here. A NULL label is a class. Rows that repeat an id share its hash.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    least = counts.agg(F.min("_c").alias("_m"))
    want = least.scalar() if cap is None else F.least(least.scalar(), F.lit(cap))
    return smallest_hashes(df, [label], counts.select(label, want.alias("want")), id_cols, seed, hashed)


def balance_two(df: DataFrame, label: str, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """M4: exactly two classes required; min(minority, n // 2) each, ordered by label. The check runs with the plan, as an assertion on its rows."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).agg(F.count("*").alias("_k"))
    checked = F.when(F.assert_true(classes.scalar() == 2, F.lit("balance_two needs exactly 2 classes")).isNull(), F.col("_one"))
    rows = balance(df, label, id_cols, seed, cap=n // 2).withColumn("_one", F.lit(1))
    return rows.where(checked == 1).drop("_one").orderBy(label, *id_cols)


def cap(df: DataFrame, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """M3: at most ``n`` rows, the ``n`` smallest seeded hashes (a top-k, no global sort)."""
    return df.withColumn("_h", _h(id_cols, seed)).orderBy("_h", *id_cols).limit(n).drop("_h")


def shuffle(df: DataFrame, id_cols: list[str], seed: int = 42) -> DataFrame:
    """M5: a seeded work order (a range-partitioned sort)."""
    return df.withColumn("_h", _h(id_cols, seed)).orderBy("_h", *id_cols).drop("_h")


def sample_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """M6: the first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)
