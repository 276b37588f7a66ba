"""Token budget and corpus statistics (K1-K7).

K1 counts tokens with a regex piece rule that runs JVM-side (no tokenizer
vocabulary needed): a run of ASCII letters/digits is one token, every other
non-blank character is one token. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"
DEFAULT_LIMIT = 64_000
CLI_LIMIT = 128_000
HIST_BIN = 10_000
HIST_BINS = 13


def token_count(text: Column) -> Column:
    """K1: DOUBLE token count of the whole text, however long."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("double")


def split_budget(df: DataFrame, limit: int = DEFAULT_LIMIT, col: str = "token_count") -> DataFrame:
    """K2: ``valid = token_count <= limit``."""
    return df.withColumn("valid", F.col(col) <= F.lit(float(limit)))


def budget_report(df: DataFrame, by: str = "dataset") -> DataFrame:
    """K3: valid / invalid counts and valid rate per dataset plus a TOTAL row (rollup)."""
    g = df.rollup(by).agg(F.count_if(F.col("valid")).alias("valid"),
                          F.count_if(~F.col("valid")).alias("invalid"),
                          F.grouping(by).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias(by),
                    "valid", "invalid",
                    F.try_divide(F.col("valid"), F.col("valid") + F.col("invalid")).alias("valid_rate"))


def token_histogram(df: DataFrame, col: str = "token_count", width: int = HIST_BIN, bins: int = HIST_BINS,
                    by: str | None = None) -> DataFrame:
    """K4: counts in ``bins`` bins of ``width`` tokens, the last one open (ledger L24)."""
    b = F.least(F.floor(F.col(col) / width), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    aggs = [F.count_if(b == i).alias(f"bin_{i}") for i in range(bins)]
    return df.groupBy(*keys).agg(*aggs)


def smallest_prompt(df: DataFrame, by: str = "dataset", id_col: str = "case_id") -> DataFrame:
    """K5: the smallest prompt per dataset (ties by id).

    A ``min`` over a struct keyed (token_count, id) is a partial/final
    aggregate: no per-dataset sort, so a dataset holding most rows does not
    land in one task.
    """
    m = df.groupBy(by).agg(F.min(F.struct(F.col("token_count"), F.col(id_col), F.col("prompt"))).alias("m"))
    return m.select(by, F.col("m.token_count").alias("token_count"), F.col(f"m.{id_col}").alias(id_col),
                    F.col("m.prompt").alias("prompt"))


def token_totals(df: DataFrame, by: str = "dataset") -> DataFrame:
    """K6: total tokens (millions) and mean tokens per file, plus an overall row."""
    g = df.rollup(by).agg((F.sum("token_count") / 1e6).alias("total_m"), F.avg("token_count").alias("mean"),
                          F.count(F.lit(1)).alias("n"), F.grouping(by).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias(by),
                    "total_m", "mean", "n")


def model_usage(scored: DataFrame, keys: list[str] = ["model_name", "task"], shares: list[float] = [0.5, 0.95]) -> DataFrame:
    """K7: prompt and completion tokens per model and task: totals, means and the exact percentiles ``shares``; mean and longest time.

    ``percentile`` counts equal values: its state is bounded by the longest answer in tokens, not by the rows.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for kind in ("prompt", "completion"):
        c = f"{kind}_tokens"
        aggs += [F.sum(c).alias(c), F.avg(c).alias(f"{kind}_mean"), *[F.percentile(c, p).alias(f"{kind}_p{round(p * 100)}") for p in shares]]
    return scored.groupBy(*keys).agg(*aggs, F.avg("time_taken").alias("avg_time"), F.max("time_taken").alias("max_time"))
