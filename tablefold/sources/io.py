"""Prompt, request, response, detail and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefold.functions import extract as X

RESPONSE_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("metadata", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
    T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
    T.StructField("time_taken", T.DoubleType()), T.StructField("model_name", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("_size_category", T.StringType()), T.StructField("_table_rows", T.LongType()),
    T.StructField("_table_cols", T.LongType()), T.StructField("_table_cells", T.LongType()),
])


# S11 / S18 -----------------------------------------------------------------
def write_prompts(prompts: DataFrame, path: str) -> None:
    """Prompt JSONL, valid and over-budget prompts in separate ``valid=`` folders."""
    prompts.write.mode("overwrite").partitionBy("valid").json(path)


def save_jsonl(df: DataFrame, path: str) -> None:
    """S18."""
    df.write.mode("overwrite").json(path)


# S12 -----------------------------------------------------------------------
def batch_requests(prompts: DataFrame, model: str, id_col: str = "case_id") -> DataFrame:
    """One chat-completion batch request per prompt (custom_id, method, url, body)."""
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    return prompts.select(F.col(id_col).cast("string").alias("custom_id"), F.lit("POST").alias("method"),
                          F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def write_batch(prompts: DataFrame, path: str, model: str, id_col: str = "case_id") -> None:
    batch_requests(prompts, model, id_col).write.mode("overwrite").json(path)


# S13 / S14 / S15 -----------------------------------------------------------
def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response JSONL of either shape (``response`` or ``choices[0].text``), with the
    dataset/model parsed from the file name and the task taken from metadata when absent."""
    df = spark.read.schema(RESPONSE_SCHEMA).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl?)?$", 1)
    parts = name_parts(name)
    return df.select(
        "*", parts["dataset"].alias("file_dataset"), parts["model"].alias("file_model"),
        F.coalesce(F.col("task"), X.metadata_field(F.col("metadata"), "task")).alias("task_resolved"),
        X.completion(F.col("response"), None).alias("_resp"))


def name_parts(name):
    """``<dataset>.<model>`` file stem -> dataset and model (a ``jsonl.`` prefix is dropped)."""
    stem = F.regexp_replace(name, r"^jsonl\.", "")
    has_dot = F.locate(".", stem) > 0
    return {"dataset": F.when(has_dot, F.substring_index(stem, ".", 1)).otherwise(stem),
            "model": F.when(has_dot, F.regexp_extract(stem, r"^[^.]*\.(.*)$", 1)).otherwise(F.lit("unknown"))}


def result_name(model: str, strategy: str | None = None) -> str:
    """Result folder name from a model name ('/' and '_' become '-'), with a strategy suffix."""
    base = model.replace("/", "-").replace("_", "-")
    return f"{base}-{strategy}" if strategy else base


# S16 / S17 -----------------------------------------------------------------
def write_details(scored: DataFrame, path: str) -> None:
    """Per-row details as JSONL and CSV (arrays and structs as JSON text in the CSV)."""
    scored.write.mode("overwrite").json(path + "/jsonl")
    flat = scored.select(*[F.to_json(F.col(f.name)).alias(f.name)
                           if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
                           for f in scored.schema.fields])
    flat.write.mode("overwrite").option("header", True).csv(path + "/csv")


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Small aggregate reports, one file each (coalesce(1) is safe: a report is a few rows)."""
    for name, df in reports.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
