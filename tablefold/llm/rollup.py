"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes is a DataFrame of signed rows: an insert counts a document's tokens with sign +1, a
delete with -1, a revision is both (old counts out, new counts in). ``commit`` adds a batch up by
(source, lang, version), with partial sums in each task, writes the few resulting rows to a folder of the attempt
and publishes it by a row of the manifest. Totals are sums over the attempts that the manifest has last for each batch id, so
they are additive and never need the documents again, and a batch that is committed again after a failure changes nothing.
"""

from __future__ import annotations

import os
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.session import ensure_checkpoint_dir

KEYS = ["source", "lang", "version"]
#: Tokenizer versions: a pattern whose matches are tokens, the same in Java and RE2.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[a-z]+|[A-Z][a-z]*|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def n_tokens(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def changes(docs: DataFrame, sign: int, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """Signed rows (source, lang, version, docs, tokens), one for each document and version.

    A null text has no tokens; null sources and languages are groups of their own.
    """
    counts = F.array(*[F.struct(F.lit(v).alias("version"), (n_tokens(F.col("text"), p) * sign).alias("tokens")) for v, p in versions.items()])
    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.explode(counts).alias("c"))
    return rows.select("source", "lang", "c.version", F.lit(sign).cast("long").alias("docs"), "c.tokens")


def commit(spark: SparkSession, store: str, batch_id: str, *signed: DataFrame) -> None:
    """Add up a batch's signed rows and commit them under its id; the last commit of an id counts.

    The rows go to a folder of this attempt; one manifest row then publishes it. A crash before that leaves an earlier commit of
    the id as it was, and readers see one or the other, never neither.
    """
    rows = reduce(DataFrame.union, signed)
    rows = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    attempt = f"a-{uuid.uuid4().hex}"
    rows.write.parquet(os.path.join(store, "data", f"attempt={attempt}"))
    publish(spark, store, batch_id, attempt)


def publish(spark: SparkSession, store: str, batch_id: str, attempt: str) -> None:
    """One row in one file: Spark's commit renames it into place as a whole."""
    row = spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(attempt).alias("attempt"), F.lit(time.time_ns()).alias("at"))
    row.coalesce(1).write.mode("append").parquet(os.path.join(store, "manifest"))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, version, docs, tokens) over the batches that the manifest has; groups that no document is left in go."""
    manifest = spark.read.schema("batch_id string, attempt string, at long").parquet(os.path.join(store, "manifest"))
    valid = manifest.groupBy("batch_id").agg(F.max(F.struct("at", "attempt"))["attempt"].alias("attempt")).select("attempt")
    data = spark.read.schema("source string, lang string, version string, docs long, tokens long, attempt string").parquet(os.path.join(store, "data"))
    rows = data.join(valid, "attempt").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return rows.where("docs <> 0 OR tokens <> 0")


def new_store(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tablefold-llm", spark.sparkContext.applicationId, f"rollup-{uuid.uuid4().hex}")


def maintained(docs: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """Token counts of a corpus kept through three batches, the last of them committed twice.

    Batch 1 inserts every document; batch 2 deletes exact copies: of the rows of one text, those of the smallest doc_id stay (all of
    them if they repeat it; a null doc_id is the largest), whatever other texts have that doc_id; null texts are copies of the
    empty one. Batch 3 revises documents that hold e-mail addresses, which are taken out. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store = new_store(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    heads = rows.groupBy("h").agg(F.min("doc_id").alias("first")).withColumnRenamed("h", "head")
    first = (rows["h"] == heads["head"]) & rows["doc_id"].eqNullSafe(heads["first"])
    commit(spark, store, "1-insert", changes(rows, 1, versions))
    commit(spark, store, "2-delete", changes(rows.join(heads, first, "left_anti"), -1, versions))
    left = rows.join(heads, first, "left_semi").where(F.col("text").rlike(EMAIL))
    for _ in range(2):                                 # a replay
        commit(spark, store, "3-revise", changes(left, -1, versions), changes(left.withColumn("text", F.regexp_replace("text", EMAIL, "")), 1, versions))
    return totals(spark, store)


def oracle_sql(versions: dict[str, str] = VERSIONS) -> str:
    """The same totals in DuckDB, straight from the documents that are left."""
    counts = " UNION ALL ".join(
        f"SELECT source, lang, '{v}' AS version, len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM kept" for v, p in versions.items())
    return f"""
WITH heads AS (SELECT coalesce(text, '') AS t, min(doc_id) AS id FROM documents GROUP BY 1),
kept AS (SELECT source, lang, regexp_replace(coalesce(text, ''), '{EMAIL}', '', 'g') AS t FROM documents d
  WHERE EXISTS (SELECT 1 FROM heads WHERE heads.t = coalesce(d.text, '') AND heads.id IS NOT DISTINCT FROM d.doc_id)),
counted AS ({counts})
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY source, lang, version
"""
