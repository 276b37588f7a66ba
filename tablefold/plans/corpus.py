"""Token budget and sampling queries over ``documents`` as prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefold.operators import budget as K
from tablefold.operators import sampling as M
from tablefold.plans.base import R, register
from tablefold.session import spread
from tablefold.sources.tables import table

LIMIT = 2000  # budget used by the checks (the library default is 64,000)
TOKEN = K.TOKEN_PATTERN

F6_SQL = f"""
prompts AS (SELECT doc_id AS case_id, lang AS dataset, text AS prompt,
  CAST(len(regexp_extract_all(text, '{TOKEN}')) AS DOUBLE) AS token_count
  FROM documents),
budget AS (SELECT *, token_count <= {LIMIT} AS valid FROM prompts)
"""


def f6(body: str) -> str:
    return "WITH " + F6_SQL.strip() + "\n" + body


def prompts(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return d.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("dataset"), F.col("text").alias("prompt"),
                    K.token_count(F.col("text")).alias("token_count"))


@register("token_counts", f6("SELECT case_id, dataset, token_count FROM prompts"))
def q_token_counts(spark, sf_dir):
    return prompts(spark, sf_dir).select("case_id", "dataset", "token_count")


@register("budget_report", f6(f"""SELECT coalesce(dataset, 'TOTAL') AS dataset,
    count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid,
    round(CAST(count(*) FILTER (WHERE valid) AS DOUBLE) / count(*), {R}) AS valid_rate
    FROM budget GROUP BY ROLLUP (dataset)"""))
def q_budget_report(spark, sf_dir):
    b = K.budget_report(K.split_budget(prompts(spark, sf_dir), LIMIT))
    return b.select("dataset", "valid", "invalid", F.round("valid_rate", R).alias("valid_rate"))


@register("token_histogram", f6("SELECT dataset, " + ", ".join(
    f"count(*) FILTER (WHERE least(floor(token_count / 10000), 12) = {i}) AS bin_{i}" for i in range(13))
    + " FROM prompts GROUP BY dataset"))
def q_token_histogram(spark, sf_dir):
    return K.token_histogram(prompts(spark, sf_dir), by="dataset")


@register("smallest_prompt", f6("""SELECT dataset, token_count, case_id, prompt FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY token_count, case_id) AS r FROM prompts) WHERE r = 1"""))
def q_smallest_prompt(spark, sf_dir):
    return K.smallest_prompt(prompts(spark, sf_dir))


@register("token_totals", f6(f"""SELECT coalesce(dataset, 'TOTAL') AS dataset,
    round(sum(token_count) / 1e6, {R}) AS total_m, round(avg(token_count), {R}) AS mean, count(*) AS n
    FROM prompts GROUP BY ROLLUP (dataset)"""))
def q_token_totals(spark, sf_dir):
    t = K.token_totals(prompts(spark, sf_dir))
    return t.select("dataset", F.round("total_m", R).alias("total_m"), F.round("mean", R).alias("mean"), "n")


@register("sample_per_dataset", f6("""SELECT dataset, count(*) AS n_sampled, count(DISTINCT case_id) AS n_distinct
    FROM (SELECT dataset, case_id, least(25, count(*) OVER (PARTITION BY dataset)) AS k,
                 row_number() OVER (PARTITION BY dataset ORDER BY case_id) AS r FROM prompts) WHERE r <= k
    GROUP BY dataset"""))
def q_sample_per_dataset(spark, sf_dir):
    """M1: 25 per dataset, seeded; checked on counts (hash order differs between engines)."""
    s = M.sample_n(prompts(spark, sf_dir), ["dataset"], 25, ["case_id"], seed=42)
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_sampled"),
                                    F.count_distinct("case_id").alias("n_distinct"))


@register("balance_labels", """SELECT quality, least(count(*), (SELECT min(c) FROM (
    SELECT count(*) AS c FROM labels GROUP BY quality))) AS n FROM labels GROUP BY quality""")
def q_balance_labels(spark, sf_dir):
    """M2: classes down-sampled to the minority size (count check)."""
    b = M.balance(table(spark, sf_dir, "labels"), "quality", ["doc_id"], seed=42)
    return b.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@register("balance_labels_rows", """WITH j AS (SELECT doc_id, lang, quality, CAST('0x' || substr(md5(doc_id || ':42'), 1, 15) AS BIGINT) AS h
    FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY h, doc_id) AS r FROM j),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM j GROUP BY lang || quality))
SELECT doc_id, lang || quality AS class FROM r, m WHERE r <= m""")
def q_balance_rows(spark, sf_dir):
    """M2 by language and quality: which documents are kept (the smallest MD5 numbers of each class)."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("class", F.concat("lang", F.col("quality").cast("string")))
    number = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return M.balance(j.select("doc_id", "class"), "class", ["doc_id"], hashed=number).select("doc_id", "class")


@register("cap_documents", "SELECT least(100, count(*)) AS n, least(100, count(DISTINCT doc_id)) AS n_distinct "
                           "FROM documents")
def q_cap_documents(spark, sf_dir):
    """M3: at most 100 documents by seeded hash (count check)."""
    c = M.cap(table(spark, sf_dir, "documents").select("doc_id"), 100, ["doc_id"], seed=42)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"))
