"""Corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents (doc_id, text, lang, source,
n_chars), and works on all rows that its predecessor kept. All but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.llm import common as C
from tablefold.llm import mixing, ngram_join, packing, pii, quality
from tablefold.llm.queries import vocabulary
from tablefold.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"),
                       F.col("source").cast("string"), F.col("n_chars").cast("long"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on ``labels``, scores under its threshold.

    Rows are judged one by one by their text, so that repeated rows share their fate; a null text is empty. Without labels of both
    classes nothing is learnt and every document stays. An empty table stays empty.
    """
    docs = _columns(docs)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model["weights"].any():
        return docs
    return quality.score(docs, model, keep=["lang", "source", "n_chars"]).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_id``, a hash of doc_id and text: rows that repeat a doc_id, or have none, are told apart by their texts."""
    return docs.withColumn("row_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every component of the shingle join: that of the smallest doc_id (null last), of these the smallest text hash.

    Rows are compared by their texts, whatever their ids: of rows equal in doc_id and text one stays, a text of its own stays beside
    a copy that has the same doc_id, and rows without a doc_id take part. Texts without words (null, empty, blank) are linked with
    nothing and all stay. An empty table stays empty.
    """
    docs = _named(_columns(docs))
    rows = C.written(ngram_join.near_classes(docs.select(F.col("row_id").alias("doc_id"), "text")), "pipeline-classes")
    rows = rows.where("n_shingles > 0").groupBy(F.col("doc_id").alias("row_id"), F.col("component_id").alias("component")).agg(F.count("*").alias("rows"))
    shared = rows.groupBy("component").agg(F.count("*").alias("texts")).where("texts > 1").select("component")
    members = C.written(rows.join(shared, "component").join(docs.select("row_id", "doc_id").distinct(), "row_id"), "pipeline-members")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))["row_id"].alias("best"))
    gone = members.join(best, "component").where("row_id <> best").select("row_id").distinct()
    equal = rows.where("rows > 1").select("row_id")
    kept = docs.join(gone.union(equal), "row_id", "left_anti")
    once = docs.join(equal.join(gone, "row_id", "left_anti"), "row_id", "left_semi").dropDuplicates(["row_id", "doc_id"])
    return kept.select(*COLUMNS).union(once.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind, overlapping ones by that of the longest; n_chars follows the text."""
    docs = _columns(docs)
    found = pii.find(docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("text").alias("body")), keep=["body", "lang", "source", "n_chars"])
    # overlapping spans are one interval, of the longest one's kind; ``at`` is how much of the body has been taken
    spans = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    part = lambda s, i: F.split(s, ":")[i]
    parts = F.array_sort(F.transform(spans, lambda s: F.struct(part(s, 1).cast("int").alias("s"), part(s, 2).cast("int").alias("e"), part(s, 0).alias("kind"))))
    mask = F.create_map(*[F.lit(x) for kv in MASK.items() for x in kv])
    state = lambda t, at, s, e, kind, size: F.struct(t.alias("t"), at.alias("at"), s.alias("s"), e.alias("e"), kind.alias("kind"), size.alias("size"))
    taken = lambda acc: F.when(acc["kind"].isNull(), acc["t"]).otherwise(F.concat(
        acc["t"], F.substring(F.col("body"), acc["at"] + 1, acc["s"] - acc["at"]), F.element_at(mask, acc["kind"])))
    step = lambda acc, p: F.when(p["s"] < acc["e"], state(
        acc["t"], acc["at"], acc["s"], F.greatest(acc["e"], p["e"]), F.when(p["e"] - p["s"] > acc["size"], p["kind"]).otherwise(acc["kind"]),
        F.greatest(acc["size"], p["e"] - p["s"]))).otherwise(state(taken(acc), acc["e"], p["s"], p["e"], p["kind"], p["e"] - p["s"]))
    zero = F.lit(0)
    text = F.aggregate(parts, state(F.lit(""), zero, zero, zero, F.lit(None).cast("string"), zero), step,
                       lambda acc: F.concat(taken(acc), F.substring(F.col("body"), acc["e"] + 1, F.length("body"))))
    return found.select("doc_id", F.when(F.col("spans") == "", F.col("body")).otherwise(text).alias("text"), "lang", "source", "n_chars").withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it. A document without words stays once.

    Rows are decided by doc_id and text; rows equal in both share the largest of their copies. An empty table stays empty.
    """
    docs = _named(_columns(docs))
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    taken = mixing.mix(docs.select(F.col("row_id").alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("row_id")).agg(F.max(copies).alias("copies"))
    return docs.join(taken, "row_id").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every copy into sequences (one row for each piece); a null text is its closing id alone, no rows give none."""
    return packing.pack(_columns(docs), *vocabulary())


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", mask_personal_data),
          ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None              # SQL expresses neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
