"""The opN_<name> queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablefold.llm import ann, html_extract, mixing, ngram_join, packing, pii, quality, repair, rollup, simhash, span_dedup, spelling, token_files
from tablefold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary: the tokenizer file and the same as byte ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op1_skip_chain_pii")
def q_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@register("op2_ngram_jaccard_join")
def q_ngram_join(spark, sf_dir):
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


@register("op3_cost_balanced_packing")
def q_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary())


@register("op4_simhash_fingerprints")
def q_simhash(spark, sf_dir):
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@register("op5_repeated_span_removal")
def q_spans(spark, sf_dir):
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op6_template_extraction")
def q_html(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op7_token_rollup", rollup.oracle_sql())
def q_rollup(spark, sf_dir):
    return rollup.maintained(table(spark, sf_dir, "documents"))


@register("op8_nbsvm_quality")
def q_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_pivotal_mixing")
def q_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op10_embedding_graph")
def q_embeddings(spark, sf_dir):
    return ann.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op11_arrow_token_files")
def q_token_files(spark, sf_dir):
    import public_tokenizers
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op12_spelling_variants")
def q_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair")
def q_repair(spark, sf_dir):
    return repair.repaired(table(spark, sf_dir, "conversations"))
