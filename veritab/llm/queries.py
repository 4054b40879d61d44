"""The operators applied to the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import (conversations, decontaminate, fingerprints, html_text, licenses, packing, pii, quality, simhash_dedup, suffix_dedup,
                         token_counts, toxicity, vector_codes)
from veritab.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query
def op1_toxicity(spark, root):
    return toxicity.score(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op2_quality_rules(spark, root):
    return quality.assess(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op3_license_scans(spark, root):
    return licenses.scan(table(spark, root, "documents"))


@query
def op4_suffix_array_dedup(spark, root):
    docs = table(spark, root, "documents")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs), suffix_dedup.shared_passages(docs))


@query
def op5_simhash_near_dedup(spark, root):
    return simhash_dedup.near_duplicates(table(spark, root, "documents"), shingle=3, radius=3)


@query
def op6_token_counts(spark, root):
    return token_counts.section_tokens(table(spark, root, "documents"))


@query
def op7_html_extraction(spark, root):
    return html_text.extract(table(spark, root, "pages"))


@query
def op8_benchmark_decontamination(spark, root):
    return decontaminate.matches(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query
def op9_pii(spark, root):
    return pii.scan(table(spark, root, "documents"))


@query
def op10_best_fit_packing(spark, root):
    return packing.pack(table(spark, root, "documents"))


@query
def op11_vector_code_compression(spark, root):
    return vector_codes.compress(table(spark, root, "embeddings"))


@query
def op12_conversation_repair(spark, root):
    return conversations.repair(table(spark, root, "conversations"))


@query
def op13_document_fingerprints(spark, root):
    return fingerprints.fingerprints(table(spark, root, "documents"))
