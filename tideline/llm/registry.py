"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import sql
from .harmonic import pack
from .mixing import sample_table
from .near_dedup import classes
from .quality_classifier import classify
from .quality_rules import verdicts
from .substring_anchors import dedup as dedup_words
from .suffix_dedup import dedup as dedup_bytes
from .token_prefix import count_tokens
from .url_filter import Rule, judge
from .vector_files import top_k


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return classes(_docs(spark, sf), similar=0.8, size=5)


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return sample_table(_docs(spark, sf))


#: The rules of the URL query.
URL_RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def op3_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)


def op4_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_docs(spark, sf), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, with_ids=False)


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(_docs(spark, sf), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(_docs(spark, sf))


def op8_fixed_block_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_words(_docs(spark, sf), size=13, with_text=False)


def op9_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_bytes(_docs(spark, sf), need=400, passage=240, with_text=False)


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return classify(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), threshold=0.7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for n, f in globals().items() if n.startswith("op") and callable(f)]
    ops = {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
    return ops | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    given = sql.oracle_sql(URL_RULES)
    return given | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
