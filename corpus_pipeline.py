"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``docs`` is a written table.
All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.harmonic import pack
from tideline.llm.mixing import sample
from tideline.llm.near_dedup import keep_one
from tideline.llm.quality_rules import keep_good
from tideline.llm.suffix_dedup import without_repeats
from tideline.storage import materialize, recorded, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: limits by language and source, from all of docs.

    Null texts and texts of fewer than 50 words go; null languages and sources are groups; repeated rows count each; no rows give none.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least id, and of equal ids the first in the table.

    Rows without an id come after all others; texts without words are one class; repeated rows are copies; no rows give none.
    """
    return keep_one(docs, similar=0.8, size=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes, about 50 short words, that stand more than once go from the texts, every copy of them; n_chars follows.

    A null text stays null, its n_chars too; an empty text stays; ids play no part; repeated rows lose what they share; no rows give none.
    """
    return without_repeats(docs, need=240).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target shares of sources, languages and genres; the corpus keeps about its size.

    A document may come more than once or not at all. Null sources and languages are values like others, null texts have no tokens; the
    id decides, so repeated rows are taken alike, and without one the text does; no rows give none.
    """
    return sample(docs, budget=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, each document with its closing id.

    A null text is empty and still has that id; ids may be null or repeated, each row is packed on its own; no rows give none.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, with_ids=False)


_left: list[str] = []


def _tidy(stage):
    """Removes what the stage before has left, once a stage gets its written result as docs."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for path in [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)]:
            remove(spark, path)
            _left.remove(path)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("near dedup", _tidy(near_dedup)),
    ("suffix-array dedup", _tidy(suffix_array_dedup)),
    ("mixing", _tidy(mixing)),
    ("packing", _tidy(packing)),
]

#: Signatures, suffix sorting and the tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
