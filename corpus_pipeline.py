"""The corpus pipeline: language ID, near-duplicate join, passage dedup, mixing and tokens, each stage over all that its predecessor kept.

Defined results: a document without text, or in whose text no language is found (blank, or no word of letters), is rejected by the first
stage; a null language, source or id is no ground. Of rows of equal id and text one stays. Of a passage that repeats the first place stays; a
document of which only white space is left goes. A null source is a source of its own. Of a scarce source documents come up to EPOCHS times.
Ties go to the least id, then the least text. Very long texts are read whole. Columns of documents pass through up to the last stage, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm.bpe import bpe_encode
from quarrylens.llm.jaccard import drop_near_duplicates
from quarrylens.llm.langid import identify, train_pieces
from quarrylens.llm.mixing import EPOCHS, mix_sources, temperature_weights
from quarrylens.llm.passages import dedup
from quarrylens.llm.textblock import col
from quarrylens.runtime import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    return identify(docs, train_pieces(docs)).where("lid_ok").select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like ones."""
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one keeps."""
    return dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of scarce sources repeated towards the target weights, shard by shard, each shard shuffled."""
    return mix_sources(docs, temperature_weights(docs, nulls=True), epochs=EPOCHS).where("mix_place >= 0").select(*[col(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to."""
    return bpe_encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
