"""A training-data pipeline: quality rules, SimHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and all its predecessor kept, and returns the columns of ``documents``; the last returns
the packed pieces. ``run`` writes each stage as Parquet below spark.checkpoint.dir and reads it for the next.

Null texts: the quality rules reject them, as they do empty ones. Documents without an id are kept like others, and of repeated
rows, whatever their ids, one stays. Texts that share an id but no text are documents of their own. Ties go to the least id, then to
the least hash of the text. Empty tables give an empty result; extra columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkevid.llm import packing, quality_rules, simhash, suffix_dedup
from sparkevid.llm.runtime import table, written

#: Bytes of a repeated passage: about 35 words, so that a passage of 50 words is found whatever its words' lengths.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.kept_documents(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one row, that of the least id."""
    return simhash.dedup(docs, 5, (4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of PASSAGE that occur elsewhere too; a text that is left empty stays as an empty one."""
    return suffix_dedup.dedup_texts(docs, PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed),
]
#: The stages' methods have no SQL equivalent; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
