"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, packing.

Every stage takes a table with doc_id, text, lang, source and any other columns, whatever
these are called, and all but the last return the same columns in the same order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stressframe.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from stressframe.llm.common import delete_folder, shared_dir, table, tables_dropped
from stressframe.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rule on length and go; a null language is held against the
    nearest reference, one of few texts against none; texts of any length are measured whole;
    repeated rows stay or go together; an empty table stays empty.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Texts without a word (null, empty, white space) are in no group and stay, and so do rows
    with a null doc_id; of rows that repeat a doc_id one stays; an empty table stays empty.
    """
    return near_dedup.keep(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand anywhere else too; n_chars, where there is one, is set anew.

    Every row stays, with an empty text where all is removed; null and empty texts, and texts
    shorter than the passages, stay as they are; rows that repeat a long enough text lose it;
    very long texts are cut like any other; an empty table stays empty.
    """
    return substring_dedup.remove(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them, each at least once.

    Null sources are one source; null and empty texts count one token; repeated rows are rows
    each; ties of the permutation go by doc_id; an empty table stays empty.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the training sequences.

    Null and empty texts give one piece of the end token; texts over the capacity give
    several; repeated rows, as the mix makes them, are packed each; an empty table gives none.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("source mixing", mixture),
    ("packing", packed),
]

#: Alignment, radix sort and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again.

    The tables of a stage go when its result is written, and a result when the next one is;
    the last one goes with the application.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with tables_dropped():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_folder(spark, f"{folder}/{i - 1}")
    delete_folder(spark, folder, at_exit=True)
    return docs
