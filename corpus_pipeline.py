"""From raw documents to a weighted mix, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next reads
it. All but the last return the columns of `documents`; the last returns what the mix takes of each.

Defined cases, for every stage: null columns are kept as they are, and a null text counts as empty; extra
columns, whatever their names, pass through unchanged (the last stage leaves them out); repeated rows are
treated alike; an empty table gives an empty one with the same columns. What each stage does with
empty texts and ties is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from orrery.llm.common import kept, table

#: Near duplicates of the pipeline: five-word shingles, similarity of 0.8.
NEAR_WORDS, NEAR = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their band go, null and empty texts among them."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats, within one edit, go, and documents that lose their last line
    with a word. Texts without lines stay; earlier means the smaller doc_id (null last), then the text's
    hash, then the place."""
    return line_dedup.dedup(docs)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id, null last, ties by
    the text's hash; of equal rows one. Documents without words are in no class and stay."""
    return jaccard_join.keep_one(docs, NEAR_WORDS, True, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null or empty items match nothing, null or empty
    texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: none of a null or empty text. A null source is a
    source of its own, ordered last."""
    return mixing.allot(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard join", jaccard_join_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: Tokenizer figures, edit distances and classes of links are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
