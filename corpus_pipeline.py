"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes all that its predecessor kept and returns the columns of
``documents``, but for the last, which returns the pieces of the packing. A
stage's result is written to the shared folder and read again, so a lost executor
costs a part of one stage. Texts of any length are taken whole, ties are broken as each
operator's docstring says, columns beyond doc_id and text pass through whatever their names,
and an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, written
from tessera.llm.decontam import without_leaks
from tessera.llm.line_dedup import line_dedup
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack
from tessera.llm.queries import tokenizer_path
from tessera.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and empty texts are judged as empty; repeated rows and rows without an id each by their text."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; the documents stay, null texts null, those that lose every line empty."""
    return line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest doc_id; null and empty texts are one group."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark, or hold an item as a whole, go; null and empty texts stay, rows are judged each by its text."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 4,096 tokens; a null or empty text is its end id alone."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and tokenizers are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
