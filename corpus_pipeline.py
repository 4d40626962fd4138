"""A training corpus from raw documents: stages, each over all that the one before it kept.

Every stage defines what it does with null, empty and very long texts, ties, repeated rows and
further columns; all but the last keep the rows and columns they do not decide on as they are. A
null text is clean, is a near-duplicate of other texts without words, has nothing to cut,
overlaps with no benchmark item, and has no pieces. Rows are told apart by place, so rows with
one doc_id are documents of their own; of a group of near-duplicates the smallest doc_id stays,
nulls last, of equal ones the first row. Long texts are read in blocks, never cut short. An
empty table of documents gives an empty corpus; without usable labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import decontamination, pieces, repeats, simhash, toxicity
from gaugeflow.llm.registry import PIECES, vocabulary
from gaugeflow.llm.tables import table, written

# Passages of over fifty words are longer than so many bytes, also if the words are short.
PASSAGE, PASSAGE_ANCHOR, PASSAGE_BLOCK = 200, 50, 50


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely of some severity than of none go."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: three-word shingles, three differing bits or fewer."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur anywhere else are cut out of the texts."""
    return repeats.cut(docs, PASSAGE, PASSAGE_ANCHOR, PASSAGE_BLOCK)


def reject_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), least=decontamination.LEAST)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces and their ids, which decode to the text."""
    return pieces.encode(docs, vocabulary(PIECES))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", reject_benchmark),
    ("pieces", encode_pieces),
]
# Hash bits, byte spans and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
