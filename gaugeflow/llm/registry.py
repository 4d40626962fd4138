"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    decontamination,
    licences,
    pagetext,
    pieces,
    prefixtrie,
    quality,
    recount,
    repeats,
    simhash,
    tokenfile,
    toxicity,
    vectorcodes,
)
from .tables import table, written


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every executor."""
    folder = os.environ.get("GAUGEFLOW_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(table(spark, folder, "documents"))


def op3_edit_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    trees = written(recount.build(table(spark, folder, "documents"), vocabulary(BYTE_BPE)), "token-trees")
    counts = recount.recount(recount.sample_edits(trees), vocabulary(BYTE_BPE))
    return counts.select("doc_id", "n_before", "n_after", "n_again")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.digests(tokenfile.write(table(spark, folder, "documents"), vocabulary(BYTE_BPE)))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=decontamination.LEAST
    )
    return found.drop("row")


def op8_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), vocabulary(PIECES))


def op9_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digest(spark, table(spark, folder, "conversations"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.digest(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.trie(table(spark, folder, "conversations"))


def op13_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pagetext.digest(table(spark, folder, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_edit_token_counts,
        op4_simhash,
        op5_license_scan,
        op6_token_files,
        op7_decontamination,
        op8_piece_codec,
        op9_quality_cascade,
        op10_chat_format,
        op11_vector_codes,
        op12_prefix_trie,
        op13_page_text,
    )
}
ORACLES = {
    "op5_license_scan": licences.oracle(),
    "op9_quality_cascade": quality.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_vector_codes": vectorcodes.oracle(),
    "op12_prefix_trie": prefixtrie.ORACLE,
}
