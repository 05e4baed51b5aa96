"""A corpus pipeline of the llm operators: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm.common import Scratch, read_table
from lumenweave.llm.decontaminate import drop_leaks
from lumenweave.llm.jaccard_join import keep_one_of_each
from lumenweave.llm.language_id import identify, train_on
from lumenweave.llm.packing import pack
from lumenweave.llm.secret_scan import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, or without text, go.

    A null ``lang`` teaches nothing, and its document is judged like any other. Very long texts are read whole; of equal scores the first language by
    name is taken; repeated rows go or stay together, null ids stay. An empty table gives an empty one; all columns pass through.
    """
    found = identify(docs, train_on(docs), prefix="__lw_")
    return found.filter("__lw_lang_pred <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by 0.8 of their five-word shingles: the smallest id.

    Texts without words, and rows with a null id, link with nothing and stay; of repeated ids the row of the smallest text stays. A pair just at 0.8
    links. Very long texts are compared whole. An empty table gives an empty one; all columns pass through.
    """
    return keep_one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item's words in common runs.

    Null and empty texts and null ids stay; just a half is a leak; repeated rows go or stay together. Very long texts are tiled whole. An empty table,
    or an empty benchmark, changes nothing; all columns pass through.
    """
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark.

    Null and empty texts stay as they are; spans that overlap become one mark; ``n_chars`` follows changed texts. Repeated rows, null ids and other
    columns pass through; very long texts are scanned whole; an empty table gives an empty one.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096, for every row, null or empty texts included: those are an end token alone.

    Very long texts are many pieces; null ids and repeated rows are packed like any other; an empty table gives an empty result.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
