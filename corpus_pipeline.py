"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet in the shared folder and reads it again as the next stage's documents.

All stages but the last return the columns of their documents, whatever their names; they use doc_id and
text (the first also lang). An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import bpe, decontaminate, langid, linededup, simhash
from heddle.llm.common import read_table
from heddle.runtime import new_path, removed, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those without text or letters, or below the calibrated score, go.

    Repeated rows share their fate. A null key or language teaches nothing, and its row is judged like any other.
    """
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; n_chars, where there is one, follows the text. Documents whose lines were all deleted go.

    Null and empty texts stay as they are. A null key counts as 0. Rows that repeat key and text are one
    document and stay alike; of different texts under one key that with the smaller hash comes first.
    """
    return linededup.keep_left(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Null and empty texts are one group. A null key comes after all others; of rows that share key and
    text one stays, and of different texts under one key in a group that with the smaller hash.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts stay; repeated rows share their fate."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document left. A null text has no ids; repeated rows give repeated results."""
    return bpe.encode_documents(docs, ["doc_id"])


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can express neither the trained classifier of the first stage nor what depends on it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. The last stage's table stays; the others go, after a failure too."""
    folder = new_path(spark, "corpus-pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    try:
        for i, (name, stage) in enumerate(STAGES):
            out = f"{folder}/{i}-{name}"
            docs = written(stage(spark, docs, sf_dir), out)
            if before:
                removed(spark, before)
            before = out
    except BaseException:
        removed(spark, folder)
        raise
    return docs
