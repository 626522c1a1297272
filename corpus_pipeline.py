"""Corpus pipeline: documents to token ids in five stages, each on all rows that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Null and empty texts, nulls in other columns and repeated rows
pass each stage by its operator's own rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm import linededup, mixing, pieces, quality, simhash
from treeframe.llm.common import Scratch, scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What the last stage over each input has written for itself: dropped as soon as the next one begins, since its result is written then.
_of_last: dict[str, Scratch] = {}


def _stage(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    """The operator's result with the columns of documents, and with n_chars that of the text as it is now."""
    if sf_dir in _of_last:
        _of_last.pop(sf_dir).close()
    with scratch(spark, keep=True) as own:
        _of_last[sf_dir] = own
        return operator()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _stage(spark, sf_dir, lambda: _documents(quality.filter_documents(docs.select(*COLUMNS))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, also of lines of one word; documents stay, also those that have lost all lines."""
    return _stage(spark, sf_dir, lambda: _documents(linededup.dedup_lines(docs.select(*COLUMNS))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: by the fingerprints of op2, or alike in four fifths of their 5-word shingles."""
    return _stage(spark, sf_dir, lambda: _documents(simhash.dedup_documents(docs.select(*COLUMNS), similarity=0.8)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix makes over a document, with the words it takes, in the order of the mix's slots."""
    return _stage(spark, sf_dir, lambda: _documents(mixing.mix_documents(docs.select(*COLUMNS))))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and whether they decode to its text."""

    def encoded() -> DataFrame:
        out = pieces.encode(docs.select(*COLUMNS), pieces.load())
        return out.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), F.col("_n_tokens").alias("n_tokens"), F.col("_decoded_ok").alias("round_trip"))

    return _stage(spark, sf_dir, encoded)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mix sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither SimHash components nor SentencePiece; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's result is dropped once the next one's is written; what the last stage reads stays
    until its rows are no longer wanted: run() inside scratch() to have that deleted too."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now = stored(docs)
            if before is not None:
                before.drop()
            docs, before = now.df, now
    return docs
