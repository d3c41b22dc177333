"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.llm.columns import WHITE
from lagmill.llm.jaccard import keep_first
from lagmill.llm.langid import identify, train
from lagmill.llm.lines import dedup_lines
from lagmill.llm.packing import pack_documents
from lagmill.llm.queries import WORD_BPE
from lagmill.llm.substrings import remove_repeats
from lagmill.session import scratch_folder


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns of ``docs``; ``n_chars`` follows the text."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language stays uncertain; the model learns from the labels of ``docs``."""
    return identify(docs, train(docs)).where(~F.col("lang_rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier line equals or is near to, and documents of which no more than white space is left.

    Texts without letters go in the first stage, so a blank text had words, and each of its lines equals or is near to an
    earlier one: it is a copy that the near-copy stage would keep, as a text without words is nobody's copy. Null texts stay."""
    kept = _as_documents(dedup_lines(docs), docs)
    return kept.where(F.col("text").isNull() | (F.trim("text", F.lit(WHITE)) != ""))


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    return keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops passages of 13 words and more that also stand in an earlier document; documents stay."""
    return _as_documents(remove_repeats(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return pack_documents(docs, WORD_BPE)


STAGES = [("language", language), ("lines", lines), ("near_documents", near_documents), ("substrings", substrings), ("packing", packing)]
#: SQL expresses none of a learned classifier, a tokenizer and online packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
