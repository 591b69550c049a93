"""The training-data pipeline: its stages in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm.decontam import decontaminated
from quaestor.llm.minhash import deduplicated
from quaestor.llm.packing import packed
from quaestor.llm.pii import redacted
from quaestor.llm.queries import table, vocabulary
from quaestor.llm.scratch import settled
from quaestor.llm.toxicity import accepted, held_out, learned


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model never sees the labels of the held-out third.

    Null and empty texts have no hits and stay; rows that share a doc_id are judged one by one; other columns stay as they are.
    """
    return accepted(docs, learned(docs, table(spark, sf_dir, "labels").filter(~held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group at similarity 0.8 of five-word shingles.

    Documents without words link with nothing; of equal rows of one doc_id one stays; rows without a doc_id stay unless a row with one stands for their group.
    """
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item; null and empty texts stay, rows that share a doc_id are judged one by one."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; null texts stay null."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a null text is its end id alone."""
    return packed(docs, tokenizer=vocabulary("word_bpe_49k.json"), units=200_000, block=1 << 20)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written and read again as the next one's documents; its scratch tables are deleted then."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = settled(spark, name, lambda d=docs, stage=stage: stage(spark, d, sf_dir))
    return last(spark, docs, sf_dir)


#: Scores, sketches and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
