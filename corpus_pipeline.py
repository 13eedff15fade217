"""The corpus pipeline: documents without toxic ones, near copies and repeated passages, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrid.llm.bpe import default_tokenizer
from veilgrid.llm.common import Scratch
from veilgrid.llm.jaccard import keep_one
from veilgrid.llm.packing import pack_texts
from veilgrid.llm.suffixes import cut_repeats
from veilgrid.llm.toxicity import drop_toxic, held_out
from veilgrid.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; learnt from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    return drop_toxic(docs, labels.where(~held_out("doc_id")), "doc_id", "text", "toxic")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles."""
    return keep_one(docs, "doc_id", "text", k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier place has already."""
    return cut_repeats(docs, "doc_id", "text", "n_chars", words=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of what is left, in sequences of at most 4096."""
    return pack_texts(docs, "doc_id", "text", default_tokenizer(), 4096, 1).withColumnRenamed("key", "doc_id")


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("suffix_dedup", suffix_dedup), ("packing", packing)]
#: SQL can express neither the tokenizer nor the model; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder before the next reads them."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
