"""A training corpus from raw documents: five stages, each written before the next reads it.

Toxic documents go; one document of each near-duplicate group stays; repeated passages
go; sources are mixed to their target weights; the result is packed into sequences.
Empty tables give empty results, and extra columns of any name pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfind.llm import mixing, packing, shingle_join, substring_dedup, toxicity
from wayfind.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; a null or empty text holds no evidence and is judged as such, repeated rows alike."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id; rows without words or without a doc_id stay."""
    return shingle_join.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier place has go; a document of which no word is left goes, a null or empty text stays."""
    return substring_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source is repeated; documents of a source drawn below its size may go, a null source is one source."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece; a null or empty text is one piece with the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express a trained classifier; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
