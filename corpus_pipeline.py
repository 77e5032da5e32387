"""Corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm import exact_dedup, mixing, near_dedup, packing, quality
from panelscope.llm.common import Workspace, table
from panelscope.llm.queries import tokenizer_path


def _columns(docs: DataFrame, of: DataFrame) -> DataFrame:
    return docs.select(*of.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.accept(docs, model), docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies stays, that with the largest id."""
    return _columns(exact_dedup.drop_exact_copies(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return _columns(near_dedup.keep_one_of_each(docs), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce sources are repeated, up to mixing.MAX_REPEATS times; each stays once at least.

    Each part of the output is in the order of the mixture, which packing reads it in.
    """
    named = mixing.added(docs)
    return _columns(mixing.mix(docs).sortWithinPartitions(*(named[c] for c in ("epoch", "block_place", "doc_place"))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models, sketches and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
