"""Corpus pipeline: quality, line dedup, near-duplicate documents, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet to the shared checkpoint folder and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``.  Every stage is one operator of
``lexaria.llm`` applied to all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaria.llm import lines, mixing, quality, simhash
from lexaria.llm.common import read_table, store
from lexaria.llm.queries import packed_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote predicts to be good; labels of held-out rows are not used."""
    names = docs.columns
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"), out="_quality")
    return judged.where("_quality.predicted = 1").select(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line occurrence per component of near-equal lines; documents left without any line go."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one that names it (repeated rows: one of them)."""
    return simhash.one_per_component(docs, shingle=3, max_distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence, place and token ids (unsigned 32-bit, little-endian)."""
    return packed_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# A trained classifier, MinHash and SimHash have no exact SQL statement; tests/llm/test_pipeline.py
# holds the stages of a whole run against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
