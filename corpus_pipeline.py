"""Training-corpus pipeline: five stages from documents to shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept.  Stages hand over the columns of `documents`; the last returns the shards.
Between stages the rows are written to the shared folder and read back, so a lost
executor costs no earlier stage.

Defined results: null, blank and empty texts have fingerprint zero, so one of them
stays, and without words the mix takes none of it; rows with a null id are judged
like others, and of near copies the one with the smallest id stays; repeated rows
count as copies; long texts are read whole.  Without labels of both kinds nothing is
rejected, without a benchmark nothing leaks, and without documents there are no rows.
Other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontam, mixing, quality, sharding, simhash
from shelfwise.llm.tables import table
from shelfwise.settings import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 3-word shingles, at most 2 bits."""
    return simhash.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), short=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): repeated documents share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: Learned scores and iterative groups have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
