"""From raw documents to encoded training text: five stages over `documents`, each on all that the one before kept.

toxicity      documents that the scorer rejects go
near_copies   of documents linked by 5-word shingles with Jaccard similarity of 0.8 or more, one of each group stays
passages      a paragraph that stands elsewhere first is cut out of the text
mixing        documents in an order that holds the sources' target weights
pieces        each whole text as ids of a public model, with four sampled segmentations, and its place in the order of the mix
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm import jaccard_join, segmentations, stages, substring_dedup
from lumenlog.llm.mixing import in_order, places
from lumenlog.llm.queries import MIX
from lumenlog.llm.shared import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), stages.fifth_by_crc32())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs, n=5, num=8, den=10)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cleaned(docs, n=5, num=8, den=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_order(docs, MIX)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentations.encoded(places(docs), "piece_bpe_32k.model", k=4, place="place")


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("passages", passages), ("mixing", mixing), ("pieces", pieces)]
ORACLE_SQL = None  # scores, sampled segmentations and hashes are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
