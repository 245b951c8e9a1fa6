"""The corpus pipeline: quality, line dedup, near-dedup, mix and packing, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import lines, minhash, mixing, packing, quality
from tessera.llm.common import cut
from tessera.llm.queries import vocabulary

#: No SQL expresses the classifier, the sketches' candidates or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go."""
    return lines.deduplicated_lines(docs, least_words=lines.ALL)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return minhash.deduplicated(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", good_documents), ("line dedup", new_lines), ("near-dedup", one_of_each), ("source mix", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, f"stage{at}")
    return docs
