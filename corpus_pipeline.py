"""The corpus pipeline: quality, near duplicates, benchmark overlap, packing. Stages run over the whole `documents` table,
each on what the stage before it kept; every result is written as Parquet and read again as the next stage's documents.

All but the last stage return the columns of `documents`; the last returns token pieces with their places. No stage is
expressible in SQL as a whole (hash fingerprints, a fitted model, tokenizer ids), so the rows are tested against
brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardstat.frames import materialize
from boardstat.llm import decontaminate, packing, quality, simhash
from boardstat.llm.queries import TOKENIZER, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality classifier", keep_good), ("near duplicates", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
