"""From raw documents to packed training sequences, in five stages.

1. quality_rules  documents that the rules or the classifier reject go
2. line_dedup     repeated lines go, except in the smallest id that holds them
3. near_dedup     one document of each class of near duplicates stays
4. mix_sources    the sources are mixed to their target weights
5. packing        the texts are tokenised and packed into windows

Each stage takes all its predecessor kept.  ``run`` writes a stage's result as
Parquet below the shared folder and rereads it as the next one's documents, so a
lost executor costs tasks of the current stage only.  All but the last stage
return the columns of ``documents``; the last returns a row per packed piece.
An empty table passes through all stages as such; what a stage makes of nulls,
ties and repeated rows is said in its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleet_health.llm.common import stored, table
from fleet_health.llm.line_dedup import drop_repeated_lines
from fleet_health.llm.minhash import first_of_each_class
from fleet_health.llm.mixing import mixed_documents
from fleet_health.llm.packing import pack_documents
from fleet_health.llm.quality_rules import good_documents
from fleet_health.session import configure

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("packing", packing)]

# trained models, signatures and token ids are beyond SQL; tests/llm holds the
# stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
