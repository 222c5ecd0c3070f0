"""From documents to packed training sequences: four stages, each over all that the one before kept.

1. language: documents whose language isn't told (no letter, or a mean probability under LEAST_LANGUAGE) go;
2. near_duplicates: one document of each group of near copies stays, that with the least doc_id;
3. decontamination: documents that hold a benchmark item go;
4. packing: what is left becomes windows of 4096 token ids, sources mixed in proportion.

The network of stage 1 learns from a bounded sample of the labelled texts that it also filters; labels decide nothing
else. Null texts have no language and go. All stages take repeated rows, ties, empty tables and extra columns as the
operators in quaver.llm state it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import decontamination, language_id, near_dedup, packing
from quaver.llm.common import durable, table

#: A text whose best language has a lower mean probability than this has no known language.
LEAST_LANGUAGE = 0.3
WORD_BPE = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, F.lit(False), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Networks, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
