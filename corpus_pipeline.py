"""The corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return the columns
of ``documents``; what a stage rejects is gone, and masked text is what the next stage reads.

Defined cases: rows are judged as rows, so null and repeated ids are kept apart; a null or empty text has too few words
for the first stage and goes; an empty table gives an empty result; extra columns are carried to the last stage, which
returns pieces. Ties are decided as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import near_dedup, packing, pii, quality, toxicity
from tesserae.llm.common import checkpointed, table
from tesserae.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or that the weighed votes call bad go."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Expectation-maximisation, trained models and integer programs are not SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is cut off through the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
