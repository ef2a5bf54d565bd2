"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage is one operator of `fleetpulse.llm` and works on all rows its predecessor kept. Whole texts are read, of whatever length. All stages
but the last give the columns of their input, unchanged but for texts that lose passages (and `n_chars`, which follows the text);
columns of other names pass through, also where an operator uses the same name inside. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm.decontamination import drop_contaminated
from fleetpulse.llm.jaccard_join import keep_one
from fleetpulse.llm.mixing import mix_sources
from fleetpulse.llm.queries import table
from fleetpulse.llm.substring_dedup import drop_repeats
from fleetpulse.llm.toxicity import drop_toxic
from fleetpulse.session import pinned


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Each row is judged by its own text, with or without an id, so equal texts stay or go together; a null text is judged as an empty one.
    """
    return drop_toxic(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 75 % of their five-word shingles.

    Texts without words (nulls, empty ones) are linked with nothing and stay. Rows that share an id stay or go together; rows without an id stay.
    """
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier document has.

    A null text stays null; a text that loses words becomes the words that stay, joined by a space, possibly none. Rows with one id
    do not take from one another, and rows without an id neither lose words nor take any.
    """
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each row is judged by its own text, so equal texts stay or go together; rows without a text or an id stay.
    """
    return drop_contaminated(docs, table(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their places in a mixture in which a source weighs the square root of its size.

    A null source is a source of its own; rows with equal ids count as documents each, in any order among themselves.
    """
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixture", mixture),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages one after the other; each result is written to the shared folder and read from there."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


ORACLE_SQL = None  # SQL cannot train the toxicity model

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {}
