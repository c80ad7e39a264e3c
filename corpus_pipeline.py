"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

All stages keep null and empty texts, rows with a null id and any further columns (the last returns pieces instead), decide alike on repeated
rows, and give no rows for an empty table; what more holds for one is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch, table
from stationlens.llm.decontaminate import remove_leaks
from stationlens.llm.jaccard import one_of_each
from stationlens.llm.packing import pack
from stationlens.llm.pii import replace_entities
from stationlens.llm.queries import pii_key
from stationlens.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic; an empty text is scored as a text without words."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity of 0.8 or more.

    Texts without words are alike to nothing and stay. Of rows with one id one stays; rows with a null id stay.
    """
    return one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; a benchmark without items takes none away."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the new text."""
    replaced = replace_entities(docs, pii_key(spark))
    return replaced.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 1024 tokens; an empty text is its end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: Neither the network nor the tokenizer can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each reading what its predecessor wrote to the shared folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{name}")
            if k:
                scratch.drop(f"stage-{STAGES[k - 1][0]}")
    return docs
