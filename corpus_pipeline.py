"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Nulls, ties and odd rows are as the operators define them: documents without words fail the quality rules; rows without an
id pass the stage of near copies; rows that repeat id and text become one there; further columns go through all stages. The
last adds ``copy``. An empty table gives no rows.
"""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bendscape.llm import decontamination, mixing, near_copies, pii, quality_rules
from bendscape.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of policy v2, by a ledger that is written first."""
    return quality_rules.kept(docs, quality_rules.V2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of four fifths of five-word shingles make, by SimHash."""
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which five words in a hundred or more stand in benchmark windows."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exchanges private values for pseudonyms; n_chars follows the text.

    The key is ``spark.bendscape.pii.key``; where that is unset, one of this run that nobody keeps.
    """
    key = spark.conf.get("spark.bendscape.pii.key", None) or secrets.token_hex(32)
    return pii.pseudonymise(docs, key, counts=None).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents as often as the mix of sources takes them, with the number of each copy."""
    return mixing.emit(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("pseudonyms", pseudonyms),
    ("mixed", mixed),
]

#: SQL cannot express the groups of the second stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; stages are written to a new folder in the shared one."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
