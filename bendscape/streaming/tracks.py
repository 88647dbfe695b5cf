"""Curvature and scores of sequences as their files arrive.

Every step from a FASTA record to a track is stateless (pieces, chunks and kernels look at one record), so a stream needs
no watermark or state; each micro-batch writes the rows of the records that it read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bendscape.operators import curvature, pieces, symmetry
from bendscape.params import DEFAULT, Params


def fasta_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """(seq_id, seq) of the records of FASTA files that appear in a folder."""
    text = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    t = F.regexp_replace("value", "^>", "")
    body = F.regexp_replace(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return text.where(F.trim(t) != "").select(F.regexp_extract(t, r"^(\S*)", 1).alias("seq_id"), body.alias("seq"))


def curvature_stream(sequences: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(seq_id, piece, pos, curv_active, curv_simple) of a stream or table of sequences."""
    return curvature.curvature_dual(pieces.split_by_n(_known(sequences)), params)


def score_stream(sequences: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(seq_id, piece, pos, ..., score of each matrix) of a stream or table of sequences."""
    return symmetry.symmetry(pieces.split_by_n(_known(sequences)), params=params)


def _known(sequences: DataFrame) -> DataFrame:
    upper = F.translate("seq", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return sequences.select("seq_id", F.regexp_replace(upper, "[^ACGT]", "N").alias("seq"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to Parquet files, each input file once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
