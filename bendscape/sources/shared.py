"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own folder where that is unset; a temporary one only where all run on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "bendscape")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder, so that its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` kept as a table in the shared folder: its columns are packed, which rows of a checkpoint are not."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that :func:`new_folder` has named, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def local_path(path: str) -> str:
    """The path of a file that is read or written by place, not only from its start to its end."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    if colon and rest.startswith("//"):
        raise ValueError(f"{path}: a folder is needed that the driver and all executors share and can write at any place")
    return path


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, the place of each row by ``order``, from 0.

    Rows are sorted by range and kept; only how many each range has goes to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    kept = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    before, sizes = 0, {}
    for part, n in sorted((r._part, r["count"]) for r in kept.groupBy("_part").count().collect()):
        sizes[part] = before
        before += n
    if not sizes:
        return kept.withColumn("number", F.col("_at")).drop("_part", "_at")
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in sizes.items() for x in pair]), F.col("_part").cast("long"))
    return kept.withColumn("number", F.col("_at") + first).drop("_part", "_at")
