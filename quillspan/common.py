"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset it is an error on a cluster, whose
    executors would each write to a disk of their own; a session that is one local process makes a folder. Partitions
    and their order are kept, so ``spark_partition_id`` is stable on the result.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="quillspan-"))
    if not _has_folder(spark):
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_LOCAL: dict[str, str] = {}


def _has_folder(spark: SparkSession) -> bool:
    """Sessions on a server have the folder of its configuration."""
    return not hasattr(spark, "_sc") or spark.sparkContext.getCheckpointDir() is not None


def partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """The session's shuffle partitions, or more if ``rows`` would make them larger than ``rows_each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"(?U)^\s*$"), c)


def named(df: DataFrame, *needed: str) -> DataFrame:
    """Keep only the named columns; extra columns of any name cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
