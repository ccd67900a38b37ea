"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pairloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def durable(df: DataFrame, stem: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Values that must not change when a lost task is run again (partition numbers
    of a sampled range partitioning, for one) are safe only after this.
    """
    spark = df.sparkSession
    path = scratch_path(spark, stem)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stored texts: no dictionary, which would pack repeated texts into next to nothing, a codec that
#: looks back over 64 KB only, and row groups far smaller than a split.
_TEXTS = {"compression": "snappy", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
_TEXTS_STEM = "pairloom-texts"


def store_texts(df: DataFrame) -> DataFrame:
    """``durable`` for whole texts: a split of the stored table holds a bounded share of them.

    A task that deals texts out holds all texts of its split until they are written.  Splits
    are cut by the bytes of the files, and how much text these bytes are depends on how the
    input was packed and on the columns made from it.
    """
    return durable(df, _TEXTS_STEM, **_TEXTS)


def stored_texts(df: DataFrame) -> DataFrame:
    """``df`` if it is read from tables of ``store_texts`` alone, else ``df`` stored that way."""
    files = df.inputFiles()
    if files and all(f"/{_TEXTS_STEM}-" in f for f in files):
        return df
    return store_texts(df)
