"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.session import durable

__all__ = ["durable", "read", "size_checked", "bitmap_of", "in_bitmap", "ascii_lower", "text_arrays"]

#: Slots of the fixed-size bitmaps that tasks get to skip rows without a partner.
BITMAP_SLOTS = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def size_checked(df: DataFrame) -> DataFrame:
    """Store a table that should be small, so that the planner knows its size.

    A join with the result is broadcast only below
    ``spark.sql.autoBroadcastJoinThreshold``; beyond it the planner shuffles both sides
    and splits hot keys at run time.
    """
    return durable(df)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def bitmap_of(df: DataFrame, key: str) -> np.ndarray:
    """Fixed-size bitmap of the low bits of a long key: a filter with false positives only.

    At most BITMAP_SLOTS / 64 words of 8 bytes (512 KB) come to the driver, whatever the
    number of keys.  A fuller bitmap lets more rows through and never loses one.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_SLOTS))
    words = (df.where(F.col(key).isNotNull())
             .select(F.shiftright(slot, 6).cast("int").alias("word"),
                     F.call_function("shiftleft", F.lit(1).cast("long"),
                                     F.pmod(slot, F.lit(64)).cast("int")).alias("mask"))
             .groupBy("word").agg(F.bit_or("mask").alias("mask")).collect())
    bits = np.zeros(BITMAP_SLOTS // 64, dtype=np.int64)
    for row in words:
        bits[row.word] = row.mask
    return bits.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be in the bitmap."""
    slot = keys.view(np.uint64) & np.uint64(BITMAP_SLOTS - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def text_arrays(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of arrays from one numpy array per row."""
    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    if lists:
        np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
