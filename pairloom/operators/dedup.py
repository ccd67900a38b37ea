"""Duplicate removal by content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.session import durable


def keep_first(df: DataFrame, key: Column, row_id: str = "pair_id") -> DataFrame:
    """Keep the row with the smallest id of every key.

    Only (key, min id) is aggregated, and that is combined before the shuffle, so
    one key with a third of all rows costs no more than any other.  The texts then
    move once, in a semi join on the unique id.  A window per key would sort the
    whole hot group in one task.  A row with a null key is no duplicate of any other
    and stays.
    """
    alone = F.when(F.col("_key").isNull(), F.col(row_id)).alias("_alone")
    kept = (df.select(key.alias("_key"), F.col(row_id))
            .groupBy("_key", alone).agg(F.min(row_id).alias(row_id)).select(row_id))
    return df.join(kept, row_id, "left_semi")


def duplicate_groups(df: DataFrame, key: Column, row_id: str = "pair_id") -> DataFrame:
    """Members of every group of two or more equal rows, one row per member.

    The group is given in long form (fingerprint, first id, copies, member id):
    an id list per group would have to fit into one row of one task.  The groups are
    stored first: only if both sides of the join are shuffled anew for it can adaptive
    execution split a hot key.  Rows with a null key have no duplicates.
    """
    rows = df.select(key.alias("fingerprint"), F.col(row_id))
    groups = (rows.groupBy("fingerprint")
              .agg(F.count("*").alias("copies"), F.min(row_id).alias("first_id"))
              .where(F.col("copies") > 1))
    return rows.join(durable(groups), "fingerprint")


#: Bits of the fixed-size filter: its table has FILTER_BITS / 64 rows at most.
FILTER_BITS = 1 << 22


def _filter_of(keys: DataFrame) -> DataFrame:
    """(word, bits): which slots the keys' hashes take; at most 65,536 rows at any size."""
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    return (keys.select(F.floor(slot / 64).cast("int").alias("_word"), bit.alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose fingerprint may be among the keys; a bounded table is broadcast."""
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(FILTER_BITS))
    taken = F.call_function("shiftrightunsigned", F.col("_bits"), F.pmod(slot, F.lit(64)).cast("int"))
    return (rows.withColumn("_word", F.floor(slot / 64).cast("int"))
            .join(F.broadcast(_filter_of(keys)), "_word").where(taken.bitwiseAND(F.lit(1).cast("long")) == 1)
            .drop("_word", "_bits"))


def split_leaks(train: DataFrame, test: DataFrame, key: Column, row_id: str = "pair_id") -> DataFrame:
    """(split, row_id, fingerprint) of the rows whose key stands in both tables.

    Every copy is reported, on either side; a null key matches nothing.  Each side first
    drops the rows that a bitmap of the other side's keys rules out, of fixed size and inside
    the scan; what is left takes the exact semi join against the other side's distinct keys,
    which adaptive execution splits at a hot key.  A full bitmap lets more rows through and
    loses none.
    """
    sides = [df.select(key.alias("fingerprint"), F.col(row_id)).where(F.col("fingerprint").isNotNull()) for df in (train, test)]
    maybe = [durable(_maybe_in(rows, other)) for rows, other in (sides, sides[::-1])]
    found = [rows.join(other.select("fingerprint").distinct(), "fingerprint", "left_semi")
             .select(F.lit(name).alias("split"), row_id, "fingerprint")
             for name, rows, other in (("train", *maybe), ("test", *maybe[::-1]))]
    return found[0].unionByName(found[1])
