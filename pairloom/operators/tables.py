"""Filters, cleaning, keyed joins and set operations on pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import schema as S
from pairloom.functions import text as X


def fill_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.fill("", list(columns))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def short_negatives(df: DataFrame, limit: int = S.MAX_FUNCTION_CHARS) -> DataFrame:
    """Rows with target 0 and fewer than ``limit`` characters."""
    return df.where((F.col("target") == 0) & (F.char_length("func") < limit))


def drop_where_contains(flagged: DataFrame, text: str, needle: str, key: str,
                        *tables: DataFrame) -> list[DataFrame]:
    """Drop, from every table, the keys whose ``text`` contains ``needle``."""
    keys = flagged.where(F.contains(F.col(text), F.lit(needle))).select(key).distinct()
    return [t.join(keys, key, "left_anti") for t in tables]


def from_source(df: DataFrame, source: str, name: str = "name") -> DataFrame:
    """Rows whose name contains ``source``, with the second ``_`` field of the name."""
    return (df.where(F.contains(F.col(name), F.lit(source)))
            .withColumn("commit_id", F.try_element_at(F.split(name, "_"), F.lit(2))))


def sample_k(df: DataFrame, k: int, seed: str, key: str) -> DataFrame:
    """Uniform sample of k rows without replacement; same rows on every run.

    The top-k operator keeps k rows per task, so nothing is sorted as a whole.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(digest, key).limit(k)


def size_buckets(sizes: DataFrame, size: str, limits=S.SIZE_LIMITS) -> DataFrame:
    """Nested subsets: one flag per limit, true if ``size`` is below it."""
    return sizes.select("*", *[(F.col(size) < n).alias(f"below_{n}") for n in limits])


def apply_filter(df: DataFrame, select: Column) -> DataFrame:
    return df.where(select)


def first_of_group(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The row with the smallest ``order``, a unique column, of every group.

    An aggregate combined in each task, so a hot group is one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def exclude_rows(df: DataFrame, excluded: DataFrame, key: str = "pair_id") -> DataFrame:
    """Anti-join on the key table.  Its size decides the join strategy at run time."""
    return df.join(excluded.select(key), key, "left_anti")


def join_predictions(pairs: DataFrame, predictions: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair; a pair without prediction keeps NULLs."""
    return pairs.join(predictions, key, "left")


def attach_locations(function: Column, locations: Column) -> Column:
    return F.concat(function, F.lit(S.END_OF_FUNCTION), F.coalesce(locations, F.lit("")))


def commit_to_cwe(patches: DataFrame, commits: DataFrame) -> DataFrame:
    """Distinct CWE ids of a set of commits; the last known id of a commit wins."""
    known = (patches.where(F.col("cwe") != "NA")
             .groupBy("commit_id").agg(F.max_by("cwe", "row_id").alias("cwe")))
    return known.join(commits.select("commit_id"), "commit_id", "left_semi").select("cwe").distinct()


def few_locations_short_function(df: DataFrame, max_lines: int = 20) -> DataFrame:
    """Fewer location lines than injection lines, in a function below ``max_lines``."""
    n = lambda c: F.size(X.lines(F.col(c)))
    return df.where((n("locations") < n("injections")) & (n("before") < max_lines))
