"""Rankings of lines and functions by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pairloom import schema as S
from pairloom.operators.scale import cut_position
from pairloom.session import durable


def rank_lines(df: DataFrame, row_id: str = "pair_id", score: str = "sc") -> DataFrame:
    """Add ``rank`` of each line inside its function, best score first."""
    inside = Window.partitionBy(row_id).orderBy(F.desc(score), F.asc("pos"))
    return df.withColumn("rank", F.row_number().over(inside))


def first_hits(df: DataFrame, row_id: str = "pair_id", score: str = "sc", truth: str = "y") -> DataFrame:
    """(row_id, first_hit): rank of the best true line, for functions that have one."""
    return (rank_lines(df, row_id, score).where(F.col(truth) == 1)
            .groupBy(row_id).agg(F.min("rank").alias("first_hit")))


def top_k_accuracy(df: DataFrame, ks=S.TOP_K, **columns) -> DataFrame:
    return first_hits(df, **columns).agg(
        *[F.avg((F.col("first_hit") <= k).cast("double")).alias(f"top_{k}") for k in ks])


def initial_false_alarm(df: DataFrame, **columns) -> DataFrame:
    """Mean number of clean lines read before the first true one."""
    return first_hits(df, **columns).agg(F.avg(F.col("first_hit") - 1).alias("ifa"))


def _line_order(row_id: str, score: str):
    return [F.desc(score), F.asc(row_id), F.asc("pos")]


def effort_at_recall(df: DataFrame, recall: float = 0.2, row_id: str = "pair_id",
                     score: str = "sc", truth: str = "y") -> DataFrame:
    """Share of all lines to read, best first, to find ``recall`` of the true ones."""
    cut = cut_position(df.select(row_id, "pos", score, truth), _line_order(row_id, score),
                       {"hits": F.col(truth)},
                       "hits", F.lit(recall) * F.col("hits_all"))
    return cut.select((F.col("position") / F.col("n_all")).alias("effort"))


def recall_at_effort(df: DataFrame, effort: float = 0.01, row_id: str = "pair_id",
                     score: str = "sc", truth: str = "y") -> DataFrame:
    """Share of the true lines among the first ``effort`` of all lines."""
    cut = cut_position(
        df.select(row_id, "pos", score, truth), _line_order(row_id, score), {"hits": F.col(truth), "lines": F.lit(1)},
        "lines", F.floor(F.lit(effort) * F.col("lines_all")))
    return cut.select(F.coalesce(F.try_divide("hits", "hits_all"), F.lit(0.0)).alias("recall"))


def recall_by_probability(df: DataFrame, share: float = 0.2, row_id: str = "id",
                          score: str = "sc", truth: str = "y") -> DataFrame:
    """Recall among the top ``share`` of functions by predicted probability."""
    cut = cut_position(
        df.select(row_id, score, truth), [F.desc(score), F.asc(row_id)], {"hits": F.col(truth), "rows": F.lit(1)},
        "rows", F.floor(F.lit(share) * F.col("rows_all")))
    return cut.select(F.coalesce(F.try_divide("hits", "hits_all"), F.lit(0.0)).alias("recall"))


def longest_first(df: DataFrame, size: str, row_id: str = "pair_id") -> DataFrame:
    """(row_id, size), largest first.

    A global sort reads its input twice, once for the range bounds, so the sizes
    are written down before: texts are measured once.
    """
    return durable(df.select(row_id, size)).orderBy(F.desc(size), F.asc(row_id))
