"""Scores: text equality, n-gram overlap, confusion counts, areas under curves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom.functions import arrow
from pairloom.functions import text as X
from pairloom.operators.scale import global_running, texts_by_id

MAX_N = 4


def canonical_match(pred: Column, truth: Column) -> Column:
    """Equal after left-stripping lines and dropping empty ones; NULL is a miss."""
    return F.coalesce(X.canonical_text(pred) == X.canonical_text(truth), F.lit(False))


def strip_match(pred: Column, truth: Column) -> Column:
    return F.coalesce(X.strip(pred) == X.strip(truth), F.lit(False))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def cwe_coverage(df: DataFrame, match: Column, cwe: str = "cwe") -> DataFrame:
    """Distinct classes among the exact matches, joined by id, never by position."""
    return df.agg(F.count_distinct(F.when(match, F.col(cwe))).alias("classes"))


# The public mteval-v13a tokenisation rules, in order.
_13A = (
    ("<skipped>", ""), ("-\n", ""), ("\n", " "),
    ("&quot;", "\""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
)
_13A_SPLIT = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokens_13a(c: Column) -> Column:
    """Word list as the standard corpus score counts it."""
    for find, put in _13A:
        c = F.replace(c, F.lit(find), F.lit(put))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for find, put in _13A_SPLIT:
        c = F.regexp_replace(c, find, put)
    return X.words(c)


def ngram_stats(df: DataFrame, hyp: str, ref: str, tokenise=tokens_13a,
                row_id: str = "pair_id") -> DataFrame:
    """(row_id, n, matched, hyp, ref): clipped n-gram counts of every row, n = 1..4.

    ``tokenise`` maps a text column to a word array; ``text.words`` cuts at white
    space only.

    Texts of one id are brought together, whole, by one shuffle, and each row is counted where
    it lies: no n-gram is shuffled or sorted.  Tasks number words and n-grams exactly.
    """
    rows = texts_by_id(df.select(row_id, F.col(hyp).alias("_h"), F.col(ref).alias("_r")), row_id, "_h", "_r")
    lists = rows.select(row_id, *[F.transform(c, tokenise).alias(c) for c in ("_h", "_r")])
    schema = T.StructType([
        df.schema[row_id], T.StructField("n", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("matched", "hyp", "ref")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.blocks(batches, "_h", "_r"):
            for n, matched, h, r in _gram_counts(arrow.tokens_of(batch.column("_h")), arrow.tokens_of(batch.column("_r")), batch.num_rows):
                at = np.flatnonzero(h + r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(row_id).take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)),
                     *[pa.array(x[at]) for x in (matched, h, r)]], names=schema.names)

    return lists.mapInArrow(run, schema)


def _gram_counts(hyp: arrow.Tokens, ref: arrow.Tokens, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, matched, hyp, ref) with an entry per row, n = 1..4.

    An n-gram is numbered by the pair of its first n - 1 words' number and its last word's, and
    the first words' numbers hold the row, so equal numbers mean one n-gram of one row.
    """
    word, known = arrow.codes_of(pa.concat_arrays([hyp.words, ref.words]))
    row, left = np.concatenate([hyp.row, ref.row]), np.concatenate([hyp.left, ref.left])
    at, gram = np.arange(len(word)), row
    for n in range(1, MAX_N + 1):
        long_enough = left[at] >= n
        at = at[long_enough]
        gram, _ = arrow.codes_of(gram[long_enough] * len(known) + word[at + n - 1])
        size = int(gram.max(initial=-1)) + 1
        of = np.zeros(size, np.int64)
        of[gram] = row[at]
        r = np.bincount(gram[at >= len(hyp.row)], minlength=size)
        h = np.bincount(gram, minlength=size) - r
        yield n, *[np.bincount(of, x, rows).astype(np.int64) for x in (np.minimum(h, r), h, r)]


def ngram_overlap(stats: DataFrame) -> DataFrame:
    return stats.groupBy("n").agg(
        F.sum("matched").alias("matched"), F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"))


def _wide(stats: DataFrame, *keys: str) -> DataFrame:
    """One row with matched_n, hyp_n, ref_n columns per key set."""
    cells = [F.coalesce(F.sum(F.when(F.col("n") == n, F.col(what))), F.lit(0)).alias(f"{what}_{n}")
             for n in range(1, MAX_N + 1) for what in ("matched", "hyp", "ref")]
    return stats.groupBy(*keys).agg(*cells)


def bleu() -> Column:
    """Score 0-100 over the columns of ``_wide``, with exponential smoothing: the
    k-th order without a match counts as 1 / (2^k * number of n-grams)."""
    zero_orders, logs = F.lit(0), []
    for n in range(1, MAX_N + 1):
        matched, total = F.col(f"matched_{n}"), F.col(f"hyp_{n}")
        zero_orders = zero_orders + (matched == 0).cast("int")
        p = F.when(matched > 0, matched / total).otherwise(
            F.lit(1.0) / (F.pow(F.lit(2.0), zero_orders) * total))
        logs.append(F.log(F.when(total > 0, p)))
    brevity = F.when(F.col("hyp_1") < F.col("ref_1"),
                     F.exp(1 - F.col("ref_1") / F.col("hyp_1"))).otherwise(1.0)
    score = 100 * brevity * F.exp(reduce(lambda a, b: a + b, logs) / MAX_N)
    any_match = reduce(lambda a, b: a + b, [F.col(f"matched_{n}") for n in range(1, MAX_N + 1)]) > 0
    return F.when(any_match, F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def corpus_bleu(stats: DataFrame) -> DataFrame:
    return _wide(stats).select(bleu().alias("bleu"))


def _row_gleu(stats: DataFrame, row_id: str) -> DataFrame:
    sums = stats.groupBy(row_id).agg(
        F.sum("matched").alias("m"), F.greatest(F.sum("hyp"), F.sum("ref")).alias("t"))
    return sums


def google_bleu(stats: DataFrame, row_id: str = "pair_id") -> DataFrame:
    """Sum of matches over the sum of the larger n-gram count of each row."""
    return _row_gleu(stats, row_id).agg((F.sum("m") / F.sum("t")).alias("google_bleu"))


def macro_metrics(df: DataFrame, hyp: str, ref: str, tokenise=tokens_13a,
                  row_id: str = "pair_id") -> DataFrame:
    """Every score per row, rounded to 4 places, then averaged.

    A row without any n-gram on either side scores 0.
    """
    per_row = (_wide(ngram_stats(df, hyp, ref, tokenise, row_id), row_id)
               .withColumn("bleu", bleu()))
    cells = lambda what: reduce(
        lambda a, b: a + b, [F.col(f"{what}_{n}") for n in range(1, MAX_N + 1)])
    per_row = per_row.withColumn(
        "gleu", cells("matched") / F.greatest(cells("hyp"), cells("ref")))
    base = df.select(row_id, strip_match(F.col(hyp), F.col(ref)).cast("double").alias("hit"))
    rounded = lambda c: F.avg(F.round(F.coalesce(F.col(c), F.lit(0.0)), 4))
    return base.join(per_row, row_id, "left").agg(
        rounded("bleu").alias("bleu"), rounded("gleu").alias("google_bleu"),
        rounded("hit").alias("accuracy"),
        F.avg(F.coalesce(F.col("hyp_1"), F.lit(0))).alias("gen_len"))


def confusion(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Counts and the usual ratios, over the table or per ``by`` value."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return counts.select(*by, "tp", "fp", "tn", "fn", *confusion_ratios())


def confusion_ratios() -> list[Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return [ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
            ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc")]


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives per score: ties collapse before anything is sorted."""
    return df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Rank-sum area; tied scores share their average rank."""
    run = global_running(_by_score(df, truth, score), [F.asc("_s")],
                         {"run_neg": F.col("neg")})
    below = F.col("run_neg") - F.col("neg")
    won = F.col("pos").cast("double") * (below + F.col("neg") / 2)
    return run.agg((F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


def pr_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Trapezoid area under precision over recall, from (0, 1) on."""
    run = global_running(_by_score(df, truth, score), [F.desc("_s")],
                         {"run_pos": F.col("pos"), "run_all": F.col("pos") + F.col("neg")})
    pos_before = F.col("run_pos") - F.col("pos")
    all_before = F.col("run_all") - F.col("pos") - F.col("neg")
    precision = F.col("run_pos") / F.col("run_all")
    precision_before = F.when(all_before == 0, F.lit(1.0)).otherwise(
        F.try_divide(pos_before, all_before))
    return run.agg(F.try_divide(
        F.sum(F.col("pos") * (precision + precision_before) / 2), F.sum("pos")).alias("pr_auc"))


def tpr_by_class(df: DataFrame, truth: str, predicted: str, cwe: str = "cwe") -> DataFrame:
    """Hits, positives and recall per class, over the true rows."""
    return (df.where(F.col(truth) == 1).groupBy(cwe)
            .agg(F.count_if(F.col(predicted) == 1).alias("hits"), F.count("*").alias("total"))
            .withColumn("tpr", F.col("hits") / F.col("total"))
            .withColumn("proportion", F.concat_ws("/", "hits", "total")))
