"""Whole jobs: build records, apply predictions, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import schema as S
from pairloom.functions import text as X
from pairloom.functions import wire
from pairloom.operators import apply as A
from pairloom.operators import dedup, diff, lines, metrics, tables
from pairloom.session import store_texts


def folded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: X.fold_braces(F.col(c)) for c in ("before", "after")})


def with_unique_before(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("pair_id", "before")]
    return lines.uniquify_lines(pairs, "before", keep=rest)


def prepared_pairs(pairs: DataFrame) -> DataFrame:
    """Drop incomplete rows, fold braces, make the before lines unique."""
    return with_unique_before(folded(tables.drop_missing(pairs, "before", "after")))


def dataset_table(pairs: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Pairs with their two target columns; pairs with ``max_lines`` changed lines or more are dropped.

    A pair without any edit keeps two empty targets.  The prepared pairs are stored once, since
    the diff and the table both read them.
    """
    ready = store_texts(prepared_pairs(pairs))
    targets = diff.location_targets(diff.scripts_of(ready), max_lines)
    return tables.drop_missing(ready.join(targets, "pair_id"), "lines_with_vul", "lines_after_fix")


def build_records(pairs: DataFrame, excluded: DataFrame | None = None, dedup_rows: bool | Column = True,
                  unique_before: bool = True, strip: bool = True) -> DataFrame:
    """(pair_id, before, after, inputs, outputs): fill, exclude, dedup, diff, encode.

    ``dedup_rows`` says which rows are deduplicated among themselves: train rows are, test rows
    are not.  As a column it builds both splits in one pass.  ``strip`` takes white space off the
    head of the text.  The prepared pairs are stored once; diff and records both read them.
    """
    rows = tables.fill_missing(pairs, "before", "after")
    if strip:
        rows = rows.withColumn("before", X.lstrip(F.col("before")))
    if excluded is not None:
        rows = tables.exclude_rows(rows, excluded)
    rows = _deduplicated(rows, dedup_rows, "before", "after").select("pair_id", "before", "after")
    rows = folded(rows)
    rows = store_texts(with_unique_before(rows) if unique_before else rows)
    return diff.injection_records(rows, diff.edit_script(diff.edits_of(rows)))


def _deduplicated(rows: DataFrame, which: bool | Column, *texts: str) -> DataFrame:
    """Keep the first of equal rows; a row for which ``which`` is not true has no key and stays."""
    if which is False:
        return rows
    key = X.fingerprint(*[F.col(c) for c in texts])
    return dedup.keep_first(rows, key if which is True else F.when(which, key))


def location_records(pairs: DataFrame, excluded: DataFrame | None = None, dedup_rows: bool | Column = True,
                     with_spaces: bool = True, eos: str = "") -> DataFrame:
    """(pair_id, prompt) that teaches to name the lines to change: fill, exclude, dedup, prompt.

    ``pairs`` has ``before`` and ``lines_after_fix`` (see ``dataset_table``).  Without
    ``with_spaces`` the target is stripped and loses the white space behind its line breaks.
    """
    rows = tables.fill_missing(pairs, "before", "lines_after_fix")
    rows = rows.withColumn("before", X.lstrip(F.col("before")))
    if not with_spaces:
        rows = rows.withColumn("lines_after_fix", X.collapse_indent(F.col("lines_after_fix")))
    if excluded is not None:
        rows = tables.exclude_rows(rows, excluded)
    rows = _deduplicated(rows, dedup_rows, "before", "lines_after_fix")
    return rows.select("pair_id", wire.prompt(F.col("before"), F.col("lines_after_fix"), eos).alias("prompt"))


def generate(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Join predictions by id and apply them; see ``apply.apply_edits``."""
    return A.apply_edits(tables.join_predictions(pairs, predictions))


def score(generated: DataFrame, truth: str = "after") -> DataFrame:
    """Exact-match share and problem count of applied predictions."""
    match = metrics.canonical_match(F.col("generated"), F.col(truth))
    return generated.agg(
        F.count("*").alias("pairs"), F.count_if(match).alias("matched"),
        metrics.share(match).alias("accuracy"), F.count_if(A.problem()).alias("problems"))


def misses(generated: DataFrame, truth: str = "after") -> DataFrame:
    """Rows whose generated text is not the true one; a row without a result is a miss."""
    return generated.where(~metrics.canonical_match(F.col("generated"), F.col(truth)))


def round_trip(pairs: DataFrame) -> DataFrame:
    """(pair_id, generated, status, same): apply the script of a pair to its own
    before text.  A pair without an edit has nothing to apply and stays as it is."""
    ready = store_texts(with_unique_before(pairs.select("pair_id", "before", "after")))
    records = diff.injection_records(ready, diff.edit_script(diff.edits_of(ready)))
    edited = F.col("outputs") != ""
    done = A.apply_edits(records.select(
        "pair_id", "before", "after", edited.alias("edited"),
        F.substring_index("inputs", S.END_OF_FUNCTION, -1).alias("locations"),
        F.col("outputs").alias("injections")))
    done = done.withColumns({
        "generated": F.when(F.col("edited"), F.col("generated")).otherwise(F.col("before")),
        "status": F.when(F.col("edited"), F.col("status")).otherwise(S.STATUS_OK)})
    return done.select("pair_id", "generated", "status",
                       metrics.canonical_match(F.col("generated"), F.col("after")).alias("same"))
