"""Operators on the lines of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pairloom.functions import arrow
from pairloom.functions import text as X
from pairloom.operators.scale import texts_by_id


def explode_lines(df: DataFrame, text: str, row_id: str = "pair_id", keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, pos, line).  Repartition ``df`` by the id first if windows follow:
    moving whole texts is cheaper than moving lines, and the partitioning holds
    through the explode.  Columns of ``keep`` ride on the first line of each text."""
    rows = df.select(row_id, *keep, F.posexplode(X.lines(F.col(text))).alias("pos", "line"))
    return rows.withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in keep}) if keep else rows


def unique_lines(df: DataFrame, text: str, row_id: str = "pair_id", keep: Sequence[str] = ()) -> DataFrame:
    """Lines after the n-th repeat of a stripped line has got n trailing blanks.

    One shuffle, of the texts by id; the window inherits it.
    """
    lines = explode_lines(df.repartition(row_id), text, row_id, keep)
    same = Window.partitionBy(row_id, X.strip(F.col("line"))).orderBy("pos")
    repeat = F.row_number().over(same) - 1
    return lines.withColumn("line", F.concat("line", F.repeat(F.lit(" "), repeat)))


def assemble(lines: DataFrame, row_id: str = "pair_id", out: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Lines back to one text per id, in order of ``pos``, with the columns that rode along."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return (lines.groupBy(row_id).agg(ordered.alias("_l"), *[F.first(c, ignorenulls=True).alias(c) for c in keep])
            .select(row_id, F.array_join(F.col("_l.line"), "\n").alias(out), *keep))


def uniquify_lines(df: DataFrame, text: str, row_id: str = "pair_id", keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, text, keep...) with no two lines equal; no join brings the kept columns back."""
    return assemble(unique_lines(df, text, row_id, keep), row_id, text, keep)


# The reserved words of C and its integer types of fixed width, which keep their spelling.
RESERVED = (
    "auto break case char const continue default do double else enum extern float for goto if "
    "inline int long register restrict return short signed sizeof static struct switch typedef "
    "union unsigned void volatile while "
    "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t"
).split()
_RESERVED, _NAME = frozenset(RESERVED), re.compile(X.IDENTIFIER)


def normalise_identifiers(df: DataFrame, text: str, row_id: str = "pair_id") -> DataFrame:
    """C tokens of each text with identifiers renamed FUN1.., VAR1.. by first use.

    What stands in comments, strings and character literals is no identifier; each of them is
    one token and stays as it is.  A name that some ``(`` follows at its first use is a function.  Returns
    (row_id, tokens ARRAY<STRING>), with no tokens for an empty or null text.  Texts of one id are
    brought together, whole, by one shuffle, and renamed where they lie: no token is shuffled or sorted.
    """
    rows = texts_by_id(df, row_id, text)
    schema = T.StructType([df.schema[row_id], T.StructField("tokens", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, toks, _ in arrow.cut_texts(batches, text, arrow.by_pattern(X.C_TOKEN_PY)):
            yield pa.RecordBatch.from_arrays([batch.column(row_id), _renamed(toks)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _renamed(toks: arrow.Tokens) -> pa.ListArray:
    """A list of renamed tokens per row."""
    word, known = arrow.codes_of(toks.words)
    words, rows = known.to_pylist(), len(toks.texts)
    row, pos = toks.row, toks.pos
    call = np.roll(word == (words.index("(") if "(" in words else -1), -1) & (toks.left > 1)
    several = bool((toks.texts > 1).any())
    if several:  # texts that share an id are read side by side
        order = np.lexsort((call, pos, row))
        word, row, pos, call = word[order], row[order], pos[order], call[order]
    kept = np.array([w in _RESERVED or not _NAME.fullmatch(w) for w in words], bool)
    at = np.flatnonzero(~kept[word])
    name, _ = arrow.codes_of(row[at] * len(words) + word[at])  # numbered by first use
    _, first = np.unique(name, return_index=True)
    first = at[first]
    # Number of each name among those of its row and kind; names first used at one place share it.
    group = row[first] * 2 + call[first]
    order = np.argsort(group, kind="stable")
    opens = np.diff(group[order], prepend=-1) != 0
    step = np.cumsum(opens | (np.diff(pos[first][order], prepend=-1) != 0))
    number = np.empty(len(first), np.int64)
    number[order] = step - np.repeat(step[opens], np.diff([*np.flatnonzero(opens), len(opens)])) + 1
    most = int(number.max(initial=0))
    code = word.copy()
    code[at] = (len(words) + np.where(call[first], 0, most) + number - 1)[name]
    spelling = words + [f"{kind}{i}" for kind in ("FUN", "VAR") for i in range(1, most + 1)]
    if several:
        rank = np.empty(len(spelling), np.int64)
        rank[sorted(range(len(spelling)), key=lambda i: spelling[i].encode())] = np.arange(len(spelling))
        code = code[np.lexsort((rank[code], pos, row))]
    values = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), pa.array(spelling, pa.string())).dictionary_decode()
    return arrow.as_lists(values, np.bincount(row, minlength=rows))
