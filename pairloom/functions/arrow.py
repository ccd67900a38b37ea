"""Helpers for tasks that work on Arrow columns of token lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that a task works on at a time; a text is never cut.
BLOCK_TOKENS = 1 << 18
#: Bytes of text that a task cuts into tokens at a time; a text is never cut.
BLOCK_BYTES = 1 << 20


class Tokens(NamedTuple):
    """The tokens of a column array<array<string>>, a list of texts a row, in order."""

    words: pa.Array
    row: np.ndarray
    #: Place in the text, and tokens of the text from this one on.
    pos: np.ndarray
    left: np.ndarray
    #: Texts per row.
    texts: np.ndarray


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def tokens_of(column: pa.Array) -> Tokens:
    texts, each = lengths(column), column.flatten()
    sizes, pos = lengths(each), places(lengths(each))
    row = np.repeat(np.repeat(np.arange(len(texts)), texts), sizes)
    words = each.flatten() if len(row) else pa.array([], pa.string())  # Spark's empty columns lack buffers
    return Tokens(words, row, pos, np.repeat(sizes, sizes) - pos, texts)


def blocks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_TOKENS tokens in ``columns``, or of one row."""
    for batch in batches:
        held = sum(np.bincount(tokens_of(batch.column(c)).row, minlength=batch.num_rows) for c in columns)
        block = np.cumsum(held) // BLOCK_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def strings(texts: pa.Array) -> list[str]:
    """Python strings; bytes that are no UTF-8 are replaced, as the engine does."""
    return [str(t, "utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


#: Bytes of UTF-8: 0 white space, 1 of a word, 2 first of any other character, 3 further ones.
_KIND = np.full(256, 2, np.uint8)
_KIND[list(b" \t\n\x0b\f\r")] = 0
_KIND[[i for i in range(128) if chr(i).isalnum() or i == ord("_")]] = 1
_KIND[0x80:0xc0] = 3


def words_and_marks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, tokens of each text), the tokens of ``text.TOKEN``, found in the bytes of a whole column.

    A token begins at the first byte of a run of word bytes, or at any other character; what is left
    without white space are the tokens end to end."""
    texts = texts.cast(pa.string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    try:
        str(data, "utf-8")
    except UnicodeDecodeError:
        return words_and_marks(pa.array(strings(texts), pa.string()))
    ends = ends - ends[0]
    kind = _KIND[data]
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    before[ends[:-1][ends[:-1] < len(data)]] = 0
    first = (kind == 2) | ((kind == 1) & (before != 1))
    kept = kind != 0
    offsets = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return words, np.diff(np.searchsorted(np.flatnonzero(first), ends))


def by_pattern(pattern: str) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """Like ``words_and_marks``, for the matches of a pattern."""
    find = re.compile(pattern).findall

    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        found = [find(t) for t in strings(texts.fill_null(""))]
        return pa.array(list(chain.from_iterable(found)), pa.string()), np.fromiter(map(len, found), np.int64, len(found))
    return cut


def cut_texts(batches: Iterator[pa.RecordBatch], column: str, cut: Callable[[pa.Array], tuple[pa.Array, np.ndarray]],
              block: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    """Rows of about ``block`` bytes of text in ``column`` (array<string>, without nulls), or one row, with
    the tokens of their texts and the number of tokens of each text."""
    for batch in batches:
        texts = lengths(batch.column(column))
        each = pc.binary_length(batch.column(column).flatten()).to_numpy(zero_copy_only=False) if texts.any() else np.array([], np.int64)
        held = np.bincount(np.repeat(np.arange(len(texts)), texts), weights=each, minlength=len(texts))
        at = np.cumsum(held) // block
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                rows = batch.slice(lo, hi - lo)
                words, sizes = cut(rows.column(column).flatten() if texts[lo:hi].any() else pa.array([], pa.string()))
                row, pos = np.repeat(np.repeat(np.arange(hi - lo), texts[lo:hi]), sizes), places(sizes)
                yield rows, Tokens(words, row, pos, np.repeat(sizes, sizes) - pos, texts[lo:hi]), sizes


def codes_of(values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, distinct values), numbered by first use; exact, not a hash."""
    coded = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def as_lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
