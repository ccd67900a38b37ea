"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item.  Its set are its shingles of
up to three words, ordered by how often they occur in the whole corpus, rarest first.  Full
containment is asked for, so the necessary prefix is one shingle: a document that contains
the window contains its rarest shingle.  Documents and windows are joined on it; then the
window must fit between the start and the end of the document around the match (positional
and length bounds), and all its words must be equal.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.tables import bitmap_of, durable, in_bitmap, size_checked

#: Words of a window, and of its shingles at most.
WINDOW, SHINGLE = 10, 3
#: Bytes of text that a task takes apart at a time.
BLOCK = 1 << 20

#: The same for bytes: A-Z to a-z, every other ASCII character between words to a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                  for b in range(256))

#: Fixed odd multipliers of the word positions in a shingle.
_POSITION = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=count)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit hash for every ``size`` consecutive words."""
    return join_hashes(word_hashes(words, len(words)), size)


def join_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive hashes of words."""
    last = len(h) - size + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64)
    s = np.full(last, size, dtype=np.uint64)
    for k in range(size):
        s = s + (h[k:last + k] ^ (h[k:last + k] << np.uint64(31))) * np.uint64(_POSITION[k])
    s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (s ^ (s >> np.uint64(32))).view(np.int64)


def _blocks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of every text of a column, in order, about BLOCK bytes of text at a time.

    The bytes are read where Arrow holds them; a longer text is a block of its own.
    """
    column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(ends, dtype=wide)[column.offset:column.offset + len(column) + 1].tolist()
    first = 0
    while first < len(column):
        last = max(first + 1, bisect_right(ends, ends[first] + BLOCK) - 1)
        low = ends[first]
        text = data[low:ends[last]].to_pybytes().translate(_TO_WORDS) if ends[last] > low else b""
        yield [text[x - low:y - low].split() for x, y in pairwise(ends[first:last + 1])]
        first = last


def _matches(texts: list[list[bytes]], sizes: Sequence[int], bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every size, where in the joined words a shingle within one text is in the bitmap, and its hash."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    h = word_hashes(chain.from_iterable(texts), int(counts.sum()))
    ends = np.repeat(np.cumsum(counts), counts)
    found = []
    for size in sizes:
        s = join_hashes(h, size)
        at = np.flatnonzero(in_bitmap(bits, s))
        at = at[at + size <= ends[at]]
        found.append((at, s[at]))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of every item, each with the hashes of its shingles."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column("_item").to_pylist(), batch.column("_text").to_pylist()):
            words = words_of(text)
            size = min(SHINGLE, len(words))
            hashes = shingle_hashes(words, size).tolist() if words else []
            length = min(WINDOW, len(words))
            for start in range(len(words) - length + 1 if words else 0):
                out.append((item, size, length, b" ".join(words[start:start + length]).decode("utf-8", "surrogatepass"),
                            hashes[start:start + length - size + 1]))
        item, size, length, text, hashes = zip(*out) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(length, pa.int32()),
             pa.array(text, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["item_id", "size", "length", "words", "shingles"])


def windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """All windows of all items: item_id, size (of shingles), length, words, shingles.

    An item of fewer than WINDOW words, but not none, is one window.
    """
    return (benchmark.select(F.col(item_id).cast("string").alias("_item"), F.col(text).cast("string").alias("_text"))
            .mapInArrow(_cut, "item_id string, size int, length int, words string, shingles array<long>"))


def _frequencies(docs: DataFrame, bits, sizes: Sequence[int], text: str) -> DataFrame:
    """How often each shingle of the benchmark occurs in the corpus (counted in every task first)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for texts in _blocks(batch.column("_text")) for _, h in _matches(texts, sizes, bits.value)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["_h", "n"])

    return (docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(count, "_h long, n long")
            .groupBy("_h").agg(F.sum("n").alias("n")))


def prefixes(cut: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rarest shingle of every window and its place: item_id, length, words, _h, offset."""
    each = cut.select("item_id", "length", "words", F.posexplode("shingles").alias("offset", "_h"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_h", "offset")
    return (each.join(frequency, "_h", "left").groupBy("item_id", "length", "words")
            .agg(F.min(rank).alias("_r")).select("item_id", "length", "words", "_r._h", "_r.offset"))


def _candidates(docs: DataFrame, bits, sizes: Sequence[int], text: str, doc_id: str) -> DataFrame:
    """Per document its word count and the places whose shingle may be a prefix.

    A place carries the words around it as far as a window can reach, so that the check of
    the words needs no second look at the text.
    """
    around = WINDOW - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = [], []
            for texts in _blocks(batch.column("_text")):
                mine: list[list[dict]] = [[] for _ in texts]
                starts = np.cumsum([0, *map(len, texts)])
                for at, hashes in _matches(texts, sizes, bits.value):
                    rows = np.searchsorted(starts, at, side="right") - 1
                    for row, p, h in zip(rows.tolist(), (at - starts[rows]).tolist(), hashes.tolist()):
                        left = max(0, p - around)
                        near = b" ".join(texts[row][left:p + WINDOW]).decode("utf-8", "surrogatepass")
                        mine[row].append({"_h": h, "at": p, "left": left, "near": near})
                n += map(len, texts)
                places += mine
            kind = pa.list_(pa.struct([("_h", pa.int64()), ("at", pa.int32()), ("left", pa.int32()),
                                       ("near", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), batch.column("_key"), pa.array(n, pa.int64()),
                 pa.array(places, kind)], names=["_row", "_id", "_key", "n_words", "places"])

    return (docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("_id"),
                        F.xxhash64(text).alias("_key"), F.col(text).cast("string").alias("_text"))
            .mapInArrow(find, "_row long, _id long, _key long, n_words long, "
                              "places array<struct<_h: long, at: int, left: int, near: string>>"))


def _covered(start: Column, end: Column, order) -> Column:
    """Words that an interval adds to those before it in the same document."""
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), end - F.greatest(start, F.coalesce(before, F.lit(0))))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_id: str = "item_id") -> DataFrame:
    """Words of every document that lie inside an occurrence of a benchmark window.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined
    item ids; of the empty string without any), contaminated, text_key (64-bit hash of the
    text).  One row for each row of ``docs``, with null and repeated ids as they come.  Null
    and empty texts have no words.  Items without words have no windows; an item with a null
    id contaminates but is not listed or counted.  Repeated items count once.  With an empty
    benchmark nothing is hit; an empty ``docs`` gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    # The benchmark and its windows do not grow with the corpus.  Their size is checked by
    # the planner before it broadcasts them; tasks get fixed-size bitmaps only.
    cut = size_checked(windows(benchmark, text, item_id).distinct())
    sizes = [r.size for r in cut.select("size").distinct().orderBy("size").collect()]  # SHINGLE at most
    in_windows = context.broadcast(bitmap_of(cut.select(F.explode("shingles").alias("_h")), "_h"))
    rarest = size_checked(prefixes(cut, _frequencies(docs, in_windows, sizes, text)))
    in_prefixes = context.broadcast(bitmap_of(rarest, "_h"))
    rows = durable(_candidates(docs, in_prefixes, sizes, text, doc_id))

    start = F.col("at") - F.col("offset")
    words = F.slice(F.split("near", " "), start - F.col("left") + 1, F.col("length"))
    fits = (start >= F.col("left")) & (start + F.col("length") <= F.col("n_words"))
    hits = durable(
        rows.where(F.size("places") > 0).select("_row", "n_words", F.explode("places").alias("p"))
        .select("_row", "n_words", "p.*").join(rarest, "_h").where(fits)
        .where(F.array_join(words, " ") == F.col("words"))
        .select("_row", start.alias("start"), (start + F.col("length")).alias("end"), "item_id"))
    # Overlaps are merged inside one document, never across.
    order = Window.partitionBy("_row").orderBy("start", "end")
    hit = (hits.groupBy("_row", "start", "end").agg(F.lit(1)).select("_row", "start", "end")
           .withColumn("n", _covered(F.col("start"), F.col("end"), order))
           .groupBy("_row").agg(F.sum("n").cast("long").alias("n_hit")))
    items = (hits.select("_row", "item_id").distinct().groupBy("_row")
             .agg(F.count("item_id").alias("n_items"),
                  F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items")))
    found = hit.join(items, "_row")
    zero = F.lit(0).cast("long")
    return (rows.select("_row", "_id", "_key", "n_words").join(found, "_row", "left")
            .select(F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                    F.coalesce("n_items", zero).alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.col("_key").alias("text_key")))
