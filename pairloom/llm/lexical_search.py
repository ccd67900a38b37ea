"""Ranked lexical search of many items at once, with work shared between the items.

Items of one block are rewritten into a sharing DAG: the pair of nodes (terms, or sums of
terms) that most items have in common becomes a node of its own, again and again, until no
pair is shared.  For a slice of documents every node is added up once; items then combine
the nodes they are left with.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.tables import durable, text_arrays

#: Items of one block: they share a DAG, and its terms go to every task.
BLOCK_ITEMS = 512
#: Documents cut at a time, and cells of a task's accumulator table.
SLICE, CELLS = 400, 4_000_000
#: Mining looks at the pairs of this many most shared nodes of an item; the others are only
#: added up item by item.
MINED_TERMS = 256

# Letters, digits and all of non-ASCII stay, A-Z in lower case; the rest separates terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text, in order, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def sharing_dag(items: list[set[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(sums, roots): node ``n_terms + i`` is the sum of the two nodes ``sums[i]``, and an
    item is the sum of its ``roots``.

    The pair of nodes that most items hold is replaced first; ties go to smaller node
    numbers.  A pair held by one item only is not replaced.
    """
    nodes = [set(x) for x in items]
    use = Counter(t for x in nodes for t in x)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, x in enumerate(nodes):
        shared = heapq.nsmallest(MINED_TERMS, (t for t in x if use[t] > 1), key=lambda t: (-use[t], t))
        for pair in combinations(sorted(shared), 2):
            holders[pair].add(i)
    heap = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
    heapq.heapify(heap)
    mined = [{t for t in x if use[t] > 1} for x in nodes]
    sums: list[tuple[int, int]] = []
    while heap:
        n, pair = heapq.heappop(heap)
        now = holders[pair]
        if len(now) < 2:
            continue
        if len(now) != -n:
            heapq.heappush(heap, (-len(now), pair))
            continue
        new, where = n_terms + len(sums), sorted(now)
        sums.append(pair)
        fresh: set[tuple[int, int]] = set()
        for i in where:
            for gone in pair:
                nodes[i].discard(gone)
                mined[i].discard(gone)
                for other in mined[i]:
                    holders[min(gone, other), max(gone, other)].discard(i)
            holders[pair].discard(i)
            for other in mined[i]:
                holders[other, new].add(i)
                fresh.add((other, new))
            nodes[i].add(new)
            mined[i].add(new)
        for other in fresh:
            if len(holders[other]) > 1:
                heapq.heappush(heap, (-len(holders[other]), other))
    return sums, [sorted(x) for x in nodes]


def _occurrences(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that hold any term: all their terms with
    repeats, and the occurrences of the known ones."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            size, found, counts = [], [], []
            for text in batch.column("_text").to_pylist():
                words = terms_of(text)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                ids, tf = np.unique(ids[ids >= 0], return_counts=True)
                size.append(len(words))
                found.append(ids)
                counts.append(tf.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(size, pa.int64()), text_arrays(found, pa.int32()),
                 text_arrays(counts, pa.int64())], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(cut, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


class _Best:
    """The highest-scoring documents of every item so far: more score first, then the
    smaller id, a null id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, 0), np.int64)
        self.doc = np.zeros((items, 0), np.int64)
        self.null = np.zeros((items, 0), bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        wide = lambda x: np.broadcast_to(x, score.shape)
        both = [np.hstack(x) for x in ((self.score, score), (self.doc, wide(doc)), (self.null, wide(null)))]
        order = np.lexsort((both[1], both[2], -both[0]), axis=-1)[:, :self.k]
        self.score, self.doc, self.null = (np.take_along_axis(x, order, -1) for x in both)


def _ranked_block(docs: DataFrame, block: list[tuple[object, set[bytes]]], k: int) -> DataFrame:
    """(item, doc_id, score): every task's best ``k`` of each item of one block."""
    spark = docs.sparkSession
    names = sorted({t for _, terms in block for t in terms})
    known = {t: i for i, t in enumerate(names)}
    held = durable(_occurrences(docs, known))
    n_docs, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[row.term] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    sums, roots = sharing_dag([{known[t] for t in terms} for _, terms in block], len(names))
    plan = spark.sparkContext.broadcast((weight, sums, roots))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums, roots = plan.value
        n = len(weight)
        top, step = _Best(len(roots), k), max(16, CELLS // max(1, n + len(sums)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            size = batch.column("n").to_numpy()
            m = 100 - 50 + (50 * size * n_docs) // length
            terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            doc = np.repeat(np.arange(len(size)), terms.value_lengths().to_numpy())
            term = terms.flatten().to_numpy()
            sums_of = np.zeros((n + len(sums), len(size)), np.int64)
            sums_of[term, doc] = weight[term] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
            for i, (x, y) in enumerate(sums, n):
                np.add(sums_of[x], sums_of[y], out=sums_of[i])
            score = np.stack([sums_of[x].sum(axis=0) for x in roots])
            ids = batch.column("doc_id")
            top.add(score, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, at = np.nonzero(top.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(top.doc[item, at], pa.int64(), mask=top.null[item, at]),
             pa.array(top.score[item, at], pa.int64())], names=["item", "doc_id", "score"])

    return held.mapInArrow(best, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id",
           item_id: str = "item_id") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    A score sums, over the item's distinct terms, weight times saturated frequency, in
    64-bit integers.  Only documents with a score above 0 are ranked; equal scores go by
    ascending doc_id, a null id last.  Rows that share an item_id (null is one of them) are
    one item with the terms of all of them; rows that share a doc_id are documents of their
    own.  A null or empty text has no terms.  Whole texts count, however long.  No items, no
    documents or no common term give no rows.  Other columns of both tables are not read, so
    their names cannot clash.

    Items are taken in blocks of about BLOCK_ITEMS; each block reads the documents once and
    sends its terms and its DAG to the tasks.  A task returns ``k`` documents per item at
    most, which the final ranking cuts per task before its exchange.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    asked = items.select(F.col(item_id).alias("_item"), F.col(text).cast("string").alias("_text"))
    blocks = max(1, -(-asked.select("_item").distinct().count() // BLOCK_ITEMS))
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    for i in range(blocks):
        terms: dict[object, set[bytes]] = defaultdict(set)
        for row in asked.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i).collect():
            terms[row._item].update(terms_of(row._text))
        block = sorted(((x, t) for x, t in terms.items() if t), key=lambda x: (x[0] is None, x[0]))
        if block:
            ids = spark.createDataFrame([(j, x) for j, (x, _) in enumerate(block)], f"item int, item_id {kind}")
            found.append(_ranked_block(rows, block, k).join(F.broadcast(ids), "item").drop("item"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (every.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
