"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after a learned rotation.  A code is split into substrings,
each with an index of its own.  If two codes differ in at most R bits, they differ in at most
R / substrings bits in one of them at least, so probing every index within that distance finds
all codes within R.  What is found is ranked anew on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import durable

#: Rows that the rotation and the radius are learned from, at most; queries among them.
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Share of true neighbours within the radius, on the sample.
TARGET = 0.97
#: Bits of a code, and of a substring.
BITS, PART = 64, 8
#: Rows and queries of a block: what one task holds at a time.
ROWS, QUERIES = 16384, 4096
ROUNDS = 25

_PARTS = BITS // PART
#: Distance between any two values of a substring.
_APART = np.bitwise_count(np.arange(1 << PART, dtype=np.uint8)[:, None] ^ np.arange(1 << PART, dtype=np.uint8))


def learn_rotation(sample: np.ndarray, seed: int = 3) -> np.ndarray:
    """Rotation to BITS signs by iterative quantisation: principal axes, then turned to lie near the signs.

    Vectors of fewer dimensions than bits are turned into more axes by a random rotation first.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    if len(sample) < BITS or dims < BITS:
        return np.linalg.qr(rng.normal(size=(max(dims, BITS), BITS)))[0][:dims]
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :BITS]
    low = sample @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (u @ v).T
    return axes @ turn


def codes_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Signs of the rotated vectors, PART bits a byte."""
    return np.packbits(vectors @ rotation > 0, axis=1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes of a and b differ, all with all."""
    a, b = a.view(np.uint64).ravel(), b.view(np.uint64).ravel()
    return np.bitwise_count(a[:, None] ^ b)


def learn_radius(sample: np.ndarray, rotation: np.ndarray, k: int) -> int:
    """Least radius that holds TARGET of the k nearest, for queries from the sample."""
    if len(sample) <= k + 1:
        return BITS
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    nearest = np.argpartition(-scores, k, axis=1)[:, :k]
    code = codes_of(sample, rotation)
    far = np.take_along_axis(_far(code[:len(queries)], code), nearest, axis=1)
    return int(np.quantile(far, TARGET, method="higher"))


class Index:
    """Codes of one block of vectors, each substring's values in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        self.ids, self.vectors, self.rotation = ids, vectors, rotation
        self.code = codes_of(vectors, rotation)
        self.order = [np.argsort(self.code[:, j], kind="stable") for j in range(_PARTS)]
        self.ends = [np.searchsorted(self.code[o, j], np.arange((1 << PART) + 1)) for j, o in enumerate(self.order)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the radius of one code."""
        near = radius // _PARTS
        found = np.zeros(len(self.ids), dtype=bool)
        for j, (order, ends) in enumerate(zip(self.order, self.ends)):
            values = np.flatnonzero(_APART[code[j]] <= near)
            if len(values) == 1 << PART:
                found[:] = True
                break
            runs = np.flatnonzero(np.diff(np.concatenate(([-2], values))) != 1)
            lasts = np.append(runs[1:], len(values)) - 1
            for a, b in zip(values[runs], values[lasts]):
                found[order[ends[a]:ends[b + 1]]] = True
        at = np.flatnonzero(found)
        return at[_far(code[None], self.code[at])[0] <= radius]

    def nearest(self, query: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows found for one query, and their inner products.

        If the radius holds fewer than k rows of the block, the whole block is ranked.
        """
        at = self.probe(code, radius)
        at = at[self.ids[at] != query]
        if len(at) < k:
            at = np.flatnonzero(self.ids != query)
        rough = self.vectors[at] @ vector
        if len(at) > k:
            # Ties at the border stay in; exact scores and ids decide below.
            border = np.partition(rough, len(at) - k)[len(at) - k]
            at = at[rough >= border - 1e-9 * (1 + abs(border))]
        score = (self.vectors[at] * vector).sum(axis=1)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64).reshape(len(column), -1)


def _unfit(vec_id: str, embedding: str) -> Column:
    """Why a row takes no part, whatever the other rows are; null if it does."""
    vector = F.col(embedding).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.when(F.col(vec_id).isNull(), "no id").when(vector.isNull() | (F.size(vector) == 0), "no vector")
            .when(~sound, "null or non-finite component").when(~F.exists(vector, lambda x: x != 0), "zero vector"))


def _common_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length, the smaller of two as frequent; 0 without rows."""
    first = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return first.n if first else 0


def left_out(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, reason) of the rows that the search cannot use: no id, no vector, a null or
    non-finite component, a zero vector, or another length than most of the other rows."""
    why = _unfit(vec_id, embedding)
    fit = vectors.where(why.isNull())
    other = F.when(F.size(embedding) != _common_length(fit, embedding), "other length")
    return vectors.select(vec_id, F.coalesce(why, other).alias("reason")).where(F.col("reason").isNotNull())


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows, by inner product, of every row with ``is_query``.

    Columns: query_id, rank (from 1), vec_id, score.  Ties go to the smaller id.  All rows are
    candidates but those with the query's own id.  Rows that ``left_out`` names take no part.  A
    query with fewer than k candidates gets them all.  Repeated rows, equal in id and vector,
    are one row; rows that share an id only are rows of their own, and each is ranked for by
    itself if it is a query.  An empty table gives an empty result.  Other columns are not read.

    Rotation and radius are fitted on at most SAMPLE rows, taken by the hash of the id; every
    row is indexed.  Blocks of rows meet blocks of queries by key; a task holds one of each,
    and hands on k rows per query.
    """
    spark = vectors.sparkSession
    rows = durable(vectors.where(_unfit(vec_id, embedding).isNull()).select(
        F.col(vec_id).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v"),
        is_query.alias("_query")).dropDuplicates(["_id", "_v"]))
    rows = rows.where(F.size("_v") == _common_length(rows, "_v"))
    stats = rows.agg(F.count("*"), F.count_if("_query")).first()
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").collect()
    drawn = np.array([r._v for r in sample], dtype=np.float64) if sample else np.zeros((0, 1))
    rotation = learn_rotation(drawn)
    radius = learn_radius(drawn, rotation, k)
    row_blocks, query_blocks = (max(1, -(-n // most)) for n, most in ((stats[0], ROWS), (stats[1], QUERIES)))
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shared = spark.sparkContext.broadcast(rotation)

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = Index(left["_id"].to_numpy(), _matrix(left["_v"]), shared.value)
            asked = _matrix(right["_v"])
            for query, row, v, code in zip(right["_id"].to_numpy(), right["_row"].to_numpy(), asked, codes_of(asked, shared.value)):
                ids, score = index.nearest(query, v, code, radius, k)
                out.append(pd.DataFrame({"query_id": query, "_row": row, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "_row": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "_row": "int64", "vec_id": "int64"})

    data = rows.select(block(1, row_blocks).alias("_r"), every(query_blocks).alias("_q"), "_id", "_v")
    asked = rows.where("_query").select(every(row_blocks).alias("_r"), block(2, query_blocks).alias("_q"), "_id", "_v",
                                          F.xxhash64("_v").alias("_row"))
    found = (data.groupBy("_r", "_q").cogroup(asked.groupBy("_r", "_q"))
             .applyInPandas(find, "query_id long, _row long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
