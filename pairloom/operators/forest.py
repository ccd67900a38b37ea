"""Random forest on sparse bags of words.

Spark's own trainer keeps a row as one number for every feature, a megabyte for 2^18 of them.  Here a
row stays as large as its bag: each level of all trees is one pass in which tasks count classes for the
features that the open nodes drew, and the splits are chosen from these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, e, factorial, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions import arrow
from pairloom.session import durable

#: Rows, and entries of their bags, that a task works on at a time.
BLOCK_ROWS, BLOCK_ENTRIES = 1 << 12, 1 << 20
#: Distribution of how often a row is drawn into the bootstrap sample of a tree.
_DRAWN = np.cumsum([1 / (e * factorial(k)) for k in range(16)])


class Trees(NamedTuple):
    """Nodes of all trees, from 1 on; the children of n are 2n and 2n + 1."""

    #: Feature of each node's split (-1: leaf) and the count above which a row goes to 2n + 1.
    feature: np.ndarray
    above: np.ndarray
    #: Share of each class in a node.
    share: np.ndarray


class Bags(NamedTuple):
    row: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    rows: int


def _bags(ids: pa.Array, counts: pa.Array) -> Iterator[tuple[int, int, Bags]]:
    """Blocks of rows: where they begin and end, and their bags."""
    sizes = arrow.lengths(ids)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    feature, count = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, counts))
    at = ends[:-1] // BLOCK_ENTRIES + np.arange(len(sizes)) // BLOCK_ROWS
    cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(sizes) else []
    for lo, hi in zip(cuts, cuts[1:]):
        held = slice(ends[lo], ends[hi])
        yield lo, hi, Bags(np.repeat(np.arange(hi - lo), sizes[lo:hi]), feature[held], count[held], hi - lo)


def _nodes(trees: Trees, bags: Bags) -> np.ndarray:
    """The node of each row in each tree, as far as the trees are grown."""
    used = np.unique(trees.feature[trees.feature >= 0])
    node = np.ones((bags.rows, len(trees.feature)), np.int64)
    if not len(used):
        return node
    at = np.searchsorted(used, bags.feature)
    hit = used[np.minimum(at, len(used) - 1)] == bags.feature
    counts = np.zeros((bags.rows, len(used)), np.float32)
    counts[bags.row[hit], at[hit]] = bags.count[hit]
    each = np.arange(bags.rows)
    for t in range(node.shape[1]):
        while (inner := trees.feature[t][node[:, t]] >= 0).any():
            n = node[inner, t]
            split = counts[each[inner], np.searchsorted(used, trees.feature[t][n])]
            node[inner, t] = 2 * n + (split > trees.above[t][n])
    return node


def _times_drawn(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, from a hash of the row's key."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_DRAWN, (z >> np.uint64(11)) * 2.0 ** -53, side="right")


def _class_counts(rows: DataFrame, trees: Trees, drawn: dict[int, np.ndarray], width: int, seed: int) -> DataFrame:
    """(place, feature, value, y, n): drawn rows of each class, by count of each feature that an open node
    drew; feature -1 has all rows of the node.  A place is a node of a tree."""
    per_tree = trees.feature.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {t: np.unique(keys // width) for t, keys in drawn.items()}
        wanted = {t: np.isin(np.arange(width), keys % width) for t, keys in drawn.items()}
        for batch in batches:
            key, y = (batch.column(c).to_numpy() for c in ("key", "y"))
            for lo, hi, bags in _bags(batch.column("ids"), batch.column("counts")):
                node, found = _nodes(trees, bags), []
                for t, keys in drawn.items():
                    n, times = node[:, t], _times_drawn(key[lo:hi], t, seed)
                    live = (times > 0) & np.isin(n, open_[t])
                    all_ = np.flatnonzero(live)
                    found.append((t * per_tree + n[all_], np.full(len(all_), -1), np.zeros(len(all_), np.int64), y[lo:hi][all_], times[all_]))
                    at = np.flatnonzero(wanted[t][bags.feature] & live[bags.row])
                    sought = n[bags.row[at]] * width + bags.feature[at]
                    at = at[keys[np.minimum(np.searchsorted(keys, sought), len(keys) - 1)] == sought]
                    row = bags.row[at]
                    found.append((t * per_tree + n[row], bags.feature[at], bags.count[at], y[lo:hi][row], times[row]))
                *group, times = (np.concatenate(x).astype(np.int64) for x in zip(*found))
                if not len(times):
                    continue
                order = np.lexsort(group)
                group = [x[order] for x in group]
                begins = np.flatnonzero(np.any([np.diff(x, prepend=x[0] - 1) != 0 for x in group], axis=0))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x[begins]) for x in group], pa.array(np.add.reduceat(times[order], begins))],
                    names=["place", "feature", "value", "y", "n"])

    return rows.mapInArrow(run, "place long, feature long, value long, y long, n long")


def _impurity(counts: list[Column], total: Column) -> Column:
    return 1 - sum((c / total) * (c / total) for c in counts)


def _best_splits(counts: DataFrame, classes: int) -> DataFrame:
    """(place, total, best): class counts of every open node, and its split with the largest gain of purity
    (gain, feature, value, above, right) if any divides it; ties go to the smaller feature and value."""
    held = [F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in range(classes)]
    table = durable(counts.groupBy("place", "feature", "value").agg(*held))
    each = [F.col(f"_{k}") for k in range(classes)]
    total = table.where("feature < 0").select("place", F.array(*each).alias("total"))
    of = Window.partitionBy("place", "feature").orderBy(F.desc("value"))
    so_far = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = [F.col("right")[k] for k in range(classes)]
    left = [F.col("total")[k] - right[k] for k in range(classes)]
    n, n_left, n_right = sum(F.col("total")[k] for k in range(classes)), sum(left), sum(right)
    gain = (_impurity([F.col("total")[k] for k in range(classes)], n)
            - n_left / n * _impurity(left, n_left) - n_right / n * _impurity(right, n_right))
    splits = (table.where("feature >= 0")
              .select("place", "feature", "value", F.array(*[F.sum(c).over(so_far) for c in each]).alias("right"),
                      ((F.col("value") + F.coalesce(F.lead("value").over(of), F.lit(0))) / 2).alias("above"))
              .join(F.broadcast(total), "place").where(n_left > 0).withColumn("gain", gain).where("gain > 0")
              .groupBy("place").agg(F.max(F.struct(
                  "gain", (-F.col("feature")).alias("feature"), (-F.col("value")).alias("value"), "above", "right")).alias("best")))
    return total.join(splits, "place", "left")


def fit(rows: DataFrame, features: str, label: str, width: int, trees: int, depth: int, seed: int) -> ForestModel:
    """Grow ``trees`` trees on whole counts in a sparse vector column of ``width`` features.

    Each tree draws its rows with replacement, and each node the square root of ``width`` features; a split may
    lie between any two counts.  What passes the driver is one row for each open node.
    """
    y, bag = F.col(label), F.unwrap_udt(F.col(features))
    whole = F.when((y >= 0) & (y == F.floor(y)), y.cast("long")).otherwise(F.raise_error(F.lit("labels are whole numbers from 0 on")))
    stored = durable(rows.select(F.monotonically_increasing_id().alias("key"), whole.alias("y"),
                                 bag["indices"].alias("ids"), bag["values"].cast("array<long>").alias("counts")))
    most = stored.agg(F.max("y")).first()[0]
    if most is None:
        raise ValueError("no rows to learn from")
    classes, drawn_features = most + 1, width if trees == 1 else ceil(sqrt(width))
    grown = Trees(np.full((trees, 2 << depth), -1, np.int64), np.zeros((trees, 2 << depth)), np.zeros((trees, 2 << depth, classes)))
    nodes = [(t, 1) for t in range(trees)]
    for level in range(max(depth, 1)):
        drawn: dict[int, list[np.ndarray]] = {}
        for t, n in nodes:
            chosen = np.random.default_rng([seed, t, n]).choice(width, drawn_features, replace=False)
            drawn.setdefault(t, []).append(n * width + np.sort(chosen))
        keys = {t: np.sort(np.concatenate(x)) for t, x in drawn.items()}
        found = _best_splits(_class_counts(stored, grown, keys, width, seed), classes).collect() if keys else []
        nodes = []
        for r in found:
            (t, n), total = divmod(r.place, 2 << depth), np.array(r.total)
            grown.share[t, n] = total / total.sum()
            if r.best is None or level == depth:
                continue
            grown.feature[t, n], grown.above[t, n] = -r.best.feature, r.best.above
            for child, held in ((2 * n, total - r.best.right), (2 * n + 1, np.array(r.best.right))):
                grown.share[t, child] = held / held.sum()
                if level + 1 < depth and np.count_nonzero(held) > 1:
                    nodes.append((t, child))
        nodes.sort()
    return ForestModel(grown, features)


class ForestModel(Model):
    """Adds ``probability``, the mean of the class shares of a row's leaves, and ``prediction``."""

    def __init__(self, trees: Trees, features: str):
        super().__init__()
        self.trees, self.features = trees, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.arrow_udf("array<double>")
        def shares(ids: pa.Array, counts: pa.Array) -> pa.Array:
            out = [np.zeros((0, trees.share.shape[2]))]
            for _, _, bags in _bags(ids, counts):
                node = _nodes(trees, bags)
                votes = sum(trees.share[t][node[:, t]] for t in range(node.shape[1]))
                out.append(votes / np.maximum(votes.sum(axis=1, keepdims=True), 1e-300))
            votes = np.concatenate(out)
            return arrow.as_lists(pa.array(votes.ravel()), np.full(len(votes), votes.shape[1]))

        bag = F.unwrap_udt(F.col(self.features))
        rows = dataset.withColumn("_shares", shares(bag["indices"], bag["values"]))
        return (rows.withColumn("probability", array_to_vector("_shares"))
                .withColumn("prediction", (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")).drop("_shares"))
