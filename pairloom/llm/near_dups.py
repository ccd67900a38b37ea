"""MinHash near-duplicates by an inverted join over signature coordinates.

Every different shingle set is posted under its (coordinate, value) pairs.  Two sets of
similarity 0.75 agree in most coordinates, so a pair that agrees in at least ``MATCHES``
of the ``POSTED`` coordinates must meet in the rarest POSTED - MATCHES + 1 of them (prefix);
pairs whose list is theirs alone are skipped altogether.  Lists are compared in tiles of
bounded size, collisions are counted on whole signatures, and each link is confirmed on
the full shingle sets before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import connected_components
from pairloom.llm.tables import bitmap_of, durable, in_bitmap, text_arrays

WORDS = 5
#: Similarity of a link as a fraction of whole numbers: 100 * common >= 75 * union.
SIMILAR = (75, 100)
#: Coordinates of a signature, and how many of them two linked sets share.  At similarity
#: 0.75 the number shared is binomial (64, 0.75): less than 31 happens once in 10 million.
COORDINATES, SHARED = 64, 31
#: The first coordinates are posted: less than 4 of 16 shared happens four times in a million.
POSTED, MATCHES = 16, 4
#: Members of one list that a task compares with as many others.
TILE = 1024

#: Fixed odd multipliers: of the five word positions, and of the coordinates (from a seed).
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                      0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text.

    A-Z are lower-cased and words are what ASCII white space separates.  Fewer than
    five words make one shingle; a text without words has none.  ``known`` keeps the
    hashes of words seen before in the task.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > 400_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = _word_hash(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < WORDS:
        return _mix((h * _POSITION[:len(h)]).sum(dtype=np.uint64, keepdims=True)
                    + np.uint64(len(h)))
    last = len(h) - WORDS + 1
    s = h[:last] * _POSITION[0]
    for k in range(1, WORDS):
        s = s + h[k:last + k] * _POSITION[k]
    return np.unique(_mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest value of every coordinate's hash over the set, as 32-bit numbers."""
    out = np.empty(COORDINATES, dtype=np.uint64)
    for start in range(0, COORDINATES, 8):
        out[start:start + 8] = (s * _MULTIPLY[start:start + 8, None]).min(axis=1)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row for row: id, text key, shingle count, set key and signature (null without shingles)."""
    known: dict[bytes, int] = {}
    for batch in batches:
        n, keys, sigs = [], [], []
        for text in batch.column("_text"):
            s = shingle_set(text.as_py(), known)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_key"), pa.array(n, pa.int64()),
             pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            names=["_id", "_key", "_n", "_set", "_sig"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``names`` into whole groups."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for name in names:
            c = batch.column(name).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        if kept and any(kept[-1].column(x)[-1].as_py() != batch.column(x)[0].as_py() for x in names):
            yield pa.Table.from_batches(kept)
            kept = []
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
            kept.append(batch.slice(start, end - start))
            if i < len(cuts) - 2:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


TILE_KEY = ["_k", "_v", "_i", "_j"]


class _Tile:
    """Pairs of one tile that share enough coordinates and have this list as their first."""

    def __init__(self, rows: pa.Table):
        k, self.i, self.j = (rows.column(x)[0].as_py() for x in ("_k", "_i", "_j"))
        column = lambda x: rows.column(x).to_numpy()
        self.ids, self.n, own, block = column("_cid"), column("_n"), column("_prefix"), column("_b")
        self.sig = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), dtype=np.int32
                                 ).reshape(-1, COORDINATES)
        left = np.flatnonzero(block == self.i)
        right = np.flatnonzero(block == self.j)
        self.pairs = self._pairs(left, right, own, k)

    def _pairs(self, left, right, own, k):
        found = []
        for at, a in enumerate(left):
            b = right[right > a] if self.i == self.j else right
            if not len(b):
                continue
            b = b[SIMILAR[1] * np.minimum(self.n[a], self.n[b]) >= SIMILAR[0] * np.maximum(self.n[a], self.n[b])]
            equal = self.sig[b] == self.sig[a]
            b, equal = b[(many := equal.sum(axis=1) >= SHARED)], equal[many]
            if k and len(b):  # the pair belongs to the first list in which both are posted
                first = (own[b] & own[a])[:, None] >> np.arange(k) & 1
                b = b[~((first == 1) & equal[:, :k]).any(axis=1)]
            found += [(a, x) for x in b]
        return found


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each tile that have a partner in it: one row a member at most."""
    for rows in _groups(batches, TILE_KEY):
        if rows.num_rows < 2:
            continue
        tile = _Tile(rows)
        if tile.pairs:
            members = np.unique(np.array(tile.pairs))
            yield from rows.take(pa.array(members)).combine_chunks().to_batches()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each tile, confirmed on the full sets: a spanning forest of them.

    A pair that is connected within the tile already needs no test, since only
    components count; every other pair is tested.
    """
    for rows in _groups(batches, TILE_KEY):
        tile, links = _Tile(rows), []
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("_shingles").to_pylist()]
        root = list(range(rows.num_rows))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in tile.pairs:
            if (ra := find(a)) != (rb := find(b)):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if SIMILAR[1] * both >= SIMILAR[0] * (len(sets[a]) + len(sets[b]) - both):
                    root[rb] = ra
                    links.append((tile.ids[a], tile.ids[b]))
        if links:
            a, b = np.array(links, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _tiles(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings with signatures, copied to the tiles of their list, a tile's rows together."""
    last = F.ceil(F.col("_count") / F.lit(TILE)).cast("int") - 1
    own = F.pmod(F.xxhash64("_cid"), last + 1).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(
        F.least(x, F.col("_b")).alias("_i"), F.greatest(x, F.col("_b")).alias("_j"))))
    spread = (postings.withColumn("_b", own).withColumn("_tile", tile)
              .select("_cid", "_k", "_v", "_prefix", "_b", "_tile._i", "_tile._j"))
    return spread.join(classes.select("_cid", "_sig", "_n"), "_cid")


def _sorted_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "_cid")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Component of near-duplicates for every row of ``docs``.

    Columns: doc_id, n_shingles, component_id (smallest id reachable over links), kept
    (doc_id = component_id), text_key (64-bit hash of the text, to find the row again).

    Equal sets are one class from the start, so copies never meet in a list; a class
    that holds a third of all rows is one node.  Lists of any length are compared in full,
    in tiles of TILE by TILE members.  Texts without words (null, empty, white space) have
    no shingles, no links and their own id as component.  Rows with a null id take part by
    their text; a component without any id has a null component_id, and such rows are
    kept.  Repeated rows give repeated results.  An empty table gives an empty result.
    """
    rows = durable(
        docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_key"),
                    F.col(text).cast("string").alias("_text"))
        .mapInArrow(_describe, "_id long, _key long, _n long, _set binary, _sig binary"))
    classes = durable(
        rows.where("_n > 0").groupBy("_set")
        .agg(F.min("_id").alias("_least"), F.min("_key").alias("_key"), F.first("_n").alias("_n"),
             F.first("_sig").alias("_sig"))
        .withColumn("_cid", F.monotonically_increasing_id()))

    postings = classes.select("_cid", F.posexplode(_coordinates()).alias("_k", "_v"))
    counts = postings.groupBy("_k", "_v").agg(F.count("*").alias("_count")).where("_count > 1")
    # Values are kept together with their list's length; lists of one are skipped.  Counts are
    # stored, so that both sides of the join are shuffled for it and hot values can be split.
    shared = (postings.join(durable(counts), ["_k", "_v"])
              .groupBy("_cid").agg(F.sort_array(F.collect_list(F.struct("_count", "_k", "_v"))).alias("_all"))
              .where(F.size("_all") >= MATCHES)
              .select("_cid", F.slice("_all", 1, F.size("_all") - MATCHES + 1).alias("_rarest")))
    mask = F.aggregate("_rarest", F.lit(0), lambda acc, x: acc.bitwiseOR(
        F.call_function("shiftleft", F.lit(1), x["_k"])))
    prefixes = durable(shared.select("_cid", mask.alias("_prefix"), F.explode("_rarest").alias("_x"))
                       .select("_cid", "_prefix", "_x.*"))

    shape = "_cid long, _k int, _v int, _prefix int, _b int, _i int, _j int, _sig binary, _n long"
    meeting = durable(
        _sorted_tiles(_tiles(prefixes, classes).select(*[c.split()[0] for c in shape.split(", ")]))
        .mapInArrow(_meeting, shape))
    sets = _sets_of(docs, text, classes.join(meeting.select("_cid").distinct(), "_cid", "left_semi"))
    links = durable(
        _sorted_tiles(meeting.join(sets, "_cid")).mapInArrow(_confirm, "a long, b long"))

    roots = connected_components(links)
    of_class = classes.select("_cid", "_set", "_least").join(
        roots, F.col("_cid") == F.col("node"), "left").select(
        "_set", "_least", F.coalesce("root", "_cid").alias("_root"))
    of_class = durable(of_class)
    least = of_class.groupBy("_root").agg(F.min("_least").alias("_component"))
    of_set = of_class.join(durable(least), "_root").select("_set", "_component")
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    return (rows.join(of_set, "_set", "left")
            .select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
                    component.alias("component_id"), F.col("_key").alias("text_key"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _coordinates():
    """The posted coordinates of a signature as whole numbers."""
    word = lambda i: F.conv(F.hex(F.substring("_sig", 4 * i + 1, 4)), 16, 10).cast("long")
    return F.array(*[(word(i) - F.lit(1 << 31)).cast("int") for i in range(POSTED)])


def _sets_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted classes, made anew from a text of each.

    A fixed-size bitmap of the wanted texts' keys lets tasks skip other texts; the join on
    key and set afterwards is exact.
    """
    wanted = durable(wanted.select("_cid", "_key", "_set"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "_key"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            key = batch.column("_key").to_numpy()
            rows, first = [], np.unique(key, return_index=True)[1]
            for i in first[in_bitmap(bits.value, key[first])]:
                s = shingle_set(batch.column("_text")[i].as_py(), known)
                if len(s):
                    rows.append((int(key[i]), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()))
            for start in range(0, len(rows), 500):
                part = list(zip(*rows[start:start + 500]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()),
                     pa.array(part[2], pa.binary())], names=["_key", "_set", "_shingles"])

    made = (docs.select(F.xxhash64(text).alias("_key"), F.col(text).cast("string").alias("_text"))
            .mapInArrow(make, "_key long, _set binary, _shingles binary"))
    # One text per class: copies of it in other batches give the same set once more.
    return (made.join(wanted, ["_key", "_set"]).groupBy("_cid")
            .agg(F.first("_shingles").alias("_shingles")))
