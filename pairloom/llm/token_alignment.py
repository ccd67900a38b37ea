"""Alignment of two tokenizers over whole texts, with corpus counts of the linked id pairs.

A byte-level BPE tokenizer (A) and a piece BPE model with byte fallback (B) read the same
bytes, a space before the text.  Tokens whose byte ranges overlap are linked.  Both
tokenizers treat a text as a row of units that begin with a space; a unit is aligned once per
task and whatever a document needs is a sum over its units.

Counts: the distinct pairs of the corpus get a minimal perfect hash; every chunk's counts
become dense vectors indexed by it and are summed in a tree; a second pass aligns the
documents again and looks the counts up, each behind a check of the stored key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.tables import durable, text_arrays
from pairloom.llm.token_counts import PRE_TOKEN

#: Hash ranges of the pairs: each is hashed, counted and summed on its own.  Two vocabularies
#: bound the pairs, so a range is bounded too.
SHARDS = 256
#: Vectors that one step of the tree adds up.
FAN = 32
#: Documents cut at a time, and units and links a task remembers before it starts anew.
SLICE, UNITS, LINKS = 400, 300_000, 3_000_000
#: Units that go through the tokenizers in one text.
JOINED = 256
#: Bytes of the count table that tasks get at a time; a larger table is looked up in sections,
#: one pass over the documents each.
SECTION_BYTES = 128 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
# Texts without these are cut at every space; the others at spaces that begin a run of white space.
_RUN = re.compile(r" (?<=\s )")
_UNIT_START = regex.compile(r"(?<=\P{White_Space}) ")


class Aligner:
    """Units of texts with their tokens, groups and links; remembers a bounded number."""

    def __init__(self, path_a: str, path_b: str, with_groups: bool = True, by_rank: bool = False):
        import sentencepiece
        from tokenizers import Tokenizer

        self.with_groups = with_groups
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        of_char = _byte_alphabet()
        self.bytes_a = {i: bytes(of_char[c] for c in t) if all(c in of_char for c in t) else t.encode()
                        for t, i in self.a.get_vocab().items()}
        self.ranked = _ranked(self.a, self.bytes_a) if by_rank else None
        self.width_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.width_a[i] = len(x)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Units stand alone only if no piece reaches over the space that begins the next one, and
        # A cuts texts at spaces by its byte-level pattern.
        with open(path_a, encoding="utf-8") as f:
            cut = json.load(f)
        plain = cut.get("normalizer") is None and (cut.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.by_unit = plain and not any(regex.search(r"[^▁\p{White_Space}]▁", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = np.zeros((0, 4), np.int64)
        self.whole = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        """Units of a text without their leading space: cut at each space that follows no white
        space.  A single space at the end stays with the unit before it."""
        if not self.by_unit:
            return [text]
        if text[0] != " " and text[-1] != " " and not _RUN.search(text):
            return text.split(" ")
        out = _UNIT_START.split(text)
        if out[-1] == "" and len(out) > 1:
            out[-2:] = [out[-2] + " "]
        return out

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether both give the bytes back."""
        spaced = [" " + t for t in texts]
        ids_a = ([self.ranked.encode_ordinary(t) for t in spaced] if self.ranked else
                 [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        ids_b = self.b.encode(texts, num_threads=1)
        a, b = self.bytes_a, self.bytes_b
        whole = [b"".join([a[i] for i in x]) == (u := b" " + t.encode()) and b"".join([b[i] for i in y]) == u
                 for t, x, y in zip(texts, ids_a, ids_b)]
        return ids_a, ids_b, whole

    def learn(self, new: list[str]) -> None:
        """Align units that are not known yet.  Many go through the tokenizers in one text; a unit
        that ends in white space would meet the next one's space and stands alone."""
        plain = [u for u in new if u and "▁" not in u and not u[-1].isspace()] if self.by_unit else []
        joined = [" ".join(plain[at:at + JOINED]) for at in range(0, len(plain), JOINED)]
        ids_a, ids_b, ok = self._encoded(joined)
        if not all(ok):
            plain, ids_a, ids_b = [], [], []
        known = set(plain)
        alone = [u for u in new if u not in known]
        more_a, more_b, ok = self._encoded(alone)
        ids_a += [x if good else [] for x, good in zip(more_a, ok)]
        ids_b += [x if good else [] for x, good in zip(more_b, ok)]
        new, whole = plain + alone, np.array([True] * len(plain) + ok, bool)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ids_a, ids_b))
        # The units' bytes in a row: both sides have the same total after each unit.
        unit_end = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in new), np.int64, len(new)) * whole)
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        unit_a, unit_b = (np.searchsorted(unit_end, x, "left") for x in (end_a, end_b))
        lo = np.searchsorted(end_b, end_a - self.width_a[a], "right")
        n_links = np.searchsorted(end_b, end_a, "left") - lo + 1
        of_a = np.repeat(np.arange(len(a)), n_links)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n_links) - n_links - lo, n_links)
        links = np.bincount(unit_a, n_links, len(new)).astype(np.int64)
        cut_a, cut_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        counts = [np.bincount(unit_a, minlength=len(new)), np.bincount(unit_b, minlength=len(new)),
                  np.bincount(unit_a[cut_a], minlength=len(new)), links]
        self.sums = np.vstack([self.sums, np.stack(counts, axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])
        self.whole = np.concatenate([self.whole, whole])
        end = int(self.first[-1])
        if end > len(self.links):
            self.links = np.resize(self.links, max(end, 2 * len(self.links)))
        self.links[end - len(of_a):end] = a[of_a] * len(self.bytes_b) + b[of_b]
        if self.with_groups:
            self.groups += self._groups(a, b, cut_a, cut_b, np.cumsum(counts[0] + counts[1]))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))

    def _groups(self, a, b, cut_a, cut_b, ends) -> list[str]:
        """``a1,a2|b1;a3|b2;`` of every unit, whose tokens end at ``ends``."""
        # All A tokens of a group, then its B tokens.
        group = np.concatenate([np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        kind = np.concatenate([cut_a, 2 + cut_b])[order].tolist()
        text, mark = list(map(str, np.concatenate([a, b])[order].tolist())), (",", "|", ",", ";")
        text = [t + mark[k] for t, k in zip(text, kind)]
        return ["".join(text[lo:hi]) for lo, hi in zip([0, *ends.tolist()], ends.tolist())]

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray | None], int]:
        """Unit numbers of each text, in order; None for a text without tokens.  Second, the
        number of units known before."""
        if len(self.at) > UNITS or self.first[-1] > LINKS:
            self.clear()
        before, cut = len(self.at), [self.units(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(u for x in cut for u in x if u not in self.at)):
            self.learn(new)
        get, out = self.at.__getitem__, []
        for text, units in zip(texts, cut):
            ids = np.fromiter(map(get, units), np.int64, len(units))
            out.append(ids if len(ids) and "▁" not in text and self.whole[ids].all() else None)
        return out, before


def _ranked(tokenizer, token_bytes: dict[int, bytes]):
    """The same vocabulary as an encoder by rank, a few times as fast."""
    import tiktoken

    special = {i for i, x in tokenizer.get_added_tokens_decoder().items()}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKEN, special_tokens={},
                             mergeable_ranks={x: i for i, x in token_bytes.items() if i not in special})


def merges_by_rank(path: str) -> bool:
    """Does an encoder by rank give the tokenizer's ids?  Its merges must stand in the order of
    the ids they make, and both must agree on every entry that is a text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
    made = [model["vocab"].get("".join(x), -1) for x in merges]
    if model.get("type") != "BPE" or model.get("ignore_merges") or any(x >= y for x, y in zip(made, made[1:])):
        return False
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of_char = _byte_alphabet()
    known = {i: bytes(of_char[c] for c in t) for t, i in model["vocab"].items() if all(c in of_char for c in t)}
    texts = []
    for x in known.values():
        try:
            texts.append(x.decode())
        except UnicodeDecodeError:  # part of a character
            continue
    ranked = _ranked(tokenizer, known)
    return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] == list(map(ranked.encode_ordinary, texts))


def _byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


def _spans(first: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of each unit, and how many each has."""
    n = first[units + 1] - first[units]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[units], n), n


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    x = (keys.astype(np.uint64) + np.uint64(level + 1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, -1) >> np.uint64(20)) % np.uint64(SHARDS)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits per level, bitmap) of a minimal perfect hash of distinct keys.

    On each level a key takes the bit that its hash names, if no other key names it; the rest
    goes to the next level.  The place of a key is the number of bits before its own.
    """
    sizes, maps = [], []
    while len(keys):
        size = 64 * (len(keys) // 32 + 1)
        slot = _hash(keys, len(sizes)) % np.uint64(size)
        alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        maps.append(np.packbits(alone, bitorder="little").view(np.uint64))
        keys = keys[~alone[slot.astype(np.int64)]]
    return np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, np.uint64)


class Places:
    """Place of each key in a table of shards, -1 for a key that is not in it."""

    def __init__(self, shards: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        """``shards``: (number, bits per level, bitmap, keys in the order of their places)."""
        levels = max((len(x[1]) for x in shards), default=0)
        self.size = np.zeros((levels, SHARDS), np.uint64)
        self.start = np.zeros((levels, SHARDS), np.uint64)
        at = 0
        for number, sizes, _, _ in shards:
            for level, size in enumerate(sizes.tolist()):
                self.size[level, number], self.start[level, number] = size, at
                at += size
        self.words = np.concatenate([x[2] for x in shards]) if shards else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = None if any(x[3] is None for x in shards) else np.concatenate([x[3] for x in shards] or [np.zeros(0, np.int64)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, shard = np.arange(len(keys)), shard_of(keys).astype(np.int64)
        for level in range(len(self.size)):
            size = self.size[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.start[level, shard[left]] + _hash(keys[left], level) % size
            word = (bit >> np.uint64(6)).astype(np.int64)
            low = (np.uint64(1) << (bit & np.uint64(63)))
            hit = self.words[word] & low != 0
            inside = np.bitwise_count(self.words[word[hit]] & (low[hit] - np.uint64(1)))
            out[left[hit]] = self.before[word[hit]] + inside
            left = left[~hit]
        if self.keys is not None:
            found = out >= 0
            out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


def _pair_counts(rows: DataFrame, path_a: str, path_b: str, by_rank: bool) -> DataFrame:
    """(chunk, shard, pairs, counts): of each batch of documents, how many hold a pair linked."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(path_a, path_b, with_groups=False, by_rank=by_rank), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            seen = []
            for piece in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                units, _ = aligner.read(piece.column("_text").to_pylist())
                units = [np.unique(x) for x in units if x is not None]
                if units:
                    at, n = _spans(aligner.first, np.concatenate(units))
                    doc = np.repeat(np.repeat(np.arange(len(units)), [len(x) for x in units]), n)
                    pairs = np.unique((doc << 48) | aligner.links[at]) & ((1 << 48) - 1)
                    seen.append(np.unique(pairs, return_counts=True))
            if not seen:
                continue
            pairs, place = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([x[1] for x in seen])).astype(np.int64)
            shard = shard_of(pairs).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            numbers, at = np.unique(shard[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(numbers), (part << 24) + number)), pa.array(numbers, pa.int32()),
                 text_arrays(np.split(pairs[order], at[1:]), pa.int64()),
                 text_arrays(np.split(counts[order], at[1:]), pa.int64())], names=["chunk", "shard", "pairs", "counts"])

    return rows.select("_text").mapInArrow(count, "chunk long, shard int, pairs array<long>, counts array<long>")


def _hash_shard(table: pa.Table) -> pa.Table:
    keys = table.column("pair").to_numpy().astype(np.int64)
    sizes, bits = perfect_hash(keys)
    number = table.column("shard")[0].as_py()
    ordered = np.zeros(len(keys), np.int64)
    ordered[Places([(number, sizes, bits, None)])(keys)] = keys
    return pa.table({"shard": pa.array([number], pa.int32()), "sizes": text_arrays([sizes], pa.int64()),
                     "bits": pa.array([bits.tobytes()]), "keys": pa.array([ordered.tobytes()])})


def _unpack(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return (row["shard"], np.asarray(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64),
            np.frombuffer(row["keys"], np.int64))


def _dense(chunks: pa.Table, hashed: pa.Table) -> pa.Table:
    """One vector over a shard's places from the counts of some chunks."""
    if not chunks.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "lane": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    shard = _unpack(hashed.to_pylist()[0])
    place, total = Places([shard]), np.zeros(len(shard[3]), np.int64)
    for i in range(chunks.num_rows):
        pairs = chunks.column("pairs")[i].values.to_numpy().astype(np.int64)
        total[place(pairs)] += chunks.column("counts")[i].values.to_numpy()
    return pa.table({"shard": chunks.column("shard")[:1], "lane": chunks.column("lane")[:1], "counts": pa.array([total.tobytes()])})


def _add(vectors: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in vectors.column("counts"))
    return pa.table({"shard": vectors.column("shard")[:1], "lane": vectors.column("lane")[:1], "counts": pa.array([total.tobytes()])})


def count_table(rows: DataFrame, path_a: str, path_b: str, by_rank: bool = False) -> DataFrame:
    """(shard, sizes, bits, keys, counts): the hashed pairs of all documents and how many
    documents hold each, stored."""
    chunks = durable(_pair_counts(rows, path_a, path_b, by_rank))
    pairs = chunks.select("shard", F.explode("pairs").alias("pair")).distinct()
    hashed = durable(pairs.groupBy("shard").applyInArrow(
        _hash_shard, "shard int, sizes array<long>, bits binary, keys binary"))
    lanes = max(1, -(-chunks.select("chunk").distinct().count() // FAN))
    laned = chunks.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int"))
    copies = hashed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    form = "shard int, lane int, counts binary"
    vectors = laned.groupBy("shard", "lane").cogroup(copies.groupBy("shard", "lane")).applyInArrow(_dense, form)
    while lanes > 1:
        lanes = -(-lanes // FAN)
        vectors = (durable(vectors).withColumn("lane", F.pmod("lane", F.lit(lanes)).cast("int"))
                   .groupBy("shard", "lane").applyInArrow(_add, form))
    return durable(hashed.join(vectors.drop("lane"), "shard"))


def _best_counts(table: DataFrame, ids_b: int) -> np.ndarray:
    """Highest count of each A id; as many as the vocabulary has."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                ids = np.frombuffer(keys, np.int64) // ids_b
                most = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
                np.maximum.at(most, ids, np.frombuffer(counts, np.int64))
                at = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at])], names=["a", "n"])

    rows = (table.select("keys", "counts").mapInArrow(best, "a int, n long")
            .groupBy("a").agg(F.max("n").alias("n")).collect())
    out = np.zeros(max((r.a for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.a] = r.n
    return out


def _sections(table: DataFrame) -> list[list[int]]:
    """Shards in groups whose tables stay below SECTION_BYTES; one shard at least."""
    sizes = table.select("shard", (F.octet_length("keys") + F.octet_length("counts") + 2 * F.octet_length("bits")).alias("n"))
    out, room = [[]], SECTION_BYTES
    for row in sizes.orderBy("shard").collect():
        if row.n > room and out[-1]:
            out.append([])
            room = SECTION_BYTES
        out[-1].append(row.shard)
        room -= row.n
    return out


_DOCUMENT = "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(rows: DataFrame, path_a: str, path_b: str, by_rank: bool, section: list, best: np.ndarray,
             keep_text: bool) -> DataFrame:
    """Align the documents again and add up the counts of the links in one section."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(([_unpack(r.asDict()) for r in section],
                                np.concatenate([np.frombuffer(r.counts, np.int64) for r in section] or [np.zeros(0, np.int64)]), best))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, counts, best = shared.value
        place, aligner = Places(shards), Aligner(path_a, path_b, by_rank=by_rank)
        ids_b, of_unit = len(aligner.bytes_b), np.zeros((0, 2), np.int64)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = batch.column("_text").to_pylist()
            units, before = aligner.read(texts)
            fresh = np.arange(before, len(aligner.at))
            at, n = _spans(aligner.first, fresh)
            links = aligner.links[at]
            where = place(links)
            found = where >= 0
            count = np.zeros(len(links), np.int64)
            count[found] = counts[where[found]]
            is_best = found & (count == best[np.minimum(links // ids_b, len(best) - 1)]) if len(best) else found
            running = np.zeros((len(links) + 1, 2), np.int64)
            np.cumsum(np.stack([is_best.astype(np.int64), count], axis=1), axis=0, out=running[1:])
            end = np.cumsum(n)
            of_unit = np.vstack([of_unit[:before], running[end] - running[end - n]])
            sums, digests = np.zeros((len(texts), 6), np.int64), []
            for i, ids in enumerate(units):
                if ids is None:
                    digests.append("")
                    continue
                sums[i, :4] = aligner.sums[ids].sum(axis=0)
                sums[i, 4:] = of_unit[ids].sum(axis=0)
                digests.append(hashlib.sha256("".join([aligner.groups[u] for u in ids.tolist()])[:-1].encode()).hexdigest())
            sums[:, 4:] += np.stack([batch.column(c).to_numpy() for c in ("n_best", "count_sum")], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(sums[:, j]) for j in range(6)], pa.array(digests, pa.string()),
                 *([batch.column("_text")] if keep_text else [])],
                names=["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["_text"] * keep_text])

    return rows.select("_id", "_text", "n_best", "count_sum").mapInArrow(look, _DOCUMENT + ", _text string" * keep_text)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its tokens, groups and links, and the corpus counts of its links.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their A id, ties included), count_sum (over all links), groups_sha256.

    A pair counts once per document row that holds it linked; repeated rows and null ids are
    documents of their own.  A null or empty text, or one that a tokenizer does not give back
    byte by byte, has no tokens: zeros and an empty digest.  Whole texts are aligned, however
    long.  An empty table gives an empty result.  Other columns are not read, so their names
    cannot clash.

    Both paths must exist on every node.  The pairs are bounded by the product of the two
    vocabularies; their table goes to the tasks in sections of at most SECTION_BYTES.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"),
                       F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    by_rank = merges_by_rank(path_a)
    table = count_table(rows, path_a, path_b, by_rank)
    best = _best_counts(table, _size_b(path_b))
    sections = _sections(table)
    for i, shards in enumerate(sections):
        last = i == len(sections) - 1
        rows = _look_up(rows, path_a, path_b, by_rank, table.where(F.col("shard").isin(shards)).orderBy("shard").collect(), best, not last)
        rows = rows if last else durable(rows)
    return rows.withColumnRenamed("_id", "doc_id")


def _size_b(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
