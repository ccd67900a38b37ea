"""Word bigram model of a corpus: a hierarchical Pitman-Yor process.

Every context (the word before, hashed to one of CONTEXTS) is a restaurant; all of them share
one parent restaurant over words, whose base is uniform.  Seatings are sampled by Gibbs sweeps
and the predictive probabilities of the samples are averaged.

Words are dealt to buckets by hash, so everything that belongs to a word - its cells (word,
context), their tables and its tables in the parent - lies in one row.  Between buckets only
the number of tables per context, a vector of fixed length, and two totals are exchanged, once
a sweep; within a sweep they and the parent's probabilities stay as they were at its start.
Texts are cut twice, once to learn and once to score, and are never stored.
"""

from __future__ import annotations

import pickle
import random
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.tables import durable

CONTEXT_BITS, DOC_BITS = 16, 12
#: Context restaurants: a previous word has one of its own but for hash collisions.
CONTEXTS = 1 << CONTEXT_BITS
#: Text of one bucket of words and of one group of chunks, and the least number of buckets.
BUCKET_BYTES, GROUP_BYTES, LEAST_BUCKETS = 24 << 20, 1 << 30, 16
CHUNK_DOCS, CHUNK_BYTES = 1 << DOC_BITS, 16 << 20
#: Sweeps before the first sample, and samples that are averaged.
BURN_IN, SAMPLES, SEED = 2, 3, 13
#: Customers that a sweep moves together, and cells below which it moves them one by one.
SWEEP_CUSTOMERS, FEW_CELLS = 1 << 22, 32
#: Strengths of the context restaurants and of their parent.
CONTEXT_STRENGTH, WORD_STRENGTH = 1.0, 1.0


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value, byte planes apart."""
    parts = {k: (a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
             for k, a in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {k: np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).reshape(n)
            for k, (kind, n, x) in parts.items()}


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Entries(NamedTuple):
    """Tokens of some documents: distinct words by hash, and per token its word, context and document."""

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray


def entries(texts: list[str | None]) -> Entries:
    """All tokens of whole texts.  The empty word stands for the end, and for what precedes a text."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    end, number, flat, sizes = seen[b""], seen.__getitem__, [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        flat.extend(map(number, words))
        flat.append(end)
        sizes.append(len(words) + 1)
    now = np.array(flat, np.int64)
    del flat
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    before = np.roll(now, 1)  # the last token is an end too
    context = (hashes & np.uint64(CONTEXTS - 1)).astype(np.int64)
    return Entries(hashes[order], rank[now], context[before], np.repeat(np.arange(len(sizes)), sizes), np.array(sizes, np.int64))


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each word hash; grows with the hash."""
    return (((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _by_bucket(words: np.ndarray, key: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(bucket, its slice of the sorted keys, its words, keys per word)."""
    word = key >> bits
    bucket = _bucket(words, buckets)[word]
    numbers, first = np.unique(bucket, return_index=True)
    for number, lo, hi in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(key)]):
        own, per = np.unique(word[lo:hi], return_counts=True)
        yield number, slice(lo, hi), words[own], per.astype(np.uint32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered batches of at most CHUNK_DOCS documents and about CHUNK_BYTES."""
    number = TaskContext.get().partitionId() << 28
    for batch in batches:
        step = max(1, min(CHUNK_DOCS, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield number, batch.slice(at, step)
            number += 1


def _deal(chunk: int, n: int) -> int:
    """One of ``n`` places for a chunk."""
    return xxhash.xxh32_intdigest(chunk.to_bytes(8, "little")) % n


class Plan(NamedTuple):
    """How words and chunks are dealt; derived from the bytes of all texts."""

    buckets: int
    groups: int


def plan(rows: DataFrame) -> Plan:
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    return Plan(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), -(-size // GROUP_BYTES) or 1)


def _merge(rows: pa.Table) -> pa.Table:
    """Add up the cells of one bucket."""
    parts = [unpack(x.as_py()) for x in rows.column("payload")]
    words = np.unique(np.concatenate([p["words"] for p in parts]))
    key = np.concatenate([(np.repeat(np.searchsorted(words, p["words"]), p["per"]) << CONTEXT_BITS) | p["context"] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([p["n"].astype(np.int64) for p in parts])[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n, key = np.add.reduceat(n, first), key[first]
    data = pack(words=words, per=np.bincount(key >> CONTEXT_BITS, minlength=len(words)).astype(np.uint32),
                context=(key & (CONTEXTS - 1)).astype(np.uint16), n=n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64))
    return pa.table({"bucket": rows.column("bucket")[:1], "lane": rows.column("lane")[:1], "payload": pa.array([data], pa.binary())})


def learn_cells(rows: DataFrame, dealt: Plan) -> DataFrame:
    """(bucket, payload): how often each word follows each context in the texts learned from."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in _chunks(batches):
            e = entries(batch.column("_text").to_pylist())
            key, n = np.unique((e.word << CONTEXT_BITS) | e.context, return_counts=True)
            out = [(b, pack(words=words, per=per, context=(key[at] & (CONTEXTS - 1)).astype(np.uint16), n=n[at].astype(np.uint32)))
                   for b, at, words, per in _by_bucket(e.words, key, CONTEXT_BITS, dealt.buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([_deal(chunk, dealt.groups)] * len(out), pa.int32()),
                 pa.array([x[1] for x in out], pa.binary())], names=["bucket", "lane", "payload"])

    form = "bucket int, lane int, payload binary"
    cells = rows.where("not _held").select("_text").mapInArrow(cut, form).groupBy("bucket", "lane").applyInArrow(_merge, form)
    lanes = dealt.groups
    while lanes > 1:  # a common word's cells come from every group of chunks
        lanes = -(-lanes // 32)
        cells = (durable(cells).withColumn("lane", F.pmod("lane", F.lit(lanes)).cast("int"))
                 .groupBy("bucket", "lane").applyInArrow(_merge, form))
    return durable(cells.drop("lane"))


def seat(rng: np.random.Generator, customers: np.ndarray, new: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(tables per cell, customers per table): customers come in one by one, in doubling blocks.

    ``new`` weighs a new table, as a table weighs its customers less the discount.
    """
    tables, seated = np.minimum(customers, 1).astype(np.int64), np.minimum(customers, 1).astype(np.int64)
    while (open_ := np.flatnonzero(seated < customers)).size:
        step = np.minimum(seated[open_], customers[open_] - seated[open_])
        weight = seated[open_] + (step - 1) / 2 - discount * tables[open_]
        tables[open_] += rng.binomial(step, new[open_] / (weight + new[open_]))
        seated[open_] += step
    cell = np.repeat(np.arange(len(tables)), tables)
    share = rng.gamma(1 - discount, size=len(cell)) + 1e-12
    share *= ((customers - tables) / np.maximum(np.bincount(cell, share, len(tables)), 1e-12))[cell]
    sizes = 1 + np.floor(share).astype(np.int64)
    first = (np.cumsum(tables) - tables)[tables > 0]
    sizes[first] += (customers - np.bincount(cell, sizes, len(tables)).astype(np.int64))[tables > 0]
    return tables, sizes


def sweep(rng: np.random.Generator, customers: np.ndarray, new: np.ndarray, discount: float, tables: np.ndarray,
          sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over many cells at once: (tables per cell, customers per table).

    Every customer of every cell leaves once and sits down again.  Cells go in blocks of about
    SWEEP_CUSTOMERS, the largest first.
    """
    order = np.argsort(-customers, kind="stable")
    before, block = np.cumsum(tables) - tables, np.cumsum(customers[order]) // SWEEP_CUSTOMERS
    cells, seated = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in np.split(order, np.flatnonzero(np.diff(block)) + 1):
        t = tables[own]
        inside = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        cell, n = _sweep_block(rng, customers[own], new[own], discount, t, sizes[np.repeat(before[own], t) + inside])
        cells.append(own[cell])
        seated.append(n)
    cell = np.concatenate(cells)
    return np.bincount(cell, minlength=len(tables)), np.concatenate(seated)[np.argsort(cell, kind="stable")]


def _sweep_block(rng: np.random.Generator, c: np.ndarray, a: np.ndarray, discount: float, t: np.ndarray,
                 sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, customers) of each table after a sweep over cells sorted by falling customers.

    An old table is found by its customers: the table of a random other one is drawn in
    proportion to its customers and taken in proportion to (customers - discount) / customers.
    """
    room, first = t + c, np.cumsum(c) - c
    start = np.cumsum(room) - room
    slots = np.arange(int(t.sum())) + np.repeat(start - (np.cumsum(t) - t), t)
    n = np.zeros(int(room.sum()), np.int64)
    n[slots] = sizes
    place, unused, live, move = np.repeat(slots, sizes), start + t, t.copy(), 0
    while (k := int(np.searchsorted(-c, -move, "left"))) >= FEW_CELLS:
        at = first[:k] + move
        left = place[at]
        n[left] -= 1
        live[:k] -= n[left] == 0
        own = c[:k] - 1 - discount * live[:k]
        opened = rng.random(k) * (own + a[:k]) >= own
        table = unused[:k].copy()
        unused[:k] += opened
        live[:k] += opened
        todo = np.flatnonzero(~opened)
        while todo.size:
            other = (rng.random(len(todo)) * (c[todo] - 1)).astype(np.int64)
            drawn = place[first[todo] + other + (other >= move)]
            taken = rng.random(len(todo)) * n[drawn] < n[drawn] - discount
            table[todo[taken]] = drawn[taken]
            todo = todo[~taken]
        place[at] = table
        n[table] += 1
        move += 1
    draw = random.Random(int(rng.integers(1 << 62))).random
    for i in range(k):  # what is left of the largest cells, one by one
        low, total = int(start[i]), int(c[i])
        held = n[low:low + int(room[i])].tolist()
        _sweep_cell(draw, held, (place[int(first[i]):int(first[i]) + total] - low).tolist(), move, float(a[i]), discount,
                    int(unused[i]) - low, int(live[i]))
        n[low:low + int(room[i])] = held
    kept = np.flatnonzero(n)
    return np.repeat(np.arange(len(room)), room)[kept], n[kept]


def _sweep_cell(draw, held: list[int], place: list[int], move: int, a: float, discount: float, unused: int, live: int) -> None:
    """Customers ``move`` and on of one cell leave and sit down again; ``held`` has the customers per table."""
    others = len(place) - 1
    for customer in range(move, others + 1):
        left = place[customer]
        held[left] -= 1
        live -= held[left] == 0
        own = others - discount * live
        if draw() * (own + a) >= own:
            table, unused, live = unused, unused + 1, live + 1
        else:
            while True:
                other = int(draw() * others)
                table = place[other + (other >= customer)]
                if draw() * held[table] < held[table] - discount:
                    break
        place[customer] = table
        held[table] += 1


class Totals(NamedTuple):
    """What a sweep knows of all buckets: discounts, words, and the tables and customers at its start."""

    context_discount: float
    word_discount: float
    words: int
    tables: np.ndarray
    parent_customers: int
    parent_tables: int

    def parent(self, customers: np.ndarray | int, tables: np.ndarray | int) -> np.ndarray:
        """The parent's probability of a word with these customers and tables there."""
        whole = WORD_STRENGTH + self.parent_customers
        spare = (WORD_STRENGTH + self.word_discount * self.parent_tables) / whole / (self.words + 1)
        return (customers - self.word_discount * tables) / whole + spare


def _start(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Seating of a bucket before the first sweep: every cell and word has one table.

    A cell of one customer has one table for good; only its number is kept.
    """
    word, rich = np.repeat(np.arange(len(cells["words"])), cells["per"]), cells["n"] > 1
    once = np.bincount(word[~rich], minlength=len(cells["words"]))
    customers = once + np.bincount(word[rich], minlength=len(once))
    return {"once": once, "per": np.bincount(word[rich], minlength=len(once)), "context": cells["context"][rich],
            "n": cells["n"][rich], "tables": np.ones(int(rich.sum()), np.int64), "sizes": cells["n"][rich],
            "customers": customers, "word_tables": np.ones(len(once), np.int64), "word_sizes": customers,
            "sampled": np.zeros(int(rich.sum()), np.int64)}


def _small(state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Whole numbers in the narrowest type."""
    return {k: a.astype(np.min_scalar_type(int(a.max(initial=0)))) for k, a in state.items()}


def _step(state: dict[str, np.ndarray], known: Totals, rng: np.random.Generator, first: bool, keep: int | None) -> dict[str, np.ndarray]:
    """One sweep over a bucket; ``keep`` numbers the sample that it gives."""
    s = {k: a.astype(np.int64) for k, a in state.items()}
    word = np.repeat(np.arange(len(s["once"])), s["per"])
    new = (CONTEXT_STRENGTH + known.context_discount * known.tables[s["context"]]) * known.parent(s["customers"], s["word_tables"])[word]
    if first:
        s["tables"], s["sizes"] = seat(rng, s["n"], new, known.context_discount)
    s["tables"], s["sizes"] = sweep(rng, s["n"], new, known.context_discount, s["tables"], s["sizes"])
    customers = s["once"] + np.bincount(word, s["tables"], len(s["once"])).astype(np.int64)
    base = np.full(len(customers), (WORD_STRENGTH + known.word_discount * known.parent_tables) / (known.words + 1))
    # Words whose customers changed are seated anew, the others keep their tables.
    changed = np.ones(len(customers), bool) if first else customers != s["customers"]
    tables, sizes = seat(rng, customers[changed], base[changed], known.word_discount)
    of_old, of_new = np.repeat(np.arange(len(customers)), s["word_tables"]), np.repeat(np.flatnonzero(changed), tables)
    stay = ~changed[of_old]
    of, every = np.concatenate([of_old[stay], of_new]), np.concatenate([s["word_sizes"][stay], sizes])
    s["word_sizes"], s["word_tables"] = every[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(customers))
    s["word_tables"], s["word_sizes"] = sweep(rng, customers, base, known.word_discount, s["word_tables"], s["word_sizes"])
    s["customers"] = customers
    if keep is not None:
        s["sampled"] = s["sampled"] + s["tables"]
        s[f"customers{keep}"], s[f"word_tables{keep}"] = s["customers"], s["word_tables"]
    return _small(s)


_STATE = "bucket int, customers long, tables long, payload binary"


def _states(rows: DataFrame, change) -> DataFrame:
    """Store the seating that ``change(bucket, payload)`` gives for every bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                state = change(bucket, unpack(batch.column("payload")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([int(state["customers"].sum())]),
                     pa.array([int(state["word_tables"].sum())]), pa.array([pack(**state)], pa.binary())],
                    names=["bucket", "customers", "tables", "payload"])

    return durable(rows.select("bucket", "payload").mapInArrow(run, _STATE))


def _per_context(rows: DataFrame, values) -> np.ndarray:
    """Two sums per context over all buckets; CONTEXTS rows at most reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("payload"):
                x, y = values(unpack(data.as_py()))
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(x[at]), pa.array(y[at])], names=["context", "x", "y"])

    out = np.zeros((2, CONTEXTS), np.int64)
    for r in (rows.select("payload").mapInArrow(run, "context int, x long, y long")
              .groupBy("context").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()):
        out[:, r.context] = r.x, r.y
    return out


def _count(context: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(CONTEXTS, np.int64)
    np.add.at(out, context, 1 if n is None else n.astype(np.int64))
    return out


class Model(NamedTuple):
    """A trained model: tables of cells and seatings by bucket, and small numbers about all of it."""

    cells: DataFrame
    seatings: DataFrame
    samples: list[Totals]
    customers: np.ndarray
    tokens: int
    words: int


def _discount(once: int, twice: int) -> float:
    """Estimated from how many types occur once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05


def fit(rows: DataFrame, dealt: Plan) -> Model:
    """Learn from the rows that are not held out."""
    cells = learn_cells(rows, dealt)
    context = rows.sparkSession.sparkContext

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("payload"):
                c = unpack(data.as_py())
                found = [len(c["words"]), int(c["n"].sum()), *[int((x == k).sum()) for x in (c["n"], c["per"]) for k in (1, 2)]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in found], names=list("abcdef"))

    words, tokens, *types = (x or 0 for x in cells.select("payload").mapInArrow(
        numbers, "a long, b long, c long, d long, e long, f long").agg(*[F.sum(k) for k in "abcdef"]).first())
    discounts = _discount(*types[:2]), _discount(*types[2:])
    customers, once = _per_context(cells, lambda c: (_count(c["context"], c["n"]), _count(c["context"][c["n"] == 1])))
    state = _states(cells, lambda _, c: _small(_start(c)))
    samples: list[Totals] = []
    for number in range(BURN_IN + SAMPLES + 1):
        tables = once + _per_context(state, lambda s: (_count(s["context"], s["tables"]),) * 2)[0]
        total = state.agg(F.coalesce(F.sum("customers"), F.lit(0)), F.coalesce(F.sum("tables"), F.lit(0))).first()
        known = Totals(*discounts, words, tables, *total)
        if number > BURN_IN:
            samples.append(known)
        if number == BURN_IN + SAMPLES:
            break
        shared = context.broadcast(known)
        keep = number - BURN_IN if number >= BURN_IN else None

        def change(bucket, s, number=number, shared=shared, keep=keep):
            return _step(s, shared.value, np.random.default_rng([SEED, number, bucket]), number == 0, keep)

        state = _states(state, change)
    return Model(cells, state, samples, customers, tokens, words)


class _Bucket:
    """Predictive probabilities of one bucket's words."""

    def __init__(self, cells: dict[str, np.ndarray] | None, state: dict[str, np.ndarray] | None,
                 samples: list[Totals], customers: np.ndarray, tokens: int):
        empty = np.zeros(0, np.int64)
        self.samples, self.whole = samples, CONTEXT_STRENGTH + customers
        self.floor = tokens + (samples[0].words + 1)
        self.words = cells["words"] if cells else np.zeros(0, np.uint64)
        per = cells["per"].astype(np.int64) if cells else empty
        n = cells["n"].astype(np.int64) if cells else empty
        self.key = (np.repeat(np.arange(len(per)), per) << CONTEXT_BITS) | (cells["context"] if cells else empty)
        self.count = np.bincount(self.key >> CONTEXT_BITS, n, len(per)).astype(np.int64)
        tables = np.ones(len(n))
        if state:
            tables[n > 1] = state["sampled"] / len(samples)
        self.own = n - samples[0].context_discount * tables
        none = np.zeros(0)
        self.parent = [x.parent(state[f"customers{i}"].astype(np.int64), state[f"word_tables{i}"].astype(np.int64)) if state else none
                       for i, x in enumerate(samples)]

    def score(self, p: dict[str, np.ndarray]) -> bytes:
        """Sums per document over the entries of one chunk."""
        at = np.searchsorted(self.words, p["words"])
        known = at < len(self.words)
        known[known] = self.words[at[known]] == p["words"][known]
        safe = np.where(known, at, 0)
        pick = lambda x, other: np.where(known, x[safe], other) if len(x) else np.full(len(safe), other)
        word, context = np.repeat(np.arange(len(at)), p["per"]), p["context"].astype(np.int64)
        up = np.zeros(len(word))
        for x, parent in zip(self.samples, self.parent):
            up += (CONTEXT_STRENGTH + x.context_discount * x.tables[context]) * pick(parent, x.parent(0, 0))[word]
        up /= len(self.samples)
        key = (safe[word] << CONTEXT_BITS) | context
        place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        if len(self.key):
            up += np.where(known[word] & (self.key[place] == key), self.own[place], 0.0)
        n, doc = p["n"].astype(np.int64), p["doc"].astype(np.int64)
        docs, local = np.unique(doc, return_inverse=True)
        sums = [np.bincount(local, n * x, len(docs)) for x in (
            known[word], np.log10((pick(self.count, 0) + 1) / self.floor)[word], np.log10(up / self.whole[context]))]
        return pack(doc=docs.astype(np.uint16), known=sums[0].astype(np.uint32), base=sums[1], score=sums[2])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(rows: pa.Table) -> pa.Table:
    """Documents of one chunk from the sums of all buckets, added in the order of the buckets."""
    order = np.argsort(rows.column("bucket").to_numpy(), kind="stable").tolist()
    parts = [unpack(rows.column("payload")[i].as_py()) for i in order]
    head = parts[0]  # its bucket number is below all others
    known, base, score = (np.zeros(len(head["doc_id"]), k) for k in (np.int64, float, float))
    for p in parts[1:]:
        for total, name in ((known, "known"), (base, "base"), (score, "score")):
            total[p["doc"]] += p[name]
    return pa.table({"doc_id": pa.array(head["doc_id"], pa.int64(), mask=head["null"]), "held_out": pa.array(head["held"]),
                     "n_tokens": pa.array(head["tokens"]), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})


def score_rows(rows: DataFrame, model: Model, dealt: Plan) -> DataFrame:
    """Log10 probabilities of all rows: their entries meet the model bucket by bucket."""
    shared = rows.sparkSession.sparkContext.broadcast((model.samples, model.customers, model.tokens))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << DOC_BITS) - 1
        for chunk, batch in _chunks(batches):
            e = entries(batch.column("_text").to_pylist())
            key, n = np.unique((((e.word << CONTEXT_BITS) | e.context) << DOC_BITS) | e.doc, return_counts=True)
            ids = batch.column("_id")
            out = [(-1 - _deal(chunk, dealt.buckets), pack(
                doc_id=ids.fill_null(0).to_numpy(), null=ids.is_null().to_numpy(zero_copy_only=False),
                held=batch.column("_held").to_numpy(zero_copy_only=False), tokens=e.sizes))]
            out += [(b, pack(words=words, per=per, context=((key[at] >> DOC_BITS) & (CONTEXTS - 1)).astype(np.uint16),
                             doc=(key[at] & low).astype(np.uint16), n=n[at].astype(np.uint32)))
                    for b, at, words, per in _by_bucket(e.words, key, CONTEXT_BITS + DOC_BITS, dealt.buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([_deal(chunk, dealt.groups)] * len(out), pa.int32()),
                 pa.array([chunk] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                names=["bucket", "lane", "chunk", "payload"])

    def meet(found: pa.Table, learned: pa.Table) -> pa.Table:
        samples, customers, tokens = shared.value
        parts = {x["seated"]: unpack(x["payload"]) for x in learned.to_pylist()}
        own, out = None, []
        for i in range(found.num_rows):
            data = found.column("payload")[i].as_py()
            if found.column("bucket")[i].as_py() >= 0:
                own = own or _Bucket(parts.get(False), parts.get(True), samples, customers, tokens)
                data = own.score(unpack(data))
            out.append(data)
        return pa.table({"bucket": found.column("bucket"), "chunk": found.column("chunk"), "payload": pa.array(out, pa.binary())})

    asked = rows.mapInArrow(cut, "bucket int, lane int, chunk long, payload binary")
    learned = (model.cells.select("bucket", F.lit(False).alias("seated"), "payload")
               .unionByName(model.seatings.select("bucket", F.lit(True).alias("seated"), "payload"))
               .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(dealt.groups - 1)))))
    sums = asked.groupBy("bucket", "lane").cogroup(learned.groupBy("bucket", "lane")).applyInArrow(
        meet, "bucket int, chunk long, payload binary")
    return sums.groupBy("chunk").applyInArrow(_finish, _SCORED)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score every whole text with a model of the documents that are not held out.

    Columns: doc_id, held_out, n_tokens, n_known (tokens that the learned texts hold),
    train_tokens, base_score (add-one unigrams), score (log10 probability under the model) and
    perplexity (10 to the minus mean score of a token).

    Tokens are words between ASCII white space, A-Z in lower case, and one end.  A null or
    empty text is one end.  Repeated rows are documents of their own and are learned from as
    often; a null id is learned from.  An empty table gives an empty result, and if nothing is
    learned the model is uniform.  Texts of any length are whole.  Other columns are not read,
    so their names cannot clash.

    Words are told apart by 64-bit hashes.  The order of sampling is fixed by seeds per sweep
    and bucket, so a task that runs again gives the same seating.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), held_out(F.col(doc_id)).alias("_held"),
                       F.col(text).cast("string").alias("_text"))
    dealt = plan(rows)
    model = fit(rows, dealt)
    return score_rows(rows, model, dealt).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
