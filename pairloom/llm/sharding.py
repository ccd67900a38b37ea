"""Sharding by histogram sort.

Rows are sorted by the hash of their text.  The splitters between shards are found by
counting the exact bytes below candidate boundaries: first boundaries spread over the whole
key range, then ever closer ones inside the few intervals that hold a splitter, until each
splitter is within the tolerance.  Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import durable

#: Candidate boundaries of the first round, and of each interval in later rounds.
FIRST_PROBES, PROBES = 16384, 512
#: Distance of a splitter from its target, as a share of the mean bytes of a shard.
TOLERANCE = 0.001
#: Rows with one text stay together up to this share of the mean bytes of a shard.
GROUP = 0.05
#: Sort key: hash of the text, then the id, then the row's place in the stored table, so
#: that one text or id with a third of all rows can still be cut.
KEY = ("_h", "_d", "_s")
_FAR = 1 << 62


@dataclass(frozen=True)
class Splitter:
    """Lower end of a shard: the first levels of the key, from ``values`` on (or beyond it)."""

    values: tuple[int, ...]
    beyond: bool

    def reached(self) -> Column:
        """Whether a row lies at or after this splitter."""
        *outer, (name, value) = list(zip(KEY, self.values))
        last = F.col(name) > F.lit(value) if self.beyond else F.col(name) >= F.lit(value)
        return reduce(lambda inner, level: (F.col(level[0]) > F.lit(level[1]))
                      | ((F.col(level[0]) == F.lit(level[1])) & inner), reversed(outer), last)


@dataclass(frozen=True)
class Interval:
    """Key range that still holds splitters: fixed outer levels, and a range of the next one."""

    outer: tuple[int, ...]
    low: int
    high: int
    before: int
    targets: tuple[int, ...]

    @property
    def name(self) -> str:
        return KEY[len(self.outer)]

    @property
    def next_name(self) -> str:
        return KEY[min(len(self.outer) + 1, len(KEY) - 1)]

    def holds(self) -> Column:
        fixed = [F.col(n) == F.lit(v) for n, v in zip(KEY, self.outer)]
        return reduce(Column.__and__, fixed, F.col(self.name).between(F.lit(self.low), F.lit(self.high)))

    def bin(self, probes: int) -> Column:
        if self.high - self.low < _FAR:
            width = max(1, -(-(self.high - self.low + 1) // probes))
            return F.floor((F.col(self.name) - F.lit(self.low)) / F.lit(width)).cast("int") if width < 1 << 50 \
                else F.expr(f"cast(({self.name} - ({self.low}L)) div {width}L as int)")
        width = (self.high - self.low + 1) / probes
        return F.floor((F.col(self.name).cast("double") - F.lit(float(self.low))) / F.lit(width)).cast("int")


def _histogram(rows: DataFrame, intervals: list[Interval], probes: int) -> dict[int, list]:
    """Exact bytes between neighbouring boundaries: at most probes + 1 rows per interval."""
    pick = lambda make: F.coalesce(*[F.when(x.holds(), make(i, x)) for i, x in enumerate(intervals)])
    counted = (rows.withColumn("_i", pick(lambda i, x: F.lit(i))).where(F.col("_i").isNotNull())
               .withColumn("_bin", pick(lambda i, x: x.bin(probes)))
               .withColumn("_key", pick(lambda i, x: F.col(x.name)))
               .withColumn("_next", pick(lambda i, x: F.col(x.next_name)))
               .groupBy("_i", "_bin").agg(
                   F.sum("_size").alias("bytes"), F.count("*").alias("n"), F.min("_key").alias("low"),
                   F.max("_key").alias("high"), F.min("_next").alias("next_low"), F.max("_next").alias("next_high")))
    out: dict[int, list] = {i: [] for i in range(len(intervals))}
    for r in counted.orderBy("_i", "low").collect():
        out[r._i].append(r)
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, group: float = GROUP) -> list[Splitter]:
    """Lower ends of the shards 1, 2, ... of stored rows with columns _size, _h, _d and _s.

    Only counts per boundary come to the driver, for fewer than ``shards`` intervals a
    round.  Each round narrows an interval by the number of probes; when it has shrunk to
    one text or one id, the next level of the key goes on.  One text with at most ``group``
    of a shard's mean bytes is not cut: the splitter goes to its nearer end.
    """
    whole = rows.agg(F.sum("_size").alias("bytes"), F.min("_h").alias("low"), F.max("_h").alias("high")).first()
    if whole.bytes is None:
        return []
    total, mean = int(whole.bytes), int(whole.bytes) / shards
    slack = tolerance * mean
    # Targets in whole bytes; several may fall on one place if there are few rows.
    active = [Interval((), whole.low, whole.high, 0, tuple(total * i // shards for i in range(1, shards)))]
    found: list[tuple[int, Splitter]] = []
    probes = FIRST_PROBES
    while active and shards > 1:
        refined: list[Interval] = []
        for i, bins in _histogram(rows, active, probes).items():
            interval = active[i]
            below = interval.before
            for b in bins:
                inside = [t for t in interval.targets if below <= t < below + b.bytes]
                narrow = []
                for t in inside:
                    start, end = t - below, below + b.bytes - t
                    near = Splitter(interval.outer + ((b.low,) if start <= end else (b.high,)), start > end)
                    small = not interval.outer and b.bytes <= group * mean
                    last = b.n == 1 or b.low == b.high and (small or len(interval.outer) == len(KEY) - 1)
                    if min(start, end) <= slack or last:
                        found.append((t, near))
                    else:
                        narrow.append(t)
                if narrow and b.low == b.high:
                    refined.append(Interval(interval.outer + (b.low,), b.next_low, b.next_high, below, tuple(narrow)))
                elif narrow:
                    refined.append(Interval(interval.outer, b.low, b.high, below, tuple(narrow)))
                below += b.bytes
        active, probes = refined, PROBES
    return [s for _, s in sorted(found, key=lambda x: x[0])]


def _shard(cuts: list[Splitter], first: int = 0) -> Column:
    """Number of splitters at or before a row, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(cuts[mid].reached(), _shard(cuts[mid + 1:], first + mid + 1)).otherwise(_shard(cuts[:mid], first))


def shard(docs: DataFrame, shards: int, size: Column, text: str = "text", doc_id: str = "doc_id",
          tolerance: float = TOLERANCE, group: float = GROUP) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal ``size``.

    Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to the columns of ``docs``; a
    column of that name in ``docs`` gives way.  The rows are stored once with their keys and
    exchanged once, by shard and key, into as many tasks as the session has shuffle
    partitions, so that neither a shard nor a hot text is bound to one task.

    Rows with equal texts stand together.  They share a shard unless they hold more than
    ``group`` of a shard's mean bytes; then they are cut where it is due.  So a splitter is off
    its target by the tolerance, half a group or half a row, whichever is most.  A null text is a text of its own, a null id comes before all
    ids, repeated rows are cut by their place.  With fewer rows than shards some shards stay
    empty; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    # An id of the table may be missing; the smallest long stands for it.
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = durable(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), size.cast("long").alias("_size"),
        F.xxhash64(text).alias("_h"), number.alias("_d"), F.monotonically_increasing_id().alias("_s")))
    cuts = splitters(rows, shards, tolerance, group)
    order = ["_shard", *KEY]
    placed = (rows.withColumn("_shard", _shard(cuts)).repartitionByRange(*order).sortWithinPartitions(*order)
              .select("_row", "_shard", F.monotonically_increasing_id().alias("_at")))
    placed = durable(placed.select(
        "_row", "_shard", F.shiftrightunsigned("_at", 33).cast("int").alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # One row per task and shard, fewer than tasks + shards in all.
    parts = placed.groupBy("_shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    return (placed.join(F.broadcast(parts.select("_shard", "_part", "_base")), ["_shard", "_part"])
            .select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_at") + F.col("_base")).alias("slot")))
