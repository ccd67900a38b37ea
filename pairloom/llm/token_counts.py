"""Token counts of whole texts from counts of distinct pre-tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens and splits each on its own, so a text
has as many tokens as its pre-tokens have pieces.  Pieces are counted once per distinct
pre-token; documents carry pre-token frequencies only, never token ids.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pairloom.session import durable

#: Pre-token pattern of the byte-level tokenizers (a fixed value of the format), with white
#: space spelled out as the property.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Frequent pre-tokens whose piece counts every task gets: at most so many, none of more
#: characters, taken from a sample of about so many documents.  The sample decides only
#: which pre-tokens are looked up in the task; all others take the join.
COMMON, COMMON_CHARS, SAMPLE = 1 << 17, 40, 4000
#: Texts whose frequencies a task holds at a time.
SLICE = 400


class Cutter:
    """Cuts texts into pre-tokens; an added token inside a text is one of its own."""

    def __init__(self, added: list[str]):
        self.added = frozenset(added)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cut = regex.compile(PRE_TOKEN)

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a whole text, and the number of added tokens in it."""
        if self.split is None or not self.split.search(text):
            return self.cut.findall(text), 0
        out, n = [], 0
        for part in self.split.split(text):
            if part in self.added:
                n += 1
            else:
                out += self.cut.findall(part)
        return out, n


def added_tokens(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before cutting it."""
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def _pieces(path: str):
    """Piece counts of many pre-tokens."""
    from tokenizers import Tokenizer

    # Spark runs a task per core already; threads of the library's own would only hold memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(x) for at in range(0, len(texts), SLICE)
                          for x in tokenizer.encode_batch(texts[at:at + SLICE], add_special_tokens=False)]


def _common(docs: DataFrame, added: list[str]) -> list[str]:
    """Frequent pre-tokens of a sample of about SAMPLE rows, drawn in every task: no text is moved."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(added)
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column("_text").to_pylist():
                seen.update(x for x in cutter(text)[0] if len(x) <= COMMON_CHARS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    sample = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1).where("_text is not null")
    rows = (sample.select("_text").mapInArrow(cut, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "piece").limit(COMMON).select("piece").collect())
    return [r.piece for r in rows]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens of every whole text, as the tokenizer file at ``path`` gives them.

    Columns: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).  One row per row
    of ``docs``; repeated rows and null ids stay as they are.  Null and empty texts have no
    bytes and no tokens.  No special tokens are added; an added token of the file inside a
    text counts as one.  Nothing is cut off.  An empty table gives an empty result.

    ``path`` must exist on every node, as the tokenizer files of an installed package do.
    Each text is cut once.  Common pre-tokens are summed where they are found; the others go
    by (row, pre-token, frequency) to the join with the piece counts of the distinct ones.
    """
    added = added_tokens(path)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    common = _common(rows, added)
    context = docs.sparkSession.sparkContext
    known = context.broadcast(dict(zip(common, _pieces(path)(common))) if common else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, get = Cutter(added), known.value.get
        rest = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))
        # Frequencies of a few hundred texts at a time, whatever the size of a batch.
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            size, n, rare = [], [], []
            for text in batch.column("_text").to_pylist():
                pieces, extra = cutter(text) if text else ([], 0)
                counts = list(map(get, pieces))
                other = Counter(p for p, c in zip(pieces, counts) if c is None) if None in counts else {}
                size.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                n.append(extra + sum(filter(None, counts)))
                rare.append([{"piece": p, "n": k} for p, k in other.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(rare, rest)], names=["_row", "_id", "n_bytes", "n_common", "rare"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(pieces(batch.column("piece").to_pylist()), pa.int64())],
                names=["piece", "pieces"])

    counted = durable(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        count, "_row long, _id long, n_bytes long, n_common long, rare array<struct<piece: string, n: long>>"))
    rare = counted.select("_row", F.explode("rare").alias("x")).select("_row", "x.*")
    distinct = rare.select("piece").distinct().mapInArrow(split, "piece string, pieces long")
    summed = rare.join(distinct, "piece").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rare"))
    total = F.col("n_common") + F.coalesce("n_rare", F.lit(0))
    return (counted.select("_row", "_id", "n_bytes", "n_common").join(summed, "_row", "left")
            .select(F.col("_id").alias("doc_id"), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
