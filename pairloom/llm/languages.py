"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  One binary classifier per bit, on hashed byte
n-grams, tells the languages whose bit is 1 from the others.  Decoding compares the
classifiers' margins with every codeword, weighs each bit by how well its classifier
separates that language, and takes the codeword of least loss; a text whose best two
codewords are nearly as close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.tables import durable

#: Hash buckets of n-grams, the n-gram length in bytes, and the pseudo-count of a bucket.
BUCKETS, GRAM, PSEUDO = 1 << 15, 3, 0.5
#: Bits of a codeword for more than four languages, as a multiple of log2 of their number.
BITS_PER_LOG = 10
#: N-grams that count as full evidence, so that a score is no matter of length beyond it.
EVIDENCE = 60
#: A text is ambiguous if the best score is below this.
CLEAR = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Bytes of a gram: A-Z to a-z, other ASCII characters that are no letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hash buckets of all byte n-grams of a whole text, runs of other characters as one space."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, dtype=np.uint32)
    h = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - 15)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 / -1 bits for each of ``n`` languages.

    Up to four languages get the exhaustive code (all ways of parting them); more get the
    code of largest smallest distance among seeded random ones.
    """
    if n <= 4:
        bits = max(1, 2 ** (n - 1) - 1)
        code = np.array([[1 - 2 * ((b + 1) >> (n - 1 - i) & 1) if i else 1 for b in range(bits)]
                         for i in range(n)], dtype=np.float64)
        return code
    rng, bits = np.random.default_rng(seed), int(np.ceil(BITS_PER_LOG * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # every bit parts the languages
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, weights of the buckets per bit, and of the bits per language."""

    names: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean margin of every bit, and the n-grams behind it, for each text."""
        out, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for i, text in enumerate(texts):
            g = grams(text)
            n[i] = len(g)
            if len(g):
                out[i] = (np.bincount(g, minlength=BUCKETS) @ self.weights / len(g) if len(g) > 4096
                          else self.weights[g].mean(axis=0))
        return out, n

    def decode(self, margin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and score of the codeword of least weighted logistic loss."""
        evidence = np.minimum(n, EVIDENCE)[:, None, None]
        loss = np.logaddexp(0, -self.code[None] * margin[:, None, :] * evidence) * self.trust[None]
        total = loss.sum(axis=2)
        odds = np.exp(total.min(axis=1, keepdims=True) - total)
        return total.argmin(axis=1), (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)


def _counts(rows: DataFrame) -> DataFrame:
    """Occurrences of every bucket per language, over whole texts, summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("_lang").to_pylist(), dtype=object)
            texts = batch.column("_text")
            for name in dict.fromkeys(lang):
                total = np.zeros(BUCKETS, dtype=np.int64)
                for i in np.flatnonzero(lang == name):
                    g = grams(texts[int(i)].as_py())
                    if len(g):
                        total += np.bincount(g, minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                    names=["lang", "bucket", "n"])

    return (rows.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a text and a language.

    The corpus is counted by Spark; the driver gets the list of languages and one row of
    bit weights per bucket, so what it holds depends on languages and buckets only.  A
    second pass measures how often each bit is right for each language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    counts = durable(_counts(rows))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = tuple(sorted(totals))
    code = codewords(len(names)) if names else np.zeros((0, 1))
    bits = code.shape[1]
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, bits)), np.ones((len(names), bits)))

    # Each language counts alike, however many rows it has: shares, not counts, are added up.
    share = F.coalesce(*[F.when(F.col("lang") == x, (F.col("n") / F.lit(float(totals[x] + PSEUDO * BUCKETS))))
                         for x in names])
    sums = counts.withColumn("p", share).groupBy("bucket").agg(*[
        F.sum(F.when(F.col("lang").isin([x for i, x in enumerate(names) if code[i, b] > 0]), F.col("p"))
              .otherwise(0.0)).alias(f"p{b}") for b in range(bits)], F.sum("p").alias("p")).collect()
    floor = np.array([PSEUDO / (totals[x] + PSEUDO * BUCKETS) for x in names])
    one, all_ = np.zeros((BUCKETS, bits)), np.zeros(BUCKETS)
    for r in sums:
        one[r.bucket], all_[r.bucket] = [r[f"p{b}"] for b in range(bits)], r.p
    up, down = code > 0, code < 0
    ones = (one + (up * floor[:, None]).sum(axis=0)) / up.sum(axis=0)
    zeros = (all_[:, None] - one + (down * floor[:, None]).sum(axis=0)) / np.maximum(1, down.sum(axis=0))
    model = Model(names, code, np.log(ones) - np.log(np.maximum(zeros, 1e-300)), np.ones_like(code))
    return Model(names, code, model.weights, _trust(rows, model))


def _trust(rows: DataFrame, model: Model) -> np.ndarray:
    """How much better than chance each bit is for each language, as weights of mean 1."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = {x: i for i, x in enumerate(model.names)}
    # A lang whose texts hold no letter has no counts and so no name.
    rows = rows.where(F.col("_lang").isin(list(model.names)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, right = np.zeros(len(m.names)), np.zeros(m.code.shape)
        for batch in batches:
            who = np.array([at[x] for x in batch.column("_lang").to_pylist()])
            margin, _ = m.margins(batch.column("_text").to_pylist())
            np.add.at(n, who, 1)
            np.add.at(right, who, margin * m.code[who] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(m.names)), pa.array(n), pa.array(list(right), pa.list_(pa.float64()))],
            names=["lang", "n", "right"])

    bits = model.code.shape[1]
    seen = (rows.mapInArrow(judge, "lang string, n double, right array<double>").groupBy("lang")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col("right")[b]).alias(f"r{b}") for b in range(bits)]).collect())
    trust = np.ones_like(model.code)
    for r in seen:
        if r.n:
            trust[at[r.lang]] = [max(2 * r[f"r{b}"] / r.n - 1, 0.01) for b in range(bits)]
    return trust / trust.mean(axis=1, keepdims=True)


def predict(spark, model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and ambiguous for a whole text.

    ``und`` with score 0 for a null text, one without a letter, or a model without
    languages.  Only the text is looked at.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        known = [bool(m.names) and isinstance(t, str) and _LETTER.search(t) is not None for t in texts]
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at):
            best, certain = m.decode(*m.margins([texts.iloc[i] for i in at]))
            lang[at], score[at] = np.array(m.names, dtype=object)[best], certain
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": (score < CLEAR) & np.array(known, bool)})

    return judge(text)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose crc32 of the id as text falls into the held-out fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Language of every row, learned from rows outside the held-out fold.

    Columns: doc_id, held_out, lang_pred, score, ambiguous; one row for each row of ``docs``.
    Rows with a null id, text or language are not learned from, nor is a language without a
    text that holds a letter.  With nothing to learn from
    every text is ``und``; with one language every text with a letter is in it, at score 1.
    Repeated rows get equal results, an empty table an empty one.
    """
    out = held_out(F.col(doc_id))
    model = fit(docs.where(~out & F.col(doc_id).isNotNull()), text, lang)
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), out.alias("held_out"),
                        predict(docs.sparkSession, model, F.col(text).cast("string")).alias("_p"))
            .select("doc_id", "held_out", "_p.*"))
