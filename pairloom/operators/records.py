"""Training records: prompts, token lengths, vocabularies, encoded arrays, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom import schema as S
from pairloom.functions import arrow
from pairloom.functions import text as X
from pairloom.functions import wire
from pairloom.functions.arrays import let
from pairloom.operators.scale import global_running, number_rows, texts_by_id
from pairloom.session import durable


def split_prompt(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Cut at the end of the first response marker: model input and target.

    A prompt without marker is all input.
    """
    cut = wire.prompt_cut(F.col(prompt))
    return (df.withColumn("_cut", cut)
            .withColumn("model_input", F.when(
                F.col("_cut") > 0, F.substr(F.col(prompt), F.lit(1), F.col("_cut") - 1))
                .otherwise(F.col(prompt)))
            .withColumn("target", F.when(
                F.col("_cut") > 0, F.substr(F.col(prompt), F.col("_cut"))).otherwise(""))
            .drop("_cut"))


def token_count(c: Column, pattern: str = X.TOKEN) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def within_limit(df: DataFrame, n_tokens: str, limit: int = S.PROMPT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows up to the limit, key table of the rest)."""
    return (df.where(F.col(n_tokens) <= limit),
            df.where(F.col(n_tokens) > limit).select("pair_id"))


def oversize_rows(df: DataFrame, n_in: str = "n_in", n_out: str = "n_out",
                  max_in: int = S.INPUT_TOKENS, max_out: int = S.LABEL_TOKENS) -> DataFrame:
    """Ids whose input fills the last position or whose labels reach ``max_out``.

    The label test counts only if the longest label of the table is longer.
    """
    longest = df.agg(F.max(n_out).alias("_longest")).scalar()
    return (df.where((F.col(n_in) >= max_in)
                     | ((longest > max_out) & (F.col(n_out) >= max_out)))
            .select("pair_id").distinct())


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, n, token_id): ids by falling count, then by token.  Tasks sum before they exchange."""
    counts = df.select(text).mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return number_rows(counts, [F.desc("n"), F.asc("token")], "token_id")


#: Bytes of text whose tokens a task counts, or numbers, at a time.
CHUNK_BYTES = 1 << 22


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES, prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            words, _ = arrow.words_and_marks(batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(words.value_counts().flatten(), names=["token", "n"])


def token_ids(df: DataFrame, text: str, vocab: DataFrame, length: int | None = None,
              pad: int = 0, row_id: str = "pair_id") -> DataFrame:
    """(row_id, input_ids): ragged id arrays of whole texts, or of their first ``length`` tokens.

    Tokens outside the vocabulary get the pad id.  A text without tokens keeps its row.

    Texts are numbered in chunks, each against the list of its distinct tokens.  The numbers
    are stored; only the lists, one row per chunk and token, meet the vocabulary.
    """
    return _ids_of(_chunks(df, text, length, row_id), vocab, pad, df.schema[row_id])


_INTS = T.ArrayType(T.IntegerType())


def _chunks(df: DataFrame, text: str, length: int | None, row_id: str) -> DataFrame:
    """The texts' token numbers, stored: chunk, row, texts, sizes, codes, words."""
    stored = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("row", T.ArrayType(df.schema[row_id].dataType)),
        *[T.StructField(c, _INTS) for c in ("texts", "sizes", "codes")], T.StructField("words", T.ArrayType(T.StringType()))])
    return durable(texts_by_id(df, row_id, text).mapInArrow(_numbered(text, length), stored))


def _ids_of(chunks: DataFrame, vocab: DataFrame, pad: int, key: T.StructField) -> DataFrame:
    known = (chunks.select("chunk", F.posexplode("words").alias("at", "token"))
             .join(vocab.select("token", F.col("token_id").cast("int").alias("id")), "token")
             .groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id")))
    out = T.StructType([key, T.StructField("input_ids", _INTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names if name != "chunk"}
                yield pa.RecordBatch.from_arrays([one["row"], _decoded(one, pad)], names=out.names)

    return chunks.drop("words").join(known, "chunk", "left").drop("chunk").mapInArrow(run, out)


def _numbered(text: str, length: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per chunk of texts: ids, texts per id, tokens per text, token numbers, distinct tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for number, (batch, toks, sizes) in enumerate(arrow.cut_texts(batches, text, arrow.words_and_marks, CHUNK_BYTES)):
            words = toks.words
            if length is not None:
                words, sizes = words.filter(pa.array(toks.pos < length)), np.minimum(sizes, length)
            codes, words = arrow.codes_of(words)
            lists = [batch.column(0), pa.array(toks.texts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(codes, pa.int32()), words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + number]), *[arrow.as_lists(x, np.array([len(x)])) for x in lists]],
                names=["chunk", "row", "texts", "sizes", "codes", "words"])
    return run


def _decoded(chunk: dict[str, pa.Array], pad: int) -> pa.ListArray:
    """Ids of a chunk's rows; texts that share an id are read side by side."""
    codes, sizes, texts = (chunk[k].to_numpy(zero_copy_only=False) for k in ("codes", "sizes", "texts"))
    ids = np.full(int(codes.max(initial=-1)) + 1, pad, np.int32)
    ids[chunk["at"].to_numpy(zero_copy_only=False).astype(np.int64)] = chunk["id"].to_numpy(zero_copy_only=False)
    ids = ids[codes]
    row = np.repeat(np.repeat(np.arange(len(texts)), texts), sizes)
    if (texts > 1).any():
        ids = ids[np.lexsort((ids, arrow.places(sizes.astype(np.int64)), row))]
    return arrow.as_lists(pa.array(ids, pa.int32()), np.bincount(row, minlength=len(texts)))


def bucket_width(n_tokens: Column) -> Column:
    """Width of the length bucket: the smallest power of two that holds the tokens, so that
    padding never doubles a row.  No row's width depends on another row."""
    bits = F.length(F.bin(n_tokens.cast("long") - 1))
    return F.when(n_tokens <= 1, n_tokens).otherwise(F.pow(F.lit(2), bits)).cast("int")


def padded(ids: DataFrame, width: Column, pad: int = 0, input_ids: str = "input_ids", runs: bool = False) -> DataFrame:
    """Add n_tokens and attention_mask, and pad ``input_ids`` to ``width``, a column over ``n_tokens``.

    With ``runs`` both arrays end where their padding starts, and ``n_pad`` has its length.
    """
    rows = (ids.withColumn("n_tokens", F.size(input_ids))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.col("n_tokens")))
            .withColumn("n_pad", F.greatest(width - F.col("n_tokens"), F.lit(0))))
    spelt = {input_ids: pad, "attention_mask": 0}
    return rows if runs else rows.withColumns(
        {c: F.concat(c, F.array_repeat(F.lit(x), F.col("n_pad"))) for c, x in spelt.items()}).drop("n_pad")


def joined(head: Column, fill: int, times: Column, sep: str = " ") -> Column:
    """``head`` and ``times`` times ``fill`` behind it, as text: a run costs one repeated string, not
    an entry for each of its cells."""
    run = F.repeat(F.lit(f"{sep}{fill}"), times)
    return F.when(F.size(head) > 0, F.concat(F.array_join(head, sep), run)).otherwise(
        F.substring(run, len(sep) + 1, 2 ** 31 - 1))


#: Length of ``encode_tokens`` that pads every row to the longest of the table.
LONGEST = "longest"


def encode_tokens(df: DataFrame, text: str, vocab: DataFrame, length: int | str | None = None,
                  pad: int = 0, row_id: str = "pair_id", runs: bool = False) -> DataFrame:
    """(row_id, input_ids, attention_mask, n_tokens): padded id arrays, see ``token_ids``.

    Whole texts are padded within their length bucket: a long text widens no other row, and
    rows of one width make a batch.  LONGEST pads whole texts to the longest of the table, so
    that the result has rows times longest text entries.  A number cuts and pads every row to that.

    With ``runs`` there is a column ``n_pad`` too: the arrays end where their padding starts and
    are followed by so many pads, see ``joined``.
    """
    chunks = _chunks(df, text, None if length == LONGEST else length, row_id)
    width = bucket_width(F.col("n_tokens")) if length is None else F.lit(length)
    if length == LONGEST:
        width = F.lit(chunks.agg(F.coalesce(F.max(F.array_max("sizes")), F.lit(0))).first()[0])
    return padded(_ids_of(chunks, vocab, pad, df.schema[row_id]), width, pad, runs=runs).select(
        row_id, "input_ids", "attention_mask", "n_tokens", *["n_pad"] * runs)


def bucket_totals(encoded: DataFrame) -> DataFrame:
    """(width, texts, tokens, cells) of padded arrays, one row per length bucket."""
    return encoded.groupBy(F.size("input_ids").alias("width")).agg(
        F.count("*").alias("texts"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"),
        F.sum(F.size("input_ids").cast("long")).alias("cells"))


def mask_label_padding(labels: Column, pad: int = 0, n_pad: Column | None = None) -> Column:
    """All entries behind the first pad become the ignored label.

    Labels that come as runs, followed by ``n_pad`` pads, give a struct of runs: ``head``, and
    ``n_ignored`` ignored labels behind it.
    """
    first = F.array_position(labels, pad)
    if n_pad is None:
        ignored = lambda p: F.array_repeat(F.lit(S.IGNORED_LABEL), (F.size(labels) - p).cast("int"))
        return let(first, lambda p: F.when(p > 0, F.concat(F.slice(labels, F.lit(1), p.cast("int")), ignored(p))).otherwise(labels))
    head = F.when(first > 0, F.slice(labels, F.lit(1), first.cast("int"))).when(
        n_pad > 0, F.array_append(labels, F.lit(pad))).otherwise(labels)
    return let(head, lambda h: F.struct(h.alias("head"), (F.size(labels) + n_pad - F.size(h)).alias("n_ignored")))


def split_balanced(df: DataFrame, target: str, row_id: str, ratios=(8, 1, 1)) -> DataFrame:
    """Equal number of rows per class, then train / val / test by rank.

    Rows of a class are ranked by the hash of their id.  A class may hold nearly
    all rows, so the rank is a two-level running count, not a window per class.
    """
    sizes = df.groupBy(target).agg(F.count("*").alias("_n"))
    per_class = sizes.agg(F.min("_n")).scalar()
    ranked = global_running(
        df.withColumn("_h", F.md5(F.col(row_id).cast("string"))),
        [F.asc(target), F.asc("_h"), F.asc(row_id)], {}, by=[target], row_number="rank")
    train = F.floor(per_class * ratios[0] / sum(ratios))
    val = F.floor(per_class * (ratios[0] + ratios[1]) / sum(ratios))
    split = (F.when(F.col("rank") <= train, "train")
             .when(F.col("rank") <= val, "val").otherwise("test"))
    return ranked.where(F.col("rank") <= per_class).withColumn("split", split).drop("_h")


def chunk_rows(df: DataFrame, order: list[str], slice_size: int) -> DataFrame:
    """Number the rows by a unique order and cut them into slices."""
    numbered = number_rows(df, [F.asc(c) for c in order], "row_number")
    return numbered.withColumn("chunk", F.floor((F.col("row_number") - 1) / slice_size))


def drop_large(df: DataFrame, n_nodes: str, limit: int) -> DataFrame:
    return df.where(F.col(n_nodes) <= limit)
