"""Whole jobs whose share of a task does not grow with the table."""

import glob
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import catalog
from pairloom.functions import arrow, text as X
from pairloom.llm import pitman_yor
from pairloom.operators import diff, lines, metrics, records, scale
from pairloom.plans import slices
from pairloom.session import store_texts


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(
        [(1, "a b a b c"), (2, ""), (3, None), (4, "a a"), (4, "b a a"), (None, "c")], "pair_id long, t string")


def test_longest_text_sets_the_width_of_every_row(spark, texts):
    rows = records.encode_tokens(texts.where("pair_id < 4"), "t", records.vocabulary(texts, "t"), records.LONGEST).collect()
    assert {r.pair_id: r.input_ids for r in rows} == {1: [1, 2, 1, 2, 3], 2: [0] * 5, 3: [0] * 5}
    assert {r.pair_id: sum(r.attention_mask) for r in rows} == {1: 5, 2: 0, 3: 0}


def test_texts_that_share_an_id_are_encoded_side_by_side(texts):
    ids = {r.pair_id: r.input_ids for r in records.token_ids(texts, "t", records.vocabulary(texts, "t")).collect()}
    assert ids[4] == [1, 2, 1, 1, 1] and ids[None] == [3] and ids[3] == []


def test_no_token_is_exploded_for_ids_names_or_ngrams(spark, texts):
    two = texts.withColumn("u", F.col("t"))
    vocab = records.vocabulary(texts, "t")
    for df in (metrics.ngram_stats(two, "t", "u", X.words), lines.normalise_identifiers(texts, "t")):
        plan = plan_of(df)
        assert plan.count("Exchange ") <= 2 and "Generate" not in plan and "Window" not in plan
    assert "posexplode(_t" not in plan_of(records.token_ids(texts, "t", vocab))


ODD_TEXTS = [
    "int a_1=b->c;", "", " \t\n\x0b\f\r", "\x1c\x85\u2028 x\u00a0y", "é_ü aé1 \U0001d11ea", '"a\\\u2028b" c "x\\\rd" "p\\"q"',
    "// c 'x\n/* a\n\"b */ 'q\\'r' '\\\n'", "/* open", "0x1F+1e-3...a<<=b##c", "a", "1"]


@pytest.mark.parametrize("pattern, cut", [(X.TOKEN, arrow.words_and_marks), (X.C_TOKEN, arrow.by_pattern(X.C_TOKEN_PY))])
def test_tokens_cut_in_tasks_are_those_of_the_pattern(spark, pattern, cut):
    rows = spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "i int, t string")
    want = [r.w for r in rows.select("i", F.coalesce(X.tokens(F.col("t"), pattern), F.array().cast("array<string>")).alias("w")).orderBy("i").collect()]
    words, sizes = cut(pa.array([*ODD_TEXTS, None]))
    assert words.to_pylist() == [w for one in want for w in one] and sizes.tolist() == list(map(len, want))
    words, sizes = cut(pa.array(ODD_TEXTS).slice(3, 5))
    assert words.to_pylist() == [w for one in want[3:8] for w in one] and sizes.tolist() == list(map(len, want[3:8]))


def test_bytes_that_are_no_text_are_replaced():
    raw = pa.array([b"a\xffb c", b"\xc3", b"d"], pa.binary())
    words, sizes = arrow.words_and_marks(pa.StringArray.from_buffers(3, *raw.buffers()[1:]))
    assert words.to_pylist() == ["a", "\ufffd", "b", "c", "\ufffd", "d"] and sizes.tolist() == [4, 1, 1]


def test_vocabulary_is_summed_in_tasks(spark, texts, monkeypatch):
    monkeypatch.setattr(records, "CHUNK_BYTES", 4)
    vocab = records.vocabulary(texts, "t")
    assert sorted(map(tuple, vocab.collect())) == [("a", 6, 1), ("b", 3, 2), ("c", 2, 3)]
    counted = records._counted(iter([pa.RecordBatch.from_arrays([pa.array(["a b", None, "", "a a", "b"])], names=["t"])]))
    assert sorted((w, n) for b in counted for w, n in zip(*map(pa.Array.to_pylist, b.columns))) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]


@pytest.mark.parametrize("length", [None, 3, records.LONGEST])
def test_padding_in_runs_is_the_spelt_padding(spark, texts, length):
    few = texts.where("pair_id < 5")
    vocab = records.vocabulary(few.where("t <> 'a a'"), "t")
    spelt = records.encode_tokens(few, "t", vocab, length).select("pair_id", F.array_join("input_ids", " "), F.array_join("attention_mask", ""),
                                                                  F.array_join(records.mask_label_padding(F.col("input_ids")), " "))
    n_pad = F.col("n_pad")
    runs = records.encode_tokens(few, "t", vocab, length, runs=True).withColumn("m", records.mask_label_padding(F.col("input_ids"), n_pad=n_pad)).select(
        "pair_id", records.joined(F.col("input_ids"), 0, n_pad), records.joined(F.col("attention_mask"), 0, n_pad, ""),
        records.joined(F.col("m.head"), -100, F.col("m.n_ignored")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(runs) == key(spelt) and len(key(runs)) == 4


def test_a_pad_among_the_labels_ends_both_forms(spark):
    rows = spark.createDataFrame([([5, 0, 6], 2), ([5, 6], 0), ([], 3), ([], 0), ([7], 1)], "l array<int>, n int")
    got = [tuple(r) for r in rows.select(
        F.array_join(records.mask_label_padding(F.concat("l", F.array_repeat(F.lit(0), F.col("n")))), " "),
        records.joined(records.mask_label_padding(F.col("l"), n_pad=F.col("n"))["head"], -100,
                       records.mask_label_padding(F.col("l"), n_pad=F.col("n"))["n_ignored"])).collect()]
    assert got == [(x, x) for x in ("5 0 -100 -100 -100", "5 6", "0 -100 -100", "", "7 0")]


def test_ngrams_of_texts_that_share_an_id_are_counted_together(spark):
    df = spark.createDataFrame([(1, "a b", "a"), (1, "a", "a c"), (2, "x", None)], "pair_id long, h string, r string")
    got = {(r.pair_id, r.n): (r.matched, r.hyp, r.ref) for r in metrics.ngram_stats(df, "h", "r", X.words).collect()}
    assert got == {(1, 1): (2, 3, 3), (1, 2): (0, 1, 1), (2, 1): (0, 1, 0)}


def test_partitions_of_a_diff_follow_the_bytes(spark, monkeypatch):
    pairs = spark.createDataFrame([(i, "x\ny" * 20, "x\nz") for i in range(100)], "pair_id long, before string, after string")
    few = diff.complete_by_id(pairs).rdd.getNumPartitions()
    monkeypatch.setattr(scale, "TASK_BYTES", 100)
    assert few < diff.complete_by_id(pairs).rdd.getNumPartitions() == 60


def files_read(df) -> set[str]:
    return {f.removeprefix("file://") for f in df.inputFiles()}


def test_texts_are_dealt_from_files_that_follow_their_bytes(spark, tmp_path):
    """A split of a packed table can hold any amount of text, all of it in one task's memory."""
    text, path = random.Random(1).randbytes(50_000).hex(), str(tmp_path / "packed")
    spark.range(100).select(F.col("id").alias("pair_id"), F.lit(text).alias("before")).coalesce(1).write.parquet(path)
    pairs = spark.read.parquet(path).withColumn("after", F.concat("before", F.lit("x")))
    packed = sum(map(os.path.getsize, files_read(pairs)))
    assert packed < 1e6
    for dealt, texts in ((diff.complete_by_id(pairs), 2), (scale.texts_by_id(pairs, "pair_id", "before"), 1)):
        assert sum(map(os.path.getsize, files_read(dealt))) > 0.5 * texts * 100 * len(text)


def test_stored_texts_are_not_stored_again(spark):
    pairs = spark.createDataFrame([(1, "x\ny", "x\nz"), (1, "x\ny", "x\nz"), (2, "a", None), (None, "p", "q")], "pair_id long, before string, after string")
    stored = store_texts(pairs)
    records = diff.injection_records(stored, diff.edit_script(diff.edits_of(stored)))
    assert files_read(records) == files_read(stored)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(records) == key(diff.injection_records(pairs, diff.edit_script(diff.edits_of(pairs))))


@pytest.mark.parametrize("query", ["edit_stats", "filter_edit_size", "location_targets", "drop_noop_edits"])
def test_edits_are_made_behind_one_exchange_of_stored_texts(spark, tmp_path, monkeypatch, query):
    """What a task of these queries holds follows the bytes of its partition on both sides of the exchange."""
    body = [". ".join(f"line {i} {j % 9}" for j in range(i % 40)) for i in range(60)] + [None, "", "a. a. b"]
    spark.createDataFrame([(i, t) for i, t in enumerate(body)] + [(7, "x. y, z"), (None, "p. q")], "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    few = catalog.QUERIES[query](spark, str(tmp_path)).collect()
    monkeypatch.setattr(scale, "TASK_BYTES", 700)
    many = catalog.QUERIES[query](spark, str(tmp_path))
    assert files_read(many) and all("/pairloom-texts-" in f for f in files_read(many))
    parts = re.findall(r"Exchange hashpartitioning\(pair_id#\d+L?, (\d+)\)", plan_of(many))
    assert len(parts) == 1 and int(parts[0]) > 12 and "Exchange hashpartitioning(" not in plan_of(many).replace("Exchange hashpartitioning(pair_id", "", 1)
    assert few and sorted(map(str, few)) == sorted(map(str, many.collect()))


def test_slices_are_entered_in_groups(spark, tmp_path):
    folder = str(tmp_path / "job")
    slices.prepare(spark.range(0, 60), ["id"], 5, folder)
    job = lambda rows: rows.where("id >= 5").select("id")
    assert slices.run(spark, folder, job) == list(range(12)) and slices.open_slices(spark, folder) == []
    assert len(glob.glob(f"{folder}/done/part-*")) == 1
    assert slices.result(spark, folder).count() == 55


@pytest.mark.parametrize("cells", [1, 100])
def test_a_sweep_moves_every_customer(cells):
    rng, full = np.random.default_rng(1), np.full(cells, 100)
    tables, sizes = pitman_yor.sweep(rng, full, np.full(cells, 1e15), 0.5, np.ones(cells, np.int64), full)
    assert tables.tolist() == [100] * cells and (sizes == 1).all()
