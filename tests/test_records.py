import pytest
from pyspark.sql import functions as F

from pairloom import schema as S
from pairloom.functions import wire
from pairloom.operators import records as R
from pairloom.operators import tables as T
from pairloom.plans import datasets, slices


def test_prompt_and_cut(spark):
    df = spark.createDataFrame([(1, "f()", "x"), (2, "Instruction:\n", "y")], "pair_id long, f string, a string")
    p = df.select("pair_id", wire.prompt(F.col("f"), F.col("a"), "<e>").alias("prompt"))
    rows = {r.pair_id: r for r in R.split_prompt(p).collect()}
    assert rows[1].prompt == "function:\nf()\nInstruction:\nx<e>"
    assert (rows[1].model_input, rows[1].target) == ("function:\nf()\nInstruction:\n", "x<e>")
    assert rows[2].model_input == "function:\nInstruction:\n"      # first marker counts
    bare = R.split_prompt(spark.createDataFrame([("zz",)], "prompt string")).first()
    assert (bare.model_input, bare.target) == ("zz", "")


def test_token_limits(spark):
    df = spark.createDataFrame([(1, 1400), (2, 1401)], "pair_id long, n int")
    kept, rest = R.within_limit(df, "n")
    assert [r.pair_id for r in kept.collect()] == [1] and [r.pair_id for r in rest.collect()] == [2]


def test_oversize_rows(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "pair_id long, n_in int, n_out int")
    ids = lambda df: sorted(r.pair_id for r in R.oversize_rows(df).collect())
    assert ids(make((1, 2047, 10), (2, 2048, 10))) == [2]
    assert ids(make((1, 1, 500), (2, 1, 501), (3, 1, 499))) == [1, 2]
    assert ids(make((1, 1, 500), (2, 1, 499))) == []               # longest is not above 500


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, "a a a zz")], "pair_id long, t string")
    vocab = R.vocabulary(df, "t")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids == {"a": 1, "b": 2, "c": 3, "zz": 4}
    rows = {r.pair_id: r for r in R.encode_tokens(df, "t", vocab, length=3).collect()}
    assert rows[1].input_ids == [2, 1, 2] and rows[2].input_ids == [0, 0, 0]
    assert rows[3].attention_mask == [1, 1, 1] and rows[2].attention_mask == [0, 0, 0]
    whole = {r.pair_id: r for r in R.encode_tokens(df, "t", vocab, length=None).collect()}
    assert whole[1].input_ids == [2, 1, 2, 3] and whole[2].input_ids == [] and whole[2].n_tokens == 0
    known = vocab.where("token <> 'zz'")
    assert {r.pair_id: r.input_ids for r in R.encode_tokens(df, "t", known, length=4).collect()}[3] == [1, 1, 1, 0]


def test_one_long_text_widens_no_other_row(spark):
    texts = [(i, " ".join(["a"] * n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 8, 9, 1023, 1025, 50_000])]
    df = spark.createDataFrame([*texts, (99, None)], "pair_id long, t string")
    rows = {r.pair_id: r for r in R.encode_tokens(df, "t", R.vocabulary(df, "t")).collect()}
    assert [len(rows[i].input_ids) for i, _ in texts] == [0, 1, 2, 4, 4, 8, 8, 16, 1024, 2048, 65536]
    assert all(sum(r.attention_mask) == r.n_tokens and len(r.attention_mask) == len(r.input_ids) for r in rows.values())
    assert all(len(r.input_ids) <= 2 * r.n_tokens for r in rows.values())
    totals = {r.width: r for r in R.bucket_totals(R.encode_tokens(df, "t", R.vocabulary(df, "t"))).collect()}
    assert (totals[8].texts, totals[8].tokens, totals[8].cells) == (2, 13, 16) and totals[0].texts == 2


def test_job_over_slices_is_stopped_and_resumed(spark, tmp_path):
    folder, seen = str(tmp_path / "job"), []

    def job(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", (F.col("id") * 2).alias("twice"))

    df = spark.range(0, 95).repartition(7)
    assert slices.prepare(df, ["id"], 10, folder) == {i: 10 if i < 9 else 5 for i in range(10)}
    assert slices.run(spark, folder, job, limit=2) == [0, 1]
    assert sorted(r.id for r in slices.result(spark, folder).collect()) == list(range(20))

    def breaks(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        slices.run(spark, folder, breaks)
    # A slice whose output was written but not entered is written anew.
    spark.range(500).withColumn("twice", F.lit(0)).write.parquet(f"{folder}/out/chunk=2")
    assert slices.open_slices(spark, folder) == list(range(2, 10))
    assert slices.prepare(spark.range(3), ["id"], 1, folder) == {i: 10 if i < 9 else 5 for i in range(10)}
    assert slices.run(spark, folder, job) == list(range(2, 10)) and slices.run(spark, folder, job) == []
    assert sorted((r.id, r.twice, r.chunk) for r in slices.result(spark, folder).collect()) == [(i, 2 * i, i // 10) for i in range(95)]
    assert [x for s in seen for x in s] == list(range(95))          # no slice twice, none lost
    with pytest.raises(ValueError):
        slices.result(spark, str(tmp_path / "nothing"))


def test_mask_label_padding(spark):
    df = spark.createDataFrame([([5, 0, 0, 0],), ([5, 6],), ([0, 7, 0],)], "l array<int>")
    got = [r[0] for r in df.select(R.mask_label_padding(F.col("l"))).collect()]
    assert got == [[5, 0, -100, -100], [5, 6], [0, -100, -100]]


def test_split_balanced(spark):
    df = spark.range(130).select("id", (F.col("id") < 20).cast("int").alias("y"))
    rows = R.split_balanced(df, "y", "id").collect()
    for y in (0, 1):
        sizes = [sum(r.y == y and r.split == s for r in rows) for s in ("train", "val", "test")]
        assert sizes == [16, 2, 2]


def test_chunk_rows(spark):
    rows = R.chunk_rows(spark.range(25), ["id"], 10).orderBy("id").collect()
    assert [r.chunk for r in rows] == [0] * 10 + [1] * 10 + [2] * 5


def test_table_operators(spark):
    df = spark.createDataFrame(
        [(1, "CVEFixes_ab_CWE-1", None), (2, "Other_x", "t"), (3, "CVEFixes", "print it")],
        "pair_id long, name string, t string")
    assert [r.commit_id for r in T.from_source(df, "CVEFixes").orderBy("pair_id").collect()] == ["ab", None]
    a, b = T.drop_where_contains(df, "t", "print", "pair_id", df, df.select("pair_id"))
    assert a.count() == 2 and b.count() == 2
    assert T.drop_missing(df, "t").count() == 2
    assert T.fill_missing(df, "t").where("t = ''").count() == 1
    assert T.exclude_rows(df, df.where("pair_id = 1")).count() == 2
    assert [r.pair_id for r in T.sample_k(df, 2, "s", "pair_id").collect()] == \
        [r.pair_id for r in T.sample_k(df.repartition(5), 2, "s", "pair_id").collect()]
    sizes = spark.createDataFrame([(4,), (5,), (29,)], "n int")
    assert [tuple(r)[1:] for r in T.size_buckets(sizes, "n").collect()] == [
        (True, True, True, True), (False, True, True, True), (False, False, False, True)]


def test_commit_to_cwe(spark):
    patches = spark.createDataFrame(
        [("a", "CWE-1", 1), ("a", "CWE-2", 2), ("a", "NA", 3), ("b", "CWE-2", 4), ("c", "CWE-9", 5)],
        "commit_id string, cwe string, row_id long")
    commits = spark.createDataFrame([("a",), ("b",), ("zz",)], "commit_id string")
    assert [r.cwe for r in T.commit_to_cwe(patches, commits).collect()] == ["CWE-2"]


def test_dataset_table(pair_table):
    p = pair_table(("int f()\n{\na;\n}", "int f()\n{\nb;\n}"), ("x", "x"), (None, "q"),
                   ("\n".join(f"l{i}" for i in range(40)), "w"))
    assert {r.pair_id for r in datasets.dataset_table(p).collect()} == {0, 1, 3}
    rows = {r.pair_id: r for r in datasets.dataset_table(p, max_lines=15).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].lines_with_vul, rows[0].lines_after_fix) == (" b; }", " a; }")
    assert (rows[1].lines_with_vul, rows[1].lines_after_fix) == ("", "")


def test_build_records(spark, pair_table):
    p = pair_table(("  a\nb", "a\nc"), ("a\nb ", "a\nc"), ("z", "y"), (None, "n"))
    train = {r.pair_id: r for r in datasets.build_records(
        p, spark.createDataFrame([(2,)], "pair_id long")).collect()}
    assert set(train) == {0, 3}
    assert train[0].inputs == "a\nb" + S.END_OF_FUNCTION + " b" and train[0].outputs == " c"
    assert train[3].outputs == "A:<endRow>n"
    assert datasets.build_records(p, dedup_rows=False).count() == 4


def test_generate_and_score(spark, pair_table):
    p = pair_table(("a\nb", "a\nc"), ("a\nb", "a\nd"), ("q", "r"))
    preds = spark.createDataFrame([(0, "b", "c"), (1, "b", "c")], S.PREDICTIONS)
    r = datasets.score(datasets.generate(p, preds)).first()
    assert (r.pairs, r.matched, r.problems) == (3, 1, 1)


def test_dataset_table_and_location_records(spark):
    from pyspark.sql import functions as F
    from pairloom.plans import datasets, slices

    long = "\n".join(f"l{i}" for i in range(40))
    pairs = spark.createDataFrame([
        (1, "  a\nb", "  a\nc"), (2, long, long.replace("l", "m")), (3, "x", "x"), (4, None, "x"), (5, "  a\nb", "  a\nc")],
        "pair_id long, before string, after string")
    table = datasets.dataset_table(pairs)
    assert sorted(r.pair_id for r in table.collect()) == [1, 2, 3, 5]
    assert sorted(r.pair_id for r in datasets.dataset_table(pairs, max_lines=15).collect()) == [1, 3, 5]
    prompts = lambda **k: {r.pair_id: r.prompt for r in datasets.location_records(table, **k).collect()}
    assert sorted(prompts()) == [1, 2, 3]
    assert sorted(prompts(dedup_rows=False)) == [1, 2, 3, 5]
    assert sorted(prompts(dedup_rows=F.col("pair_id") > 2)) == [1, 2, 3, 5]
    assert prompts()[1].endswith("Instruction:\n b") and prompts(with_spaces=False)[1].endswith("Instruction:\nb")
    assert prompts()[1].startswith("function:\na\n")
    some = spark.createDataFrame([(1,)], "pair_id long")
    assert sorted(prompts(excluded=some)) == [2, 3, 5]
