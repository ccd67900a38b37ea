import pytest
from pyspark.sql import functions as F, types as T

from pairloom import schema as S
from pairloom.sources import files

NASTY = [(1, "n,1", 'say "hi"\nnext, line\n', ""), (2, None, "  padded \t", None), (3, "", "\\back\\", "\"")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(NASTY, S.PAIRS)
    files.write_csv(df, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), S.PAIRS)
    assert sorted(map(tuple, got.collect())) == sorted(NASTY)
    again = files.csv_to_parquet(spark, str(tmp_path / "c"), str(tmp_path / "p"), S.PAIRS, ("before", "after"))
    assert sorted(map(tuple, again.collect())) == sorted(NASTY)


def test_csv_index_comes_first(spark, tmp_path):
    df = spark.createDataFrame([("x", 7)], "t string, pair_id long")
    files.write_csv(df, str(tmp_path / "c"), index="pair_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["pair_id", "t"]


def test_json_lines_report_bad_rows(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"func": "f", "target": 1}\n{"func": "g", "tar\n\n{"func": "h"}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "j.jsonl"), S.FUNCTION_CORPUS)
    assert sorted((r.func, r.target) for r in good.collect()) == [("f", 1), ("h", None)]
    assert [r.line for r in bad.collect()] == ['{"func": "g", "tar']
    files.write_jsonl(good.select("func", "target"), str(tmp_path / "out"))
    back, none = files.read_jsonl(spark, str(tmp_path / "out"), T.StructType(S.FUNCTION_CORPUS.fields[:2]))
    assert back.count() == 2 and none.count() == 0


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("offset"), F.lit("f").alias("file"))
    a = files.assign_row_id(df, ["file", "offset"]).select("pair_id", "offset")
    b = files.assign_row_id(df.repartition(13), ["file", "offset"]).select("pair_id", "offset")
    assert sorted(a.collect()) == sorted(b.collect()) == [(i, i) for i in range(200)]


def test_key_table_and_buckets(spark, tmp_path):
    files.write_keys(spark.createDataFrame([(1,), (1,), (2,)], "pair_id long"), str(tmp_path / "k"))
    assert sorted(r.pair_id for r in files.read_keys(spark, str(tmp_path / "k")).collect()) == [1, 2]


@pytest.mark.parametrize("form", ["json", "csv", "text", "parquet"])
def test_ids_without_a_key_follow_files_and_places(spark, tmp_path, form):
    """Several files, one of them empty, read with two split sizes."""
    want = []
    for name, n in (("a", 700), ("b", 0), ("c", 1), ("d", 2500)):
        values = [f"{name} {i % 3}" for i in range(n)]
        want += values
        part = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
        getattr(part.write, form)(str(tmp_path / name))
    reader = spark.read if form == "parquet" else spark.read.schema("value string")
    found = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = reader.format(form).load([str(tmp_path / x) for x in "dcba"])
            found.append((df.rdd.getNumPartitions(), sorted(files.file_row_ids(df, "id").collect(), key=lambda r: r.id)))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][0] > found[1][0] or form == "parquet"  # one row group a file
    for _, rows in found:
        assert [r.id for r in rows] == list(range(len(want))) and [r.value for r in rows] == want


def test_ids_without_a_key_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "value string").write.parquet(str(tmp_path / "none"))
    assert files.file_row_ids(spark.read.parquet(str(tmp_path / "none"))).collect() == []
