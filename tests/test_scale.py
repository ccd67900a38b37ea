import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import dedup, scale
from pairloom.operators import ranking as R
from pairloom.session import durable, scratch_path, shared_dir


@pytest.fixture
def hot_rows(spark):
    """One key holds a third of all rows."""
    return spark.range(900).select(
        F.col("id").alias("pair_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
        .alias("k"))


def test_duplicate_groups_of_a_hot_key(hot_rows):
    got = dedup.duplicate_groups(hot_rows, F.col("k")).where("fingerprint = 'hot'")
    assert sorted(r.pair_id for r in got.collect()) == list(range(0, 900, 3))
    assert got.select("copies", "first_id").distinct().collect() == [(300, 0)]


def test_keep_first(hot_rows):
    kept = dedup.keep_first(hot_rows, F.col("k")).collect()
    first = {}
    for r in sorted(hot_rows.collect()):
        first.setdefault(r.k, r.pair_id)
    assert sorted(r.pair_id for r in kept) == sorted(first.values())
    again = dedup.keep_first(hot_rows.where(F.col("pair_id").isin([r.pair_id for r in kept])), F.col("k"))
    assert again.count() == len(kept)


def test_keep_first_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "pair_id long, k string")
    assert sorted(r.pair_id for r in dedup.keep_first(rows, F.col("k")).collect()) == [1, 2, 3]
    assert sorted(r.pair_id for r in dedup.duplicate_groups(rows, F.col("k")).collect()) == [3, 4]


def test_hot_join_key_is_split_at_run_time(spark, tmp_path):
    """One token with most rows: the join with its one-row table reads it in several tasks."""
    old = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
        rows = spark.range(40000, numPartitions=8).select(
            F.col("id").alias("pair_id"), F.when(F.col("id") % 100 > 0, "hot").otherwise(F.sha1(F.col("id").cast("string"))).alias("k"))
        got = dedup.duplicate_groups(rows, F.col("k"))
        assert len(got.collect()) == 39600
        got.write.parquet(str(tmp_path / "out"))
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_effort_cuts_without_a_true_row(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 0), (2, 0, 0.4, 0)], "pair_id long, pos int, sc double, y int")
    assert R.recall_at_effort(rows, 0.5).first().recall == 0.0
    assert R.recall_by_probability(rows.withColumnRenamed("pair_id", "id"), 0.5).first().recall == 0.0


def test_keep_first_moves_no_hot_group(hot_rows):
    plan = dedup.keep_first(hot_rows, F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_global_running(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(3)
        rows = [(i, rng.choice([1, 1, 1, 5, 9]), rng.choice("ab")) for i in range(500)]
        df = spark.createDataFrame(rows, "id long, v int, c string")
        order = [F.desc("v"), F.asc("id")]
        got = scale.global_running(df, order, {"run": F.col("v")}, row_number="rn").collect()
        total = 0
        for want, r in zip(sorted(rows, key=lambda x: (-x[1], x[0])), sorted(got, key=lambda r: r.rn)):
            total += want[1]
            assert (r.id, r.run) == (want[0], total)
        numbered = scale.number_rows(df.repartition(5), order, "rn").collect()
        assert [r.id for r in sorted(numbered, key=lambda r: r.rn)] == \
            [r[0] for r in sorted(rows, key=lambda x: (-x[1], x[0]))]
        assert sorted(r.rn for r in numbered) == list(range(1, 501))
        per = scale.global_running(df, [F.asc("c"), *order], {}, by=["c"], row_number="rn").collect()
        for c in "ab":
            mine = sorted((r.rn, -r.v, r.id) for r in per if r.c == c)
            assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
            assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cuts_with_one_score_for_most_rows(spark):
    rng = random.Random(9)
    rows = [(i // 20, i % 20, 0.5 if i % 4 else rng.random(), int(rng.random() < 0.1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "pair_id long, pos int, sc double, y int")
    ranked = [r[3] for r in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))]
    hits, run, want = sum(ranked), 0, None
    for i, y in enumerate(ranked, 1):
        run += y
        if run >= 0.2 * hits:
            want = i / len(ranked)
            break
    assert R.effort_at_recall(df).first()[0] == pytest.approx(want)
    assert R.recall_at_effort(df).first()[0] == pytest.approx(sum(ranked[:20]) / hits)
    few = df.where("pair_id = 0")
    assert R.recall_at_effort(few).count() == 1


class FakeSession:
    """The parts of a session that the folder choice looks at."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_shared_dir():
    assert shared_dir(FakeSession("yarn", "hdfs:/shared")) == "hdfs:/shared"
    assert scratch_path(FakeSession("yarn", "hdfs:/shared/"), "t").startswith("hdfs:/shared/t-")
    with pytest.raises(ValueError):
        shared_dir(FakeSession("yarn"))


def test_durable_keeps_values(spark):
    df = durable(spark.range(10).withColumn("p", F.spark_partition_id()))
    assert sorted(df.collect()) == sorted(df.repartition(3).collect())


def test_split_leaks(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b"), (5, "c")], "pair_id long, k string")
    test = spark.createDataFrame([(10, "b"), (11, None), (12, "z"), (13, "b"), (14, "")], "pair_id long, k string")
    found = dedup.split_leaks(train, test, F.col("k"))
    assert sorted(map(tuple, found.collect())) == [("test", 10, "b"), ("test", 13, "b"), ("train", 2, "b"), ("train", 4, "b")]
    assert dedup.split_leaks(train.limit(0), test, F.col("k")).count() == 0


def test_split_leaks_with_a_full_filter(hot_rows, spark, monkeypatch):
    monkeypatch.setattr(dedup, "FILTER_BITS", 64)
    test = spark.createDataFrame([(5000, "hot"), (5001, "k7"), (5002, "none")], "pair_id long, k string")
    found = dedup.split_leaks(hot_rows, test, F.col("k")).collect()
    want = {i for i in range(900) if i % 3 == 0 or i % 50 == 7}
    assert {r.pair_id for r in found if r.split == "train"} == want
    assert {r.pair_id for r in found if r.split == "test"} == {5000, 5001}


def test_split_leak_filter_stays_small(spark):
    keys = spark.range(300_000).select(F.col("id").cast("string").alias("fingerprint"))
    assert dedup._filter_of(keys).count() <= dedup.FILTER_BITS // 64
