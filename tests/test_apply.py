import pytest
from pyspark.sql import functions as F

from pairloom.functions.arrays import fold_list
from pairloom.operators import apply as A


@pytest.fixture
def applied(spark):
    def run(before, locations, injections):
        df = spark.createDataFrame([(1, before, locations, injections)],
                                   "pair_id long, before string, locations string, injections string")
        return A.apply_edits(df).first()
    return run


@pytest.mark.parametrize("before,loc,inj,want", [
    ("a\n  b\nc", "b", "x", "a\n  x\nc"),                       # indent stays
    ("a\nb\nc", " b", " EmptyLine", "a\nc"),                    # removed line
    ("a\nb", "a", "x<s> y", "x\n y\nb"),                        # several lines
    ("a\nb", "Empty", "A:a<endRow>n1\nA:a<endRow>n2", "a\nn1\nn2\nb"),
    ("a\nb", "Empty", "A:<endRow>head", "head\na\nb"),
    ("a\nb\na ", "a\na ", "x\ny", "x\nb\ny"),                   # unique by right blanks
    ("a\nb\na", "a\na", "x\ny", "x\nb\ny"),                     # repeated lines: one walk
    ("a\n\nb", "b", "c", "a\nc"),                               # blank lines vanish
    ("+a\nb", "b", "c", "+a\nc"),                               # a source line may start with +
    ("b", "b", "Ax = 1;", "Ax = 1;"),                           # A alone is no insert tag
    ("a\nb", "b", "A:a<endRow>n\nc", "a\nn\nc"),
    ("a", "a", "A:a<endRow>1\nx\nA:a<endRow>2", "x\n2\n1"),     # later group lands first
])
def test_apply(applied, before, loc, inj, want):
    r = applied(before, loc, inj)
    assert (r.status, r.generated) == ("ok", want)


def test_blocked_location_holds_up_the_rest(applied):
    r = applied("a\nb\nc", "b\na\nc", "1\n2\n3")
    assert (r.status, r.generated, r.n_applied) == ("ok", "a\n1\nc", 1)


def test_substring_passes_presence_but_not_the_walk(applied):
    r = applied("call(x)", "x", "y")
    assert (r.status, r.generated, r.n_applied) == ("ok", "call(x)", 0)


@pytest.mark.parametrize("before,loc,inj,status", [
    (None, "a", "b", "IS NAN"), ("a", None, "b", "IS NAN"), ("a", "z", "b", "no location"),
    ("a", "a", "a", "wrong location"), ("a", "a", None, "error"), ("a", "a", "", "error"),
    ("a", "a", "A:zz<endRow>n", "error"), ("a", "Empty", "x", "ok"), ("", "", "x", "ok"),
])
def test_status(applied, before, loc, inj, status):
    r = applied(before, loc, inj)
    assert r.status == status
    assert (r.generated is None) == (status != "ok")


def test_summary_and_in_band(spark):
    df = spark.createDataFrame(
        [(1, "a", "a", "b"), (2, "a", "z", "b"), (3, "a", "a", "a"), (4, None, None, None)],
        "pair_id long, before string, locations string, injections string")
    done = A.apply_edits(df)
    counts = {r.status: (r.pairs, r.usable) for r in A.status_summary(done).collect()}
    assert counts == {"ok": (1, True), "no location": (1, False),
                      "wrong location": (1, False), "IS NAN": (1, False)}
    strict = {r.pair_id: r.generated for r in A.in_band(done).collect()}
    assert strict == {1: "b", 2: "no location", 3: "wrong location", 4: "IS NAN"}
    custom = {r.pair_id: r.generated for r in A.in_band(done, "custom").collect()}
    assert custom == {1: "b", 2: "", 3: "", 4: ""}
    assert done.where(A.problem()).count() == 3 and done.where(A.problem("custom")).count() == 2


def test_row_wise_plan(spark):
    df = spark.createDataFrame([(1, "a", "a", "b")],
                               "pair_id long, before string, locations string, injections string")
    plan = A.apply_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_every_line_of_a_long_text_is_replaced(spark):
    n = 20_000
    lines = [f"line {i} x" for i in range(n)]
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(lines), "\n".join(f"new {i}" for i in range(n)))],
                               "pair_id long, before string, locations string, injections string")
    done = A.apply_edits(df).first()
    assert (done.status, done.n_applied) == ("ok", n) and done.generated == "\n".join(f"new {i}" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1600])
def test_fold_of_a_list(spark, n):
    """Running sums of even numbers, over block borders."""
    df = spark.createDataFrame([(list(range(n)), None)], "v array<int>, none array<int>")
    step = lambda s, x: (s + x, F.when(x % 2 == 0, F.array(s + x)).otherwise(F.array().cast("array<int>")))
    row = df.select(fold_list(F.col("v"), F.lit(0), step, "int").alias("l"),
                    fold_list(F.col("none"), F.lit(0), step, "int").alias("none")).first()
    assert row.l == [x * (x + 1) // 2 for x in range(0, n, 2)] and row.none is None


def test_locations_that_are_part_of_a_line(column):
    present = lambda b, l: A.locations_present(b, l)
    assert column(present, "a b c\n  d", "b c\n d \na b c") is True
    assert column(present, "a b c\n  d", "a b c\nx") is False
    assert column(present, "a", "Empty") is True and column(present, None, "a") is None
