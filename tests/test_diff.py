import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions.arrays import let, places
from pairloom.operators import diff as D
from pairloom.plans import datasets

PAIRS = [
    ("a\nb\nc", "a\nx\nc"),            # replace
    ("a", "z\na\ny"),                  # head and tail insert
    ("d1\nd2\nk", "n1\nk"),            # two deletes, one insert
    ("a\nb\nc", "a\nx\ny\nz\nc"),      # replace by three lines
    ("m\na\nb\nc", "a\nb\nc\nm"),      # moved block
    ("\n".join("x" * 20), "\n".join("x" * 18)),
    ("a\nb", "a\nb"),                  # equal
    ("a\nb\nc", "u\nv\nw"),            # all lines replaced
    ("a\n  b\nc", "a\nb\nc"),          # white space only
    ("a\nb", "+b\n<s>\nEmptyLine\nq<endRow>r\nA:z"),
    ("if (x)\n\n\ny", "if (x)\n\nz\n\ny"),
    ("one", ""),
]


def script(pair_table, *pairs):
    edits = D.edits_of(pair_table(*pairs)).orderBy("pair_id", "gap", "idx")
    out = {}
    for r in edits.collect():
        out.setdefault(r.pair_id, []).append((r.kind, r.key, list(r.value)))
    return out


def test_diff_rebuilds_after(pair_table):
    rng = random.Random(5)
    words = ["a", "b", "c", "{", "}", "return", ""]
    made = [("\n".join(rng.choices(words, k=rng.randint(1, 30))),
             "\n".join(rng.choices(words, k=rng.randint(1, 30)))) for _ in range(60)]
    cases = PAIRS + made
    rows = D.line_diff(pair_table(*cases)).collect()
    for i, (before, after) in enumerate(cases):
        mine = [r for r in rows if r.pair_id == i]
        on_a = sorted((r.apos, r.line) for r in mine if r.op != "D")
        on_b = sorted((r.bpos, r.line) for r in mine if r.op != "I")
        assert "\n".join(l for _, l in on_a) == after
        assert "\n".join(l for _, l in on_b) == before
        kept = sorted((r.bpos, r.apos) for r in mine if r.op == "K")
        assert all(x[1] < y[1] for x, y in zip(kept, kept[1:]))
        gone = sorted(r.line for r in mine if r.op == "D" and r.moved)
        new = sorted(r.line for r in mine if r.op == "I" and r.moved)
        assert gone == new


def test_missing_side_gives_no_rows(pair_table):
    assert D.line_diff(pair_table((None, "a"), ("a", None))).count() == 0


def test_edit_kinds(pair_table):
    got = script(pair_table, *PAIRS)
    assert got[0] == [("replace", "b", ["x"])]
    assert got[1] == [("insert", None, ["z"]), ("insert", "a", ["y"])]
    assert got[2] == [("remove", "d1", []), ("replace", "d2", ["n1"])]
    assert got[3] == [("replace", "b", ["x", "y", "z"])]
    assert got[4] == [("remove", "m", []), ("insert", "c", ["m"])]
    assert got[5] == [("remove", "x", []), ("remove", "x", [])]
    assert 6 not in got and 8 not in got
    assert got[7] == [("remove", "a", []), ("remove", "b", []), ("replace", "c", ["u", "v", "w"])]


def test_exact_key_needs_noop_filter(pair_table):
    h = D.hunk_edits(D.hunks(D.line_diff(pair_table(("a\n  b\nc", "a\nb\nc")), "exact")))
    assert h.count() == 1 and D.drop_noop_edits(h).count() == 0


def test_anchor_of_second_insert_is_a_kept_line(pair_table):
    rows = D.insert_anchors(D.line_diff(pair_table(("a\nb", "a\nx\ny\nb\nz")))).orderBy("apos").collect()
    assert [(r.line, r.anchor) for r in rows] == [("x", "a"), ("y", "a"), ("z", "b")]


@pytest.mark.parametrize("n", [1, 4, 6])
def test_longest_increasing_against_brute_force(spark, n):
    perms = list(itertools.permutations(range(n)))
    rng = random.Random(n)
    perms += [tuple(rng.sample(range(100), 40)) for _ in range(5)]
    df = spark.createDataFrame([(list(p),) for p in perms], "s array<int>")
    rows = df.select("s", let(F.col("s"), D.longest_increasing).alias("at")).collect()
    for r in rows:
        picked = [r.s[i] for i in r.at]
        assert picked == sorted(picked) and r.at == sorted(r.at)
        best = [1] * len(r.s)
        for i in range(len(r.s)):
            best[i] += max((best[j] for j in range(i) if r.s[j] < r.s[i]), default=0)
        assert len(picked) == max(best)


def test_location_targets(pair_table):
    scripts = D.edit_script(D.edits_of(pair_table(*PAIRS)))
    got = {r.pair_id: (r.lines_with_vul, r.lines_after_fix)
           for r in D.location_targets(scripts).collect()}
    assert got[0] == (" x", " b")
    assert got[1] == ("z\ny", "")
    assert got[2] == (" n1", " d1\n d2")
    big = pair_table(("\n".join(f"l{i}" for i in range(40)), "q"))
    row = D.location_targets(D.edit_script(D.edits_of(big))).first()
    assert row.lines_with_vul is None and row.lines_after_fix is None
    stats = D.edit_stats(D.edit_script(D.edits_of(big))).first()
    assert (stats.pairs, stats.oversize, stats.kept) == (1, 1, 0)


def test_injection_records(pair_table):
    p = pair_table(*PAIRS)
    got = {r.pair_id: (r.inputs, r.outputs)
           for r in D.injection_records(p, D.edit_script(D.edits_of(p))).collect()}
    assert got[2] == ("d1\nd2\nk<|endoftext|>\n d1\n d2", "EmptyLine\n n1")
    assert got[3][1] == " x<s> y<s> z"
    assert got[1] == ("a<|endoftext|>\nEmpty", "A:<endRow>z\nA:a<endRow>y")
    assert got[6] == ("a\nb<|endoftext|>\nEmpty", "")


def test_round_trip(pair_table):
    rows = datasets.round_trip(pair_table(*PAIRS)).collect()
    assert len(rows) == len(PAIRS)
    for r in rows:
        assert (r.status, r.same) == ("ok", True), (PAIRS[r.pair_id], r)


def test_round_trip_on_random_pairs(pair_table):
    rng = random.Random(11)
    pool = [f"stmt{i};" for i in range(12)] + ["{", "}", "  return x;"]
    made = []
    for _ in range(80):
        before = rng.choices(pool, k=rng.randint(1, 25))
        after = list(before)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(after) + 1)
            move = rng.random()
            if move < 0.4:
                after.insert(at, f"new{rng.randint(0, 9)};")
            elif move < 0.7 and at < len(after):
                after[at] = f"edit{rng.randint(0, 9)};"
            elif at < len(after) and len(after) > 1:
                after.append(after.pop(at))
        made.append(("\n".join(before), "\n".join(after)))
    bad = [(made[r.pair_id], r) for r in datasets.round_trip(pair_table(*made)).collect() if not r.same]
    assert not bad


def test_contiguous_locations(spark):
    df = spark.createDataFrame([
        (1, "a\nb\nc", "b\nc"), (2, "a\nb\nc", "a\nc"), (3, "a\nb", "b\nz"),
        (4, "a", "q"), (5, " a \nb", "a\n b")], "pair_id long, before string, locations string")
    got = dict(D.contiguous_locations(df).collect())
    assert got == {1: True, 2: False, 3: True, 4: None, 5: True}


def test_one_exchange_for_the_whole_script(spark, pair_table, tmp_path):
    pair_table(*PAIRS).write.parquet(str(tmp_path / "p"))
    plan = D.edit_script(D.edits_of(spark.read.parquet(str(tmp_path / "p")))) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan


def test_places(spark):
    df = spark.createDataFrame([(4, [2, 0]), (0, []), (2, [])], "n int, at array<int>")
    got = [r[0] for r in df.select(places(F.col("n"), F.col("at"))).collect()]
    assert got == [[2, 0, 1, 0], None, [0, 0]]


def test_pairs_without_an_edit_stay(spark):
    df = spark.createDataFrame([
        (1, "a\nb", "a\nb"), (2, "", ""), (3, "a", "b"), (4, None, "x"), (5, " a", "a")],
        "pair_id long, before string, after string")
    scripts = D.scripts_of(df)
    assert {r.pair_id: len(r.script) for r in scripts.collect()} == {1: 0, 2: 0, 3: 1, 5: 0}
    targets = {r.pair_id: (r.lines_with_vul, r.lines_after_fix) for r in D.location_targets(scripts).collect()}
    assert targets == {1: ("", ""), 2: ("", ""), 3: (" b", " a"), 5: ("", "")}
    assert D.edit_stats(scripts).first().pairs == 4


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_words_changed_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for k in range(80):
        n, kinds = rng.choice([0, 1, 5, 30, 200]), rng.choice([2, 40, 1000])
        a = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        b = [x for x in a if rng.random() < 0.8] + [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(5))]
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: r.n for r in df.select("k", D.words_changed(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: edit_distance(a, b) for k, a, b in rows}


def test_changed_words_of_a_pair(spark, pair_table):
    long = " ".join(f"w{i}" for i in range(30))
    pairs = pair_table(
        (f"head\n{long}\nend", f"head\n{long.replace('w11 ', 'other ')}\nend"),      # one word of thirty
        ("head\na b c\nend", "head\nend"),                                          # a pure deletion
        ("head\nend", "head\nd e f g\nend"),                                        # a pure insertion
        ("head\nend", "head\nend"),
        ("head\na b\nc d\nend", "head\na x\nend"),                                 # a line gone, one replaced
        ("", "one"))
    sizes = D.scripts_of(pairs).select("pair_id", D.changed_words(F.col("script")).alias("n"))
    got = {r.pair_id: r.n for r in sizes.collect()}
    assert got[0] == 1 and got[1] == 3 and got[2] == 4 and got[3] == 0 and got[5] == 1
    assert got[4] == 2 + 2


def test_a_long_line_with_a_small_change_is_cheap(spark, pair_table):
    words = [f"w{i}" for i in range(40_000)]
    other = [*words[:20_000], "new", *words[20_001:]]
    pairs = pair_table(("k\n" + " ".join(words), "k\n" + " ".join(other)))
    assert D.scripts_of(pairs).select(D.changed_words(F.col("script"))).first()[0] == 1


def test_scripts_read_the_texts_once(spark, tmp_path):
    rows = [("a", "x\ny", "x\nz"), ("b", "same\nlines", "same\nlines"), ("c", "", ""), ("d", "\n \n", "new"), ("e", None, "x"), ("f", "p\nq\nr", "q")]
    spark.createDataFrame(rows, "pair_id string, before string, after string").write.parquet(str(tmp_path / "pairs"))
    made = D.scripts_of(spark.read.parquet(str(tmp_path / "pairs")))
    got = {r.pair_id: [(e.ord, e.kind, e.key, e.value) for e in r.script] for r in made.collect()}
    assert got == {
        "a": [(1, "replace", "y", ["z"])], "b": [], "c": [], "d": [(1, "insert", None, ["new"])],
        "f": [(1, "remove", "p", []), (2, "remove", "r", [])]}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
