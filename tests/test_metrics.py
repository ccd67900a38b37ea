import math
import random
from collections import Counter

import numpy as np
import pytest
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from pairloom.operators import forest, learn
from pairloom.operators import metrics as M
from pairloom.operators import ranking as R


def confusion(spark, tp, fp, tn, fn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(0, 0)] * tn + [(1, 0)] * fn
    return M.confusion(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()


def test_published_confusion_numbers(spark):
    r = confusion(spark, 37, 27, 22, 15)
    assert (r.tp, r.fp, r.tn, r.fn) == (37, 27, 22, 15)
    for name, want in dict(accuracy=0.58416, precision=0.578125, recall=0.71154, f1=0.63793, mcc=0.16651).items():
        assert r[name] == pytest.approx(want, abs=5e-6)
    r = confusion(spark, 38, 34, 15, 14)
    for name, want in dict(accuracy=0.52475, precision=0.52778, recall=0.73077, f1=0.61290, mcc=0.04075).items():
        assert r[name] == pytest.approx(want, abs=6e-6)


def test_confusion_without_positives(spark):
    r = confusion(spark, 0, 0, 4, 0)
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_published_class_rates(spark):
    rows = [("CWE-787", 1, int(i < 18)) for i in range(24)] + [("CWE-20", 1, int(i < 98)) for i in range(114)]
    rows += [("CWE-20", 0, 1)] * 5
    got = {r.cwe: (r.proportion, round(100 * r.tpr)) for r in M.tpr_by_class(
        spark.createDataFrame(rows, "cwe string, y int, p int"), "y", "p").collect()}
    assert got == {"CWE-787": ("18/24", 75), "CWE-20": ("98/114", 86)}


def test_areas(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    area, last = 0.0, (0.0, 1.0)
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(s >= cut for s in pos), sum(s >= cut for _, s in rows)
        point = (tp / len(pos), tp / n)
        area += (point[0] - last[0]) * (point[1] + last[1]) / 2
        last = point
    assert M.pr_auc(df, "y", "s").first()[0] == pytest.approx(area)


def test_13a_tokens(column):
    assert column(M.tokens_13a, "It wasn't surprising.") == ["It", "wasn't", "surprising", "."]
    assert column(M.tokens_13a, "a,b 1,000 3-4 x-y &quot;q&quot;\nz(1)") == [
        "a", ",", "b", "1,000", "3", "-", "4", "x-y", '"', "q", '"', "z", "(", "1", ")"]


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def brute_bleu(pairs):
    match, total, hl, rl = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        h, r = h.split(), r.split()
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            a, b = grams(h, n), grams(r, n)
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    if not any(match):
        return 0.0
    logs, smooth = 0.0, 1
    for m, t in zip(match, total):
        if t == 0:
            return 0.0
        if m == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * t))
        else:
            logs += math.log(m / t)
    return 100 * (1.0 if hl >= rl else math.exp(1 - rl / hl)) * math.exp(logs / 4)


def brute_gleu(pairs):
    num = den = 0
    for h, r in pairs:
        h, r = h.split(), r.split()
        a, b = sum((grams(h, n) for n in range(1, 5)), Counter()), sum((grams(r, n) for n in range(1, 5)), Counter())
        num += sum((a & b).values())
        den += max(sum(a.values()), sum(b.values()))
    return num / den


TEXTS = [("a b c d e", "a b c d f"), ("the the the the", "the cat"), ("x", "x y z w v"),
         ("a b", "c d"), ("p q r s t u", "p q r s t u"), ("k l m", "k m l")]


def test_corpus_scores_against_brute_force(spark):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(TEXTS)], "pair_id long, h string, r string")
    stats = M.ngram_stats(df, "h", "r")
    assert M.corpus_bleu(stats).first()[0] == pytest.approx(brute_bleu(TEXTS))
    assert M.google_bleu(stats).first()[0] == pytest.approx(brute_gleu(TEXTS))
    row = M.macro_metrics(df, "h", "r").first()
    n = len(TEXTS)
    assert row.bleu == pytest.approx(sum(round(brute_bleu([p]), 4) for p in TEXTS) / n)
    assert row.google_bleu == pytest.approx(sum(round(brute_gleu([p]), 4) for p in TEXTS) / n)
    assert row.accuracy == pytest.approx(1 / n)
    assert row.gen_len == pytest.approx(sum(len(h.split()) for h, _ in TEXTS) / n)


def test_empty_texts_score_zero(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, "", "")], "pair_id long, h string, r string")
    assert M.corpus_bleu(M.ngram_stats(df, "h", "r")).first()[0] == 0.0
    assert M.macro_metrics(df, "h", "r").first().bleu == 0.0


def test_matches(spark):
    df = spark.createDataFrame([("a\n  b\n", "a\nb"), (" a", "a"), (None, "a"), ("x", "y")], "p string, t string")
    got = df.select(M.canonical_match(F.col("p"), F.col("t")), M.strip_match(F.col("p"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False), (False, False)]


def test_line_rankings(spark):
    rows = [(1, 0, .9, 0), (1, 1, .8, 1), (1, 2, .7, 0), (2, 0, .1, 0), (2, 1, .1, 1), (3, 0, .5, 0)]
    df = spark.createDataFrame(rows, "pair_id long, pos int, sc double, y int")
    assert sorted(tuple(r) for r in R.first_hits(df).collect()) == [(1, 2), (2, 2)]
    top = R.top_k_accuracy(df).first()
    assert (top.top_1, top.top_3) == (0.0, 1.0)
    assert R.initial_false_alarm(df).first()[0] == 1.0


def test_model_jobs(spark):
    rows = [(i, ("free strcpy ( a )" if i % 2 else "return len ;") + f" v{i % 7}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "pair_id long, t string, y int")
    scored = learn.bow_scores(learn.bow_forest(df, "t", "y"), df, "t", "pair_id").join(df, "pair_id")
    assert scored.where("predicted = y").count() == 80
    again = learn.bow_scores(learn.bow_forest(df, "t", "y"), df, "t", "pair_id")
    assert sorted(again.collect()) == sorted(scored.select("pair_id", "score", "predicted").collect())
    vectors = learn.token_embeddings(df, "t", "pair_id", size=5).collect()
    assert len(vectors) == 80 and all(len(r.embedding) == 6 for r in vectors)
    out = learn.batch_score(df, "t", "pair_id", lambda: pc.utf8_upper).collect()
    assert {r.pair_id: r.prediction for r in out} == {i: t.upper() for i, t, _ in rows}


def test_bags_of_words_are_those_of_the_forest(spark):
    """No two tokens share a column; ids follow document frequency, then the token."""
    rows = [(0, "b a a"), (1, "a c b"), (2, "b zz"), (3, ""), (4, None), (5, "only once")]
    df = spark.createDataFrame(rows, "pair_id long, t string")
    index = learn.feature_index(df, "t")
    assert sorted((r.feature_id, r.token, r.df) for r in index.collect()) == [(0, "b", 3), (1, "a", 2)]
    assert [r.token for r in learn.feature_index(df, "t", min_df=1, features=3).orderBy("feature_id").collect()] == ["b", "a", "c"]
    bags = {r.pair_id: dict(zip(r.ids, r.counts)) for r in learn.bow_vectors(df, "t", index, "pair_id").collect()}
    assert bags == {0: {0: 1, 1: 2}, 1: {0: 1, 1: 1}, 2: {0: 1}, 3: {}, 4: {}, 5: {}}
    model = learn.bow_forest(df.where("t is not null").withColumn("y", F.col("pair_id") % 2), "t", "y", trees=2)
    assert model.stages[0].vocabulary == ["b", "a"]


def test_forest_holds_no_row_wider_than_its_bag(spark):
    """The class hangs on how often a word comes; noise words fill a wide index."""
    rng = random.Random(4)
    rows = [(i, " ".join(["key"] * (i % 4) + [f"w{rng.randrange(300)}" for _ in range(30)]), int(i % 4 > 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "pair_id long, t string, y int")
    model = learn.bow_forest(df, "t", "y", trees=40, depth=3)
    grown = model.stages[1].trees
    at, key = model.stages[0].vocabulary.index("key"), grown.feature
    assert (key == at).any() and set(grown.above[key == at]) <= {0.5, 1.5, 2.5} and 1.5 in grown.above[key == at]
    scored = learn.bow_scores(model, df, "t", "pair_id").join(df, "pair_id").collect()
    assert np.mean([r.predicted == r.y for r in scored]) > 0.8 and all(0 <= r.score <= 1 for r in scored)


def test_forest_splits_are_the_best_ones(spark):
    """One tree without bootstrap noise in its gains: the first split against all splits tried by hand."""
    rng = random.Random(2)
    rows = [(i, " ".join(w for w in "abcd" for _ in range(rng.randrange(5))), rng.randrange(3)) for i in range(90)]
    df = spark.createDataFrame(rows, "pair_id long, t string, y int").coalesce(1)
    model = learn.bow_forest(df, "t", "y", trees=1, depth=2, seed=3)
    words, tree = model.stages[0].vocabulary, model.stages[1].trees
    times = forest._times_drawn(np.arange(90), 0, 3)
    counts, y = np.array([[t.split().count(w) for w in words] for _, t, _ in rows]), np.array([r[2] for r in rows])

    def impurity(keep):
        n = np.bincount(y[keep], times[keep], 3)
        return n.sum() * (1 - ((n / n.sum()) ** 2).sum()) if n.sum() else 0

    def gain(f, above):
        return impurity(times > 0) - impurity(counts[:, f] > above) - impurity(counts[:, f] <= above)
    best = max(gain(f, v + .5) for f in range(4) for v in range(4))
    assert gain(tree.feature[0, 1], tree.above[0, 1]) == pytest.approx(best)
    right = counts[:, tree.feature[0, 1]] > tree.above[0, 1]
    held = np.bincount(y[right], times[right], 3)
    assert tree.share[0, 3] == pytest.approx(held / held.sum())
    for r in learn.bow_scores(model, df, "t", "pair_id").collect():
        node = 1
        while (f := tree.feature[0, node]) >= 0:
            node = 2 * node + (counts[r.pair_id, f] > tree.above[0, node])
        assert r.score == pytest.approx(tree.share[0, node, 1]) and r.predicted == tree.share[0, node].argmax()


def test_length_model(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None, 2.0 * i + 1.5) for i in range(6)], "pair_id long, t string, y double")
    out = learn.batch_score(df, "t", "pair_id", learn.length_model(df, "t", "y"), T.LongType()).collect()
    assert {r.pair_id: r.prediction for r in out} == {0: None, **{i: 2 * i + 1 for i in range(1, 6)}}


def test_buckets_of_token_vectors(spark):
    df = spark.createDataFrame([(i, f"long{i} ( long_name{i} ) ;") for i in range(40)], "pair_id long, t string")
    vectors = learn.token_embeddings(df, "t", "pair_id", size=3, buckets=2).collect()
    assert {r.embedding[-1] for r in vectors} == {5.0}
