"""Near-duplicates, benchmark windows, fuzzy lines and components against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.llm import components, decontaminate, fuzzy_lines, near_dups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _row string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", 0, "x", "y") for i, t in zip(ids, texts)], DOCS)


def words(n, start=0, step=1):
    return " ".join(f"w{start + step * i}" for i in range(n))


TEXTS = [
    words(60), words(60), words(60).upper(), words(59) + " other", words(40), "tiny text", "Tiny  TEXT", "", None, " \t\n",
    words(3000, 5000), words(2990, 5000), words(60, 200), words(30) + " " + words(30, 900), "\u00c9t\u00e9 " + words(20, 70),
    "\u00e9t\u00e9 " + words(20, 70), "tiny", words(5, 40), words(6, 40), None,
]


def expected_components(texts, ids, similar=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= similar * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (len(sets[i]), min(groups[find(i)])) for i in range(len(texts))}


def test_near_duplicates_match_brute_force(spark):
    got = {r.doc_id: r for r in near_dups.near_duplicates(table(spark, TEXTS)).collect()}
    want = expected_components(TEXTS, list(range(len(TEXTS))))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_a_large_group_in_small_tiles(spark, monkeypatch):
    """Variants of one text, some beyond the limit: tiles and lists lose no link."""
    monkeypatch.setattr(near_dups, "TILE", 8)
    texts = [" ".join(f"x{i}" if (i * 31 + k * 7) % (9 + k % 30) else f"y{i}_{k}" for i in range(120)) for k in range(60)]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(table(spark, texts)).collect()}
    assert got == {k: c for k, (_, c) in expected_components(texts, list(range(60))).items()}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = words(30)
    rows = near_dups.near_duplicates(table(spark, [text, text, text, "", "lone words here"], [7, 7, None, None, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [
        (False, 7, 7, True), (False, 7, 7, True), (True, -1, -1, True), (True, -1, -1, True), (True, -1, 7, False)]
    assert near_dups.near_duplicates(table(spark, [])).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_windows(texts, items):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: WORD.findall((t or "").translate(fold))
    window = {}
    for item, text in items:
        w = cut(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            window.setdefault(tuple(w[i:i + min(10, len(w))]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for size in {len(k) for k in window}:
            for i in range(len(w) - size + 1):
                if of := window.get(tuple(w[i:i + size])):
                    found |= of
                    hit |= set(range(i, i + size))
        names = sorted(str(x) for x in found)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_windows_match_brute_force(spark):
    items = [(1, words(14)), (2, "Alpha beta"), (3, "gamma"), (10, words(25, 300)), (4, ""), (5, None), (1, words(14)), (6, "\u00c9t\u00e9 d'\u00e9t\u00e9")]
    texts = [
        words(14), "x " + words(12) + " y", words(9), words(5) + " z " + words(9, 5), "ALPHA-Beta! gamma alpha gamma.", "beta alpha", "",
        None, "...", words(40, 290), words(4000, 0), "\u00e9t\u00e9 d'\u00e9t\u00e9", "a \u00c9t\u00e9 d \u00e9t\u00e9 b", "gamma", words(14) + " " + words(14), "w0_w1"]
    bench = spark.createDataFrame([(i, t, "junk") for i, t in items], "item_id long, text string, n_words string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination(table(spark, texts), bench).collect()}
    assert got == dict(enumerate(brute_windows(texts, items)))


def test_windows_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(table(spark, ["a b", None]), empty).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == [(0, 0, 0, False), (2, 0, 0, False)]
    assert decontaminate.contamination(table(spark, []), empty).collect() == []


def test_fuzzy_lines_keep_one_of_each_component(spark):
    base = "The quick brown fox jumps over the lazy dog while twenty seven small birds sing in the old oak tree near the river bank. " * 2
    texts = [base + "\nfirst", base.replace("twenty", "twentx") + "\nfirst\n\n  ", "unlike\n" + base, None, "", "first", base.upper()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in fuzzy_lines.dedup_lines(table(spark, texts)).collect()}
    assert got == {0: (2, 0, []), 1: (4, 2, [0, 1]), 2: (2, 1, [1]), 3: (0, 0, []), 4: (1, 0, []), 5: (1, 1, [0]), 6: (1, 0, [])}
    assert fuzzy_lines.dedup_lines(table(spark, [])).collect() == []


def test_fuzzy_lines_of_repeated_rows(spark):
    rows = fuzzy_lines.dedup_lines(table(spark, ["one line\ntwo lines"] * 3, [4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in rows) == [(-1, 0), (4, 2), (4, 2)]


def test_fuzzy_lines_that_repeat_themselves(spark):
    texts = ["-" * 20, "-" * 60, "=== " * 5, "=== " * 20, "buy now! " * 4, "buy now! " * 50]
    assert [r.n_dropped for r in fuzzy_lines.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()] == [0, 1] * 3


def test_fuzzy_lines_of_ordinary_length_with_one_edit(spark):
    rng = random.Random(4)
    texts = []
    for n in range(30, 121):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    0123") for _ in range(n - 2)).join("<>")
        i = n // 2 + rng.randrange(-5, 5)
        texts += [line, line[:i] + ("#", "#" + line[i], "")[n % 3] + line[i + 1:]]
    sets = [{t[i:i + fuzzy_lines.SHINGLE] for i in range(len(t) - fuzzy_lines.SHINGLE + 1)} for t in texts]
    most, whole = fuzzy_lines.SIMILAR
    pairs = {(a, b) for b in range(len(sets)) for a in range(b) if whole * len(sets[a] & sets[b]) >= most * len(sets[a] | sets[b])}
    assert pairs == {(a, a + 1) for a in range(0, len(texts), 2)}
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.dedup_lines(table(spark, texts)).collect()}
    assert sum(got[b] for _, b in pairs) >= 0.98 * len(pairs) and not any(got[a] for a, _ in pairs)


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 51), (7, None)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {n: (50 if n >= 50 else 0) for n in nodes}
