"""Shards, mixture, search, url filter, licenses, token counts and languages."""

import hashlib
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import languages, licenses, mixing, neighbours, queries, sharding, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS)


def shards_of(df, n):
    return sharding.shard(df, n, queries.text_bytes(F.col("text"))).collect()


@pytest.mark.parametrize("texts", [
    [f"text {i} " + "x" * (i % 50) for i in range(400)], ["same"] * 300 + [f"t{i}" for i in range(100)], [None] * 200 + [""] * 200, ["a"], []])
def test_shards_are_even_and_slots_gapless(spark, texts):
    rows = shards_of(docs(spark, [(i if i % 3 else None, t, "en", "src0") for i, t in enumerate(texts)]), 8)
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    size = lambda r: len((r.text or "").encode()) + 16
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if len(texts) > 100:
        total = [sum(map(size, part)) for part in by.values()]
        assert len(total) == 8 and max(total) - min(total) <= 2 * max(map(size, rows))


def test_groups_of_equal_texts_are_cut_only_if_large(spark):
    texts = [f"text {i // 3} " + "x" * (i // 3 % 40) for i in range(1800)] + ["hot"] * 900
    rows = shards_of(docs(spark, [(i % 7, t, "en", "src0") for i, t in enumerate(texts)]), 8)
    at, total = {}, {}
    for r in rows:
        at.setdefault(r.text, set()).add(r["shard"])
        total[r["shard"]] = total.get(r["shard"], 0) + len(r.text) + 16
    assert all(len(x) == 1 for t, x in at.items() if t != "hot") and len(at["hot"]) > 1
    mean = sum(total.values()) / 8
    assert all(abs(x - mean) <= 2 * 3 * 70 for x in total.values())


def test_very_long_text_in_shards_and_mixture(spark):
    rows = [(i, "long " * 400_000 if i == 3 else f"t {i}", "en", "src0") for i in range(50)]
    assert sorted(r.slot for r in shards_of(docs(spark, rows), 1)) == list(range(50))
    got = mixing.mix(docs(spark, rows), F.lit("d"), F.col("corpus"), [F.lit(1)] * 3).collect()
    assert {r.copies for r in got} == {1} and max(r.tokens for r in got) == 400_000


@pytest.mark.parametrize("digits, most", [(3, 1 << 16), (1, 1)])
def test_mixture_equals_brute_force(spark, monkeypatch, digits, most):
    monkeypatch.setattr(mixing, "SLICE_DIGITS", digits)
    monkeypatch.setattr(mixing, "SLICE_ROWS", most)
    rows = [(None, f"null {i} " + "w " * (i % 11), "en", "a") for i in range(700)]
    rows += [(5, "five words are in this", "en", "a")] * 400 + [(6, None, "en", "a")] * 30 + [(i, f"t {i}", "en", "a") for i in range(200)]
    take = lambda total: mixing.mix(docs(spark, rows), F.lit("d"), F.lit(total), [F.lit(1)] * 3, epochs=2, seed=4).collect()
    tokens = sum(len((t or "").split()) for _, t, _, _ in rows)
    place = lambda r: hashlib.md5(f"4:1:{'' if r.doc_id is None else r.doc_id}:{r.text_key}".encode()).hexdigest()
    got = take(tokens + tokens // 2)
    # The second budget ends inside the rows that are equal.
    five = min(place(r) for r in got if r.doc_id == 5 and r.tokens == 5)
    for part, got in ((tokens // 2, got), (lambda n: (n, take(tokens + n)))(sum(r.tokens for r in got if place(r) < five) + 1002)):
        assert len(got) == len(rows)
        run, want = 0, []
        for r in sorted(got, key=place):
            run += r.tokens
            want.append((r.doc_id or 0, r.text_key, 1 + (run <= part)))
        assert sorted((r.doc_id or 0, r.text_key, r.copies) for r in got) == sorted(want)
    assert sum(r.copies for r in got if r.doc_id == 5 and r.tokens == 5) == 400 + 200


def test_mixture_redistributes_to_siblings_first(spark):
    leaves = spark.createDataFrame([
        ("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "a", 1000), ("d1", "en", "a", 1000)],
        "domain string, lang string, source string, tokens long")
    plan = mixing.leaf_budgets(leaves, F.lit(800), 1, [F.lit(1)] * 3)
    got = {(r.domain, r.lang, r.source): r.budget for r in plan.collect()}
    # What d0/en/a lacks goes to d0/en/b, not to the other language or domain.
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 190, ("d0", "de", "a"): 200, ("d1", "en", "a"): 400}
    more = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, F.lit(2900), 1, [F.lit(1)] * 3).collect()}
    assert more == {("d0", "en", "a"): 10, ("d0", "en", "b"): 940, ("d0", "de", "a"): 950, ("d1", "en", "a"): 1000} or sum(more.values()) == 2900


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en" if i % 4 else None, f"src{i % 3}") for i in range(600)] + [(None, None, "en", None)]
    df = docs(spark, rows)
    take = lambda share, epochs: mixing.mix(df, queries.source_domain(F.col("source")), F.expr(f"(corpus * {share}) div 100"),
                                            queries.mix_weights(), epochs).collect()
    got = take(60, 2)
    assert len(got) == 601 and {r.copies for r in got} <= {0, 1, 2}
    total, used = sum(r.tokens for r in got), sum(r.tokens * r.copies for r in got)
    assert 0.55 * total <= used <= 0.6 * total
    assert sorted(map(repr, take(60, 2))) == sorted(map(repr, got))
    assert sum(r.tokens * r.copies for r in take(200, 2)) == 2 * total
    assert mixing.mix(docs(spark, []), F.lit("d"), F.lit(5), queries.mix_weights()).collect() == []


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 32))
    x[100:130] = x[100]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000, None, "q"), (2001, [0.0] * 32, "q"), (2002, [None] * 32, "q"), (2003, [float("nan")] * 32, "q"), (None, rows[0][1], "q"), (2004, [], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(1200), -s))[:20].tolist()))
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda p: (-p[1], p[0]))]
        assert all(abs(score - x[q] @ x[v]) < 1e-9 for v, score in found)
    assert len(got) == 60 and hits / (60 * 20) >= 0.9


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(df, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.search(df.where("vec_id > 5"), F.lit(True), 20).collect() == []


def test_one_malformed_vector_removes_no_other_row(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(40)] + [(90, [1.0, 2.0, 3.0]), (91, [1.0]), (None, [1.0, 1.0]), (92, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 39), (0, 38), (0, 37), (20, 39), (20, 38), (20, 37)]
    assert sorted(map(tuple, neighbours.left_out(df).collect()), key=str) == [
        (90, "other length"), (91, "other length"), (92, "no vector"), (None, "no id")]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [0.0, 5.0]), (1, [0.0, 5.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 3.0), (2, 2.0), (1, 0.0)]
    twice = neighbours.search(df, F.col("vec_id") == 1, 20).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in twice) == [(1, 0, 0.0), (1, 2, 6.0), (2, 0, 3.0), (2, 2, 0.0)]


def test_grams_are_all_substrings(spark):
    urls = ["x", "", "é日😀.com", "www.example.com", "a" * 40]
    df = spark.createDataFrame([(u, "/" + u[::-1]) for u in urls], "h string, p string")
    for row in df.select("h", "p", url_filter.grams(F.col("h"), F.col("p"), (2, 3, 5)).alias("g")).collect():
        want = {m + t[i:i + n] for m, t in (("h", f"^{row.h}$"), ("p", f"^{row.p}$")) for n in (2, 3, 5)
                for i in range(max(1, len(t) - n + 1))}
        assert set(row.g) == want and len(row.g) == len(want)


def test_very_long_urls_are_judged(spark):
    pages = spark.createDataFrame([(1, "http://a.org/" + "xy%3" * 250_000), (2, "h" * 1_000_000), (3, "http://" + "b" * 300_000)], "page_id long, url string")
    model = url_filter.train(queries.labelled_urls(spark).limit(60))
    assert {r.page_id: len(r._host) for r in url_filter.judge(pages, [], model).collect()} == {1: 5, 2: 0, 3: 300_000}


def test_url_rules_and_parts(spark):
    rules = [url_filter.rule(x) for x in queries.URL_RULES]
    cases = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/2#t": ("a.example.com", "/en/2", "example.com/en/", "block"),
        "http://b.net/fr/": ("b.net", "/fr/", "net/fr/", "block"), "x://example.com": ("example.com", "", None, "allow"),
        "http://notcom/": ("notcom", "/", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "a://b.org/c://d": ("b.org", "/c://d", None, "allow"), "http://x.com/": ("x.com", "/", "com/", "allow")}
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, label string")
    got = url_filter.judge(pages, rules, None).orderBy("page_id").collect()
    assert [(r._host, r._path, r._rule, r._verdict) for r in got] == list(cases.values())
    assert url_filter.judge(pages.limit(0), rules, None).collect() == []


def test_url_regression_on_held_out_urls(spark):
    labelled = queries.labelled_urls(spark)
    model = url_filter.train(labelled)
    junk = ["http://www.free-casino.example.org/en/77", "http://cheap-bets.example.net/fr/1", "https://ads-tracker.example.org/de/3"]
    plain = ["http://www.science-garden.example.org/en/77", "http://town-history.example.net/fr/1", "https://music.example.org/de/3"]
    rows = spark.createDataFrame([(u,) for u in junk + plain], "url string")
    assert [r._verdict for r in url_filter.judge(rows, [], model).collect()] == ["block"] * 3 + ["allow"] * 3
    assert url_filter.train(labelled.where("label = 0")) is None


def test_licenses_by_compression_and_wording(spark):
    lines = {
        "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "A licence to print money was sold at the fair on a rainy day in May.": "",
        "released under the mit license": "MIT"}
    texts = [f"some words\n{x}\nmore words" for x in lines] + [None, "", "no notice at all", "x " * 20000 + "\nReleased under the MIT License."]
    rows = licenses.document_licenses(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [*lines.values(), "", "", "", "MIT"]
    assert [r.n_notices for r in rows] == [int(bool(r.licenses)) for r in rows]
    assert licenses.document_licenses(docs(spark, [])).collect() == []


def licenses_of(spark, texts):
    rows = licenses.document_licenses(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [(r.licenses, r.n_notices, r.exact) for r in rows]


def test_licenses_come_through_the_ranking(monkeypatch):
    text = " ".join(["prose"] * 30) + " " + licenses.TEMPLATES["MPL-2.0"] + " more. " + licenses.TEMPLATES["MIT"]
    found = lambda: {n[1] for n in licenses.Scanner(licenses.TEMPLATES).notices(text) if n[4]}
    assert found() == {"MPL-2.0", "MIT"}
    ranked = licenses.Scanner.ranked
    with monkeypatch.context() as m:
        m.setattr(licenses.Scanner, "ranked", lambda self, *of: [r for r in ranked(self, *of) if r[1] != "MIT"])
        assert found() == {"MPL-2.0"}
    with monkeypatch.context() as m:
        m.setattr(licenses.Scanner, "ranked", lambda self, *of: [(0.0, name) for _, name in ranked(self, *of)])
        assert found() == set()


def test_few_templates_are_compared():
    scanner, compared = licenses.Scanner(licenses.TEMPLATES), []
    stretches = scanner.stretches
    scanner.stretches = lambda name, words: (compared.append(name), stretches(name, words))[1]
    scanner.notices("free text " * 20 + licenses.TEMPLATES["MIT-grant"] + " other text" * 20)
    assert "MIT-grant" in compared and len(set(compared)) <= len(licenses.TEMPLATES) / 2


def test_licenses_of_repeated_and_unusual_rows(spark):
    notice = licenses.TEMPLATES["MIT"]
    rows = [(1, notice), (1, notice), (None, notice), (2, None), (3, ""), (4, "w " * 300_000 + notice)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = licenses.document_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.n_notices, r.licenses, r.exact) for r in got if r.n_notices) == [
        (0, 1, "MIT", True), (1, 1, "MIT", True), (1, 1, "MIT", True), (4, 1, "MIT", True)]
    assert sorted((r.doc_id, r.licenses, r.exact) for r in got if not r.n_notices) == [(2, "", None), (3, "", None)]


def test_licenses_within_other_text(spark):
    names = sorted(licenses.TEMPLATES)
    around = "people walk along the river and look at old bridges in the summer "
    texts = [around * a + licenses.TEMPLATES[x] + " " + around * b for x in names for a, b in ((0, 1), (1, 0), (40, 40))]
    assert licenses_of(spark, texts) == [(x, 1, True) for x in names for _ in range(3)]


def test_licenses_over_several_lines(spark):
    names = sorted(licenses.TEMPLATES)
    wraps = [(mark, width) for mark in (" * ", "# ", "REM ", "// ") for width in (24, 80)]
    texts = ["\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[n], width, break_long_words=False, break_on_hyphens=False)) for n in names for mark, width in wraps]
    assert licenses_of(spark, texts) == [(n, 1, True) for n in names for _ in wraps]
    two = "Released under the MIT License. Pictures: Licensed under CC BY-SA 4.0."
    assert licenses_of(spark, [two, two + "\n" + two]) == [("CC-BY-SA-4.0,MIT", 2, True), ("CC-BY-SA-4.0,MIT", 4, True)]


def test_licenses_without_a_template_get_no_name(spark):
    gpl, apache = licenses.TEMPLATES["GPL-3.0"], licenses.TEMPLATES["Apache-2.0-header"]
    others = [
        gpl.replace("General", "Lesser General"), gpl.replace("General", "Affero General"), gpl.replace("General", "Library General"),
        gpl.replace("3", "1"), gpl.replace("3", "2.1"), gpl.replace(", version 3", ""), apache.replace("2.0", "1.1"),
        licenses.TEMPLATES["GPL-header"].replace("General", "Lesser General"), licenses.TEMPLATES["MPL-2.0"].replace("Mozilla", "Eclipse"),
        "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY NC ND 4.0.", "Licensed under CC BY ND 4.0.", "Licensed under CC BY 3.0."]
    assert licenses_of(spark, others) == [("", 0, None)] * len(others)
    same = {gpl.replace("version 3", "v3.0"): "GPL-3.0", "Licensed under the Apache Software License, Version 2.0.": "Apache-2.0",
            apache.replace("You may obtain", "One may get"): "Apache-2.0-header", "Licensed under CC-BY-SA 4.0.": "CC-BY-SA-4.0"}
    assert licenses_of(spark, list(same)) == [(x, 1, False) for x in same.values()]


def test_token_counts_equal_the_tokenizer(spark):
    tokenizers, tables = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = tables.path("byte_bpe_50k.json")
    texts = [
        "Hello world, it's  fine.\n\n  Next", "", None, "<|endoftext|>a<|endoftext|>", "\u00c9t\u00e9 \u4f60\u597d \U0001f600\U0001f600 \u00b2\u00bd \u2167", "x" * 5000,
        "a\u00a0b\u2003c\u0085d\x1ce\x1ff\u200bg", "don't I'LL we've'd", "   ", "tab\t\tend ", "<|endoftext", "12345 67,8 \r\n\r\n x", "word " * 3000,
        "Th\u0301e\u0308 \u0915\u093f \u0e01\u0e33"]
    got = token_counts.count_tokens(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts * 2)]), path).collect()
    exact = tokenizers.Tokenizer.from_file(path)
    want = [len(exact.encode(t or "", add_special_tokens=False)) for t in texts] * 2
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts * 2, want))}
    assert token_counts.count_tokens(docs(spark, []), path).collect() == []


def test_token_counts_take_the_join_for_rare_pre_tokens(spark, monkeypatch):
    tokenizers, tables = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_counts, "COMMON", 2)
    path = tables.path("byte_bpe_50k.json")
    texts = [f"alpha beta gamma{i} alpha" for i in range(30)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), path).collect()}
    exact = tokenizers.Tokenizer.from_file(path)
    assert got == {i: len(exact.encode(t).ids) for i, t in enumerate(texts)}


SAMPLES = {"en": "the cat and the dog went to the house with ", "de": "der hund und die katze gehen nicht in das haus ", "fr": "le chat et le chien sont dans la maison avec "}


def test_languages_of_held_out_rows(spark):
    rows = [(i, SAMPLES[k] * (1 + i % 3) + f"x{i}", k, "s") for i in range(120) for k in [list(SAMPLES)[i % 3]]]
    rows += [(900, None, "en", "s"), (901, "123 456 !", "de", "s"), (902, "", "fr", "s"), (903, SAMPLES["de"], None, "s"), (None, SAMPLES["fr"], "en", "s")]
    got = languages.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 900}
    assert sum(r.held_out for r in got) > 10
    assert all(r.lang_pred == truth[r.doc_id] and r.score > 0.9 for r in got if r.doc_id in truth)
    rest = {r.doc_id: (r.lang_pred, r.score == 0) for r in got if r.doc_id not in truth}
    assert rest == {900: ("und", True), 901: ("und", True), 902: ("und", True), 903: ("de", False), None: ("fr", False)}


def test_languages_with_little_to_learn(spark):
    one = [r for r in languages.identify(docs(spark, [(i, "some text", "en", "s") for i in range(8)])).collect()]
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    none = languages.identify(docs(spark, [(1, "some text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert languages.identify(docs(spark, [])).collect() == []


def test_languages_of_a_lang_without_letters(spark):
    rows = [(i, SAMPLES[k] * (1 + i % 3), k, "s") for i in range(40) for k in [list(SAMPLES)[i % 3]]]
    rows += [(900 + i, t, "und", "s") for i, t in enumerate(("", "12 34", "?!", "5"))]
    got = {r.doc_id: r.lang_pred for r in languages.identify(docs(spark, rows)).collect()}
    assert got == {i: k if i < 900 else "und" for i, _, k, _ in rows}


def test_codewords_part_all_languages():
    for n in (1, 2, 3, 4, 5, 9, 40):
        code = languages.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        assert n == 1 or (np.abs(code.sum(axis=0)) < n).all()
