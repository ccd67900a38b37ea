"""Shared-term search, token alignment and the Pitman-Yor word model, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairloom.llm import lexical_search, pitman_yor, queries, token_alignment

DOCS = "doc_id long, text string, score string, term string, _id string, chunk string"
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "  x", "a  b ", "a \n b\n c", "x\xa0 y\x85z", "tab\t\tend ", "a▁b", "<s> it </s> <|endoftext|>",
       "ﬁne é é 日本語", "😀 \x00 \x1c", "Repeat repeat REPEAT", "don't we'll", "a-b,c.d;1234", "," * 400]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], DOCS)


def table(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    """Whole documents of the smallest table, odd texts, repeated rows, a null id and a long text."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "the thing and the other"), (0, rows[0][1]), (0, rows[0][1])]
    return [*rows, (20_000, " ".join(f"w{i % 977} {'q' * (i % 50)}" for i in range(30_000)) + " " + "z" * 100_000)]


# Search

def brute_search(rows, items, k):
    words = [lexical_search.terms_of(t) for _, t in rows]
    n, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(lexical_search.terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, _), w in zip(rows, words):
            tf, m = Counter(w), 50 + (50 * len(w) * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                    for t in terms if tf[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(items[0][0], "the other"), (None, "thing"), (-1, None), (-2, ""), (-3, "nowhere-found")]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, rank string")
    found = lexical_search.search(docs(spark, corpus), asked, 20)
    assert table(found, "item_id", "rank", "doc_id", "score") == brute_search(corpus, items, 20)


def test_search_in_blocks(spark, corpus, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12).collect()]
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 4)
    found = lexical_search.search(docs(spark, corpus[:80]), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert table(found, "item_id", "rank", "doc_id", "score") == brute_search(corpus[:80], items, 5)


def test_search_ties_go_to_the_smaller_id(spark):
    rows = [(9, "b"), (None, "b"), (4, "b"), (4, "b"), (1, "other words")]
    asked = spark.createDataFrame([("i", "B b")], "item_id string, text string")
    found = lexical_search.search(docs(spark, rows), asked).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [("i", 1, 4), ("i", 2, 4), ("i", 3, 9), ("i", 4, None)]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(docs(spark, [(1, "a")]), none).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(docs(spark, [(1, "a")]), none).count() == 0
    assert lexical_search.search(docs(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_sharing_dag_adds_up_to_every_item():
    rng = np.random.default_rng(3)
    items = [set(rng.choice(60, 15, replace=False).tolist()) for _ in range(40)] + [{1}, {1, 2}, {1, 2}]
    sums, roots = lexical_search.sharing_dag(items, 60)
    leaves = [Counter({i: 1}) for i in range(60)]
    for x, y in sums:
        leaves.append(leaves[x] + leaves[y])
    for item, root in zip(items, roots):
        total = Counter()
        for node in root:
            total += leaves[node]
        assert total == Counter({t: 1 for t in item})
    assert len(sums) + sum(map(len, roots)) < sum(map(len, items))
    assert roots[-1] == roots[-2] and len(roots[-1]) == 1


# Alignment

@pytest.fixture(scope="module")
def both():
    return token_alignment.Aligner(A, B)


def brute_alignment(both, text):
    """(a ids, b ids, groups, links) of a whole text in one piece, or None without tokens."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    ends = []
    for ids, size in ((a, both.bytes_a), (b, both.bytes_b)):
        if b"".join(size[i] for i in ids) != (" " + text).encode():
            return None
        ends.append(np.concatenate([[0], np.cumsum([len(size[i]) for i in ids])]).tolist())
    (ea, eb), j, links = ends, 0, []
    for x, token in enumerate(a):
        while eb[j + 1] <= ea[x]:
            j += 1
        k = j
        while k < len(b) and eb[k] < ea[x + 1]:
            links.append((token, b[k]))
            k += 1
    cuts = sorted({*ea} & {*eb})
    part = lambda ids, at, lo, hi: ",".join(map(str, ids[at.index(lo):at.index(hi)]))
    return a, b, [f"{part(a, ea, lo, hi)}|{part(b, eb, lo, hi)}" for lo, hi in zip(cuts, cuts[1:])], links


def brute_rows(both, rows):
    known = {t: brute_alignment(both, t) for _, t in rows}
    counts = Counter(p for _, t in rows if known[t] for p in set(known[t][3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for doc, t in rows:
        if known[t] is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = known[t]
            yield (doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                   sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("section", [token_alignment.SECTION_BYTES, 20_000])
def test_alignment_equals_brute_force(spark, both, corpus, section, monkeypatch):
    rows = [r for r in corpus[-60:] if r[0] != 20_000]
    rows.append((20_000, " ".join(f"w{i % 97}" for i in range(5000)) + " " + "z" * 3000))
    monkeypatch.setattr(token_alignment, "SECTION_BYTES", section)
    found = token_alignment.align(docs(spark, rows).repartition(5), A, B)
    assert table(found, *COLUMNS) == sorted(brute_rows(both, rows), key=str)


@pytest.mark.parametrize("by_rank", [False, True])
def test_units_give_the_tokens_of_the_whole_text(both, by_rank):
    assert token_alignment.merges_by_rank(A)
    found = token_alignment.Aligner(A, B, by_rank=by_rank)
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x85", "\r", "a", "the", "Z", "9", "é", "日", "'s", "<s>", "▁", ".", "}", "😀", "\x1c"]
    for n in rng.integers(1, 9, 1500):
        text = "".join(rng.choice(parts, n))
        want, units = brute_alignment(both, text), found.read([text])[0][0]
        assert (want is None) == (units is None), repr(text)
        if want:
            assert found.sums[units].sum(axis=0).tolist() == [len(x) for x in want], repr(text)


def test_a_task_that_forgets_units_gives_the_same(both, corpus, monkeypatch):
    monkeypatch.setattr(token_alignment, "UNITS", 50)
    forgetful = token_alignment.Aligner(A, B)
    for _, text in corpus[:60]:
        want, units = brute_alignment(both, text), forgetful.read([text])[0][0]
        assert (units is None) == (want is None)
        if want:
            assert forgetful.sums[units].sum(axis=0).tolist() == [len(x) for x in want]
            assert "".join(forgetful.groups[i] for i in units)[:-1] == ";".join(want[2])


def test_alignment_of_nothing(spark):
    assert token_alignment.align(docs(spark, []), A, B).count() == 0
    assert table(token_alignment.align(docs(spark, [(1, None)]), A, B), *COLUMNS) == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    keys = keys[token_alignment.shard_of(keys) == token_alignment.shard_of(keys[:1])] if n == 50_000 else keys
    sizes, bits = token_alignment.perfect_hash(keys)
    shard = int(token_alignment.shard_of(keys[:1])[0]) if len(keys) else 0
    keys = keys[token_alignment.shard_of(keys) == shard]
    sizes, bits = token_alignment.perfect_hash(keys)
    at = token_alignment.Places([(shard, sizes, bits, None)])(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    ordered = np.zeros(len(keys), np.int64)
    ordered[at] = keys
    verified = token_alignment.Places([(shard, sizes, bits, ordered)])
    assert (verified(keys) == at).all() and (verified(np.arange(1 << 41, (1 << 41) + 3000)) == -1).all()


def test_tree_of_sums_has_several_levels(spark, both, corpus, monkeypatch):
    monkeypatch.setattr(token_alignment, "FAN", 2)
    rows = corpus[:40]
    assert table(token_alignment.align(docs(spark, rows).repartition(9), A, B), *COLUMNS) == sorted(brute_rows(both, rows), key=str)


# Word model

def words_of(text):
    return (text or "").encode().lower().split() + [b"an end"]  # no word holds a blank


def is_held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark, corpus):
    return pitman_yor.score(docs(spark, corpus)).collect()


def test_plain_columns_of_the_model_equal_brute_force(corpus, scored):
    counts = Counter(w for d, t in corpus if not is_held_out(d) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, is_held_out(d), len(words_of(t)), sum(w in counts for w in words_of(t)), n,
                    round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words_of(t)), 4)) for d, t in corpus), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored), key=str) == want


def test_model_beats_unigrams_on_held_out_documents(scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 5]
    assert held and all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in scored)


def test_same_rows_get_the_same_score(scored):
    assert len({(r.score, r.n_tokens) for r in scored if r.doc_id == 0}) == 1


def _train(rows):
    """A model of a few texts without Spark's partitions: one bucket, all sweeps."""
    e = pitman_yor.entries(rows)
    key, n = np.unique((e.word << pitman_yor.CONTEXT_BITS) | e.context, return_counts=True)
    _, _, words, per = next(pitman_yor._by_bucket(e.words, key, pitman_yor.CONTEXT_BITS, 1))
    context = (key & (pitman_yor.CONTEXTS - 1)).astype(np.uint16)
    cells = {"words": words, "per": per, "context": context, "n": n.astype(np.uint32)}
    customers = pitman_yor._count(context, n)
    state, samples = pitman_yor._start(cells), []
    for number in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES + 1):
        tables = pitman_yor._count(context[n == 1]) + pitman_yor._count(state["context"], state["tables"])
        known = pitman_yor.Totals(0.7, 0.4, len(words), tables, int(state["customers"].sum()), int(state["word_tables"].sum()))
        if number > pitman_yor.BURN_IN:
            samples.append(known)
        if number < pitman_yor.BURN_IN + pitman_yor.SAMPLES:
            state = pitman_yor._step(state, known, np.random.default_rng(number), number == 0,
                                     number - pitman_yor.BURN_IN if number >= pitman_yor.BURN_IN else None)
            assert (np.bincount(np.repeat(np.arange(len(state["n"])), state["tables"]), state["sizes"], len(state["n"])) == state["n"]).all()
            assert int(state["word_sizes"].sum()) == int(state["customers"].sum())
            assert (state["tables"] >= 1).all() and (state["sizes"] >= 1).all() and (state["word_sizes"] >= 1).all()
    return pitman_yor._Bucket(cells, state, samples, customers, int(n.sum()))


@pytest.mark.parametrize("rows", [["a b a b a c", "a b c", "b c a"] * 5, ["the cat"] * 400 + ["the dog sat", "x"], [" ".join("w%d" % (i * i % 31) for i in range(4000))]])
def test_probabilities_of_a_context_sum_to_one(rows):
    model = _train(rows)
    every = sorted({w for t in rows for w in words_of(t)[:-1]} | {b""})
    hashes = np.sort(np.array([pitman_yor.xxhash.xxh64_intdigest(w) for w in [*every, b"never seen"]], np.uint64))
    for before in [*every, b"never seen"]:
        context = pitman_yor.xxhash.xxh64_intdigest(before) & (pitman_yor.CONTEXTS - 1)
        p = {"words": hashes, "per": np.ones(len(hashes), np.uint32), "context": np.full(len(hashes), context, np.uint16),
             "doc": np.arange(len(hashes)).astype(np.uint16), "n": np.ones(len(hashes), np.uint32)}
        assert math.isclose(float((10.0 ** pitman_yor.unpack(model.score(p))["score"]).sum()), 1.0, abs_tol=1e-6)


def test_sweep_has_the_distribution_of_a_seating_by_hand():
    """Three customers, d = 0.5, new table 0.8: P(tables) from all set partitions."""
    weight = {1: 0.8 * 0.5 * 1.5, 2: 3 * 0.8**2 * 0.5, 3: 0.8**3}
    want = {k: v / sum(weight.values()) for k, v in weight.items()}
    rng, cells = np.random.default_rng(1), 40_000
    c, a = np.full(cells, 3), np.full(cells, 0.8)
    tables, sizes = pitman_yor.seat(rng, c, a, 0.5)
    for _ in range(12):
        tables, sizes = pitman_yor.sweep(rng, c, a, 0.5, tables, sizes)
        assert (np.bincount(np.repeat(np.arange(cells), tables), sizes) == 3).all()
    got = Counter(tables.tolist())
    assert all(abs(got[k] / cells - want[k]) < 0.012 for k in want)


def test_model_of_nothing(spark):
    assert pitman_yor.score(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    row = pitman_yor.score(docs(spark, [(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    texts = pitman_yor.score(docs(spark, [(held, None), (None, ""), (None, "a A")])).collect()
    assert sorted((r.n_tokens, r.n_known, r.held_out) for r in texts) == [(1, 1, False), (1, 1, True), (3, 3, False)]


def test_buckets_and_groups_do_not_change_counts(spark, corpus, monkeypatch):
    for name, value in (("BUCKET_BYTES", 1 << 14), ("GROUP_BYTES", 1 << 15)):
        monkeypatch.setattr(pitman_yor, name, value)
    again = pitman_yor.score(docs(spark, corpus[:100]).repartition(7))
    plain = sorted((r.doc_id, r.n_tokens, r.held_out) for r in again.collect())
    assert plain == sorted((d, len(words_of(t)), is_held_out(d)) for d, t in corpus[:100])


def test_pack_round_trip():
    arrays = {"a": np.arange(5, dtype=np.int64), "b": np.zeros(0), "c": np.array([True, False]), "d": np.array([1.5, -2])}
    back = pitman_yor.unpack(pitman_yor.pack(**arrays))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())


def test_new_queries_read_the_given_tables(spark):
    for name in ("op11_shared_search", "op12_token_alignment", "op13_pitman_yor"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] > 0
