"""Scores, rankings and model table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from catalog import fixtures as X
from catalog.fixtures import NL, WS, sql
from pairloom.functions import text as C
from pairloom.operators import learn, metrics as M, ranking as R, records, tables

_rounded = lambda df: df.select(*[
    F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def exact_match(spark, sf):
    """Share of matches and number of misses."""
    hit = M.canonical_match(F.col("pred"), F.col("truth"))
    return X.answers(spark, sf).agg(M.share(hit).alias("accuracy"), F.count_if(~hit).alias("misses"))


def cwe_coverage(spark, sf):
    return M.cwe_coverage(X.answers(spark, sf), M.canonical_match(F.col("pred"), F.col("truth")))


def strip_match(spark, sf):
    return X.answers(spark, sf).agg(M.share(M.strip_match(F.col("pred"), F.col("truth"))).alias("accuracy"))


def _overlap(spark, sf):
    return M.ngram_stats(X.pairs(spark, sf), "after", "before", C.words)


def generation_length(spark, sf):
    """Tokens of the re-encoded text, and non-pad ids of the encoded rows."""
    rows = X.answers(spark, sf)
    ids = records.encode_tokens(rows, "pred", records.vocabulary(rows, "pred"))
    return ids.select("pair_id", F.size(F.filter("input_ids", lambda x: x != 0)).alias("n_ids")).join(
        rows.select("pair_id", records.token_count(F.col("pred")).alias("n_text")), "pair_id").agg(
        F.avg("n_ids").alias("id_length"), F.avg("n_text").alias("text_length"))


def _judged(spark, sf):
    return X.scored_rows(spark, sf).withColumn("predicted", (F.col("sc") >= 0.5).cast("int"))


def _judged_cwe(spark, sf):
    cwe = X.names(spark, sf).select(
        F.col("pair_id").alias("id"), F.regexp_extract("name", "CWE-[0-9]+", 0).alias("cwe"))
    return M.tpr_by_class(_judged(spark, sf).join(cwe, "id"), "y", "predicted")


def tpr_top10(spark, sf):
    return _judged_cwe(spark, sf).orderBy(F.desc("tpr"), F.desc("total"), "cwe").limit(10)


def compare_variants(spark, sf):
    """One score table over training variants and balance settings."""
    rows = X.scored_rows(spark, sf).select(
        "y", "sc", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("variant"),
        F.when(F.col("id") % 2 == 0, "balanced").otherwise("imbalanced").alias("setting"))
    judged = rows.withColumn("predicted", (F.col("sc") * 10 >= F.col("variant")).cast("int"))
    return M.confusion(judged, "y", "predicted", "variant", "setting")


def bow_forest(spark, sf):
    rows = X.functions(spark, sf).join(
        X.scored_rows(spark, sf).select(F.col("id").alias("pair_id"), "y"), "pair_id")
    model = learn.bow_forest(rows, "before", "y")
    return learn.bow_scores(model, X.functions(spark, sf), "before", "pair_id")


def bow_vectors(spark, sf):
    f = X.functions(spark, sf)
    bags = learn.bow_vectors(f, "before", learn.feature_index(f, "before"), "pair_id")
    return bags.select("pair_id", F.size("ids").cast("long").alias("features"), F.array_join(
        F.zip_with("ids", "counts", lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("string"))), " ").alias("bag"))


def embedding_counts(spark, sf):
    """What is fixed about the seeded vectors: one per text, their size and the token count in them."""
    vectors = learn.token_embeddings(X.functions(spark, sf), "before", "pair_id", buckets=1 << 12)
    return vectors.select("pair_id", F.size("embedding").alias("size"),
                          F.element_at("embedding", -1).cast("long").alias("tokens"))


def batch_score(spark, sf):
    """A rule stands for the trained predictor: the longest line of the text."""
    def rule():
        import numpy as np
        import pyarrow.compute as pc

        def longest(texts):
            lines = pc.split_pattern(texts, "\n")
            flat, text = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
            order = np.lexsort((np.arange(len(flat)), -pc.utf8_length(flat).to_numpy(), text))
            return flat.take(order[np.flatnonzero(np.diff(text[order], prepend=-1))])
        return longest
    return learn.batch_score(X.functions(spark, sf), "before", "pair_id", rule)


def model_score(spark, sf):
    """A fitted model over whole columns: the number of lines from the length of a text."""
    f = X.functions(spark, sf)
    rows = f.withColumn("lines", F.size(C.lines(F.col("before"))).cast("double"))
    return learn.batch_score(f, "before", "pair_id", learn.length_model(rows, "before", "lines"), T.LongType())


def rank_lines(spark, sf):
    return R.rank_lines(X.scored_lines(spark, sf)).select("pair_id", "pos", "y", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "exact_match": lambda s, d: _rounded(exact_match(s, d)),
    "cwe_coverage": cwe_coverage,
    "strip_match": lambda s, d: _rounded(strip_match(s, d)),
    "ngram_overlap": lambda s, d: M.ngram_overlap(_overlap(s, d)),
    "corpus_bleu": lambda s, d: _rounded(M.corpus_bleu(_overlap(s, d))),
    "google_bleu": lambda s, d: _rounded(M.google_bleu(_overlap(s, d))),
    "corpus_bleu_13a": lambda s, d: _rounded(M.corpus_bleu(
        M.ngram_stats(X.pairs(s, d), "after", "before"))),
    "google_bleu_13a": lambda s, d: _rounded(M.google_bleu(
        M.ngram_stats(X.pairs(s, d), "after", "before"))),
    "generation_length": lambda s, d: _rounded(generation_length(s, d)),
    "macro_metrics": lambda s, d: _rounded(M.macro_metrics(X.pairs(s, d), "after", "before", C.words)),
    "confusion_metrics": lambda s, d: _rounded(M.confusion(_judged(s, d), "y", "predicted")),
    "roc_auc": lambda s, d: _rounded(M.roc_auc(X.scored_rows(s, d), "y", "sc")),
    "pr_auc": lambda s, d: _rounded(M.pr_auc(X.scored_rows(s, d), "y", "sc")),
    "tpr_by_class": lambda s, d: _rounded(_judged_cwe(s, d)),
    "tpr_top10": lambda s, d: _rounded(tpr_top10(s, d)),
    "rank_lines": rank_lines,
    "top_k_accuracy": lambda s, d: _rounded(R.top_k_accuracy(X.scored_lines(s, d))),
    "initial_false_alarm": lambda s, d: _rounded(R.initial_false_alarm(X.scored_lines(s, d))),
    "effort_at_recall": lambda s, d: _rounded(R.effort_at_recall(X.scored_lines(s, d))),
    "recall_at_effort": lambda s, d: _rounded(R.recall_at_effort(X.scored_lines(s, d))),
    "recall_by_pred_prob": lambda s, d: _rounded(R.recall_by_probability(X.scored_rows(s, d))),
    "longest_first": lambda s, d: R.longest_first(X.functions(s, d).select(
        "pair_id", records.token_count(F.col("before")).cast("long").alias("n_tokens")), "n_tokens"),
    "first_of_group": lambda s, d: tables.first_of_group(
        X.table(s, d, "documents").select("source", "lang", "doc_id", "n_chars"), "doc_id", "source", "lang"),
    "compare_variants": lambda s, d: _rounded(compare_variants(s, d)),
    "bow_forest": bow_forest,
    "token_embeddings": lambda s, d: learn.token_embeddings(X.functions(s, d), "before", "pair_id"),
    "batch_score": batch_score,
    "bow_vectors": bow_vectors,
    "embedding_counts": embedding_counts,
    "model_score": model_score,
}

_CANON = f"""array_to_string(list_filter(list_transform(string_split(%s, {NL}),
    lambda x: ltrim(x, {WS})), lambda x: x <> ''), {NL})"""
_HIT = f"{_CANON % 'pred'} = {_CANON % 'truth'}"
_WORD = r"'[^ \t\n\x0B\f\r]+'"
_TOKEN = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]'"


def _13a(column):
    """The same fixed tokenisation rules, for the check engine."""
    c = f"replace(replace(replace({column}, '<skipped>', ''), '-' || {NL}, ''), {NL}, ' ')"
    for find, put in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{find}', '{put}')"
    c = f"' ' || {c} || ' '"
    for find, put in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                      (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{find}', '{put}', 'g')"
    return c


def _side(column):
    return f"""select pair_id, pos, t as g1, t || ' ' || lead(t, 1) over w g2,
            t || ' ' || lead(t, 1) over w || ' ' || lead(t, 2) over w g3,
            t || ' ' || lead(t, 1) over w || ' ' || lead(t, 2) over w || ' ' || lead(t, 3) over w g4
        from (select pair_id, generate_subscripts(l, 1) pos, unnest(l) t
              from (select pair_id, regexp_extract_all({column}, {_WORD}) l from pairs))
        window w as (partition by pair_id order by pos)"""


def _count(view):
    return " union all ".join(
        f"select pair_id, {n} n, g{n} g, count(*) c from {view} where g{n} is not null group by all"
        for n in range(1, 5))


def _ngrams(after="after", before="before"):
    return {"hg": _side(after), "rg": _side(before), **_COUNTED}


_COUNTED = {
    "hc": _count("hg"), "rc": _count("rg"),
    "per_n": """select coalesce(h.pair_id, r.pair_id) pair_id, coalesce(h.n, r.n) n,
            sum(least(coalesce(h.c, 0), coalesce(r.c, 0))) m, sum(coalesce(h.c, 0)) h, sum(coalesce(r.c, 0)) r
        from hc h full join rc r on h.pair_id = r.pair_id and h.n = r.n and h.g = r.g group by 1, 2""",
    "wide": "select pair_id, " + ", ".join(
        f"coalesce(sum(case when n = {n} then {c} end), 0) {c}{n}" for n in range(1, 5) for c in "mhr")
        + " from per_n group by pair_id",
    "total": "select " + ", ".join(f"sum({c}{n}) {c}{n}" for n in range(1, 5) for c in "mhr") + " from wide",
}


def _bleu_sql():
    zero = lambda n: " + ".join(f"cast(m{i} = 0 as int)" for i in range(1, n + 1))
    p = [f"ln(case when h{n} = 0 then null when m{n} > 0 then cast(m{n} as double) / h{n} "
         f"else 1.0 / (pow(2.0, {zero(n)}) * h{n}) end)" for n in range(1, 5)]
    return f"""case when m1 + m2 + m3 + m4 = 0 then 0.0 else coalesce(100
        * case when h1 < r1 then exp(1 - cast(r1 as double) / h1) else 1.0 end
        * exp(({' + '.join(p)}) / 4), 0.0) end"""


_SCORED_CUT = """select y, row_number() over (order by sc desc, {tie}) i, count(*) over () n,
    sum(y) over () hits, sum(y) over (order by sc desc, {tie} rows unbounded preceding) run from {view}"""
_LINE_CUT = _SCORED_CUT.format(tie="pair_id, pos", view="scored_lines")
_FIRST = """select pair_id, min(r) f from (select *, row_number() over (
    partition by pair_id order by sc desc, pos) r from scored_lines) where y = 1 group by pair_id"""
_RATIOS = """round((tp + tn) / (tp + fp + tn + fn), 6) accuracy,
    round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
    round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) recall,
    round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) f1,
    round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0
        else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end, 6) mcc"""
_COUNTS = """cast(count(*) filter (where y = 1 and p) as double) tp, cast(count(*) filter (where y = 0 and p) as double) fp,
    cast(count(*) filter (where y = 0 and not p) as double) tn, cast(count(*) filter (where y = 1 and not p) as double) fn"""
_AS_INT = ", ".join(f"cast({c} as bigint) {c}" for c in ("tp", "fp", "tn", "fn"))
_CLASS = """select regexp_extract(name, 'CWE-[0-9]+') cwe, count(*) filter (where sc >= 0.5) hits, count(*) total,
    round(cast(count(*) filter (where sc >= 0.5) as double) / count(*), 6) tpr,
    count(*) filter (where sc >= 0.5) || '/' || count(*) proportion
    from scored_rows s join names n on s.id = n.pair_id where y = 1 group by 1"""

ORACLES = {
    "exact_match": sql(
        f"""select round(avg(case when {_HIT} then 1.0 else 0.0 end), 6) accuracy,
            count(*) filter (where not ({_HIT})) misses from answers""", "answers"),
    "cwe_coverage": sql(f"select count(distinct cwe) classes from answers where {_HIT}", "answers"),
    "strip_match": sql(
        f"select round(avg(case when trim(pred, {WS}) = trim(truth, {WS}) then 1.0 else 0.0 end), 6) accuracy from answers",
        "answers"),
    "ngram_overlap": sql(
        """select n, cast(sum(m) as bigint) matched, cast(sum(h) as bigint) hyp, cast(sum(r) as bigint) as ref
           from per_n group by n""", "pairs", **_ngrams()),
    "corpus_bleu": sql(f"select round({_bleu_sql()}, 6) bleu from total", "pairs", **_ngrams()),
    "google_bleu": sql(
        """select round(cast(sum(m) as double) / sum(greatest(h, r)), 6) google_bleu
           from (select sum(m) m, sum(h) h, sum(r) r from per_n group by pair_id)""", "pairs", **_ngrams()),
    "corpus_bleu_13a": sql(f"select round({_bleu_sql()}, 6) bleu from total", "pairs",
                           **_ngrams(_13a("after"), _13a("before"))),
    "google_bleu_13a": sql(
        """select round(cast(sum(m) as double) / sum(greatest(h, r)), 6) google_bleu
           from (select sum(m) m, sum(h) h, sum(r) r from per_n group by pair_id)""", "pairs",
        **_ngrams(_13a("after"), _13a("before"))),
    "generation_length": sql(
        f"""select round(avg(n), 6) id_length, round(avg(n), 6) text_length
            from (select len(regexp_extract_all(pred, {_TOKEN})) n from answers)""", "answers"),
    "macro_metrics": sql(
        f"""select round(avg(round({_bleu_sql()}, 4)), 6) bleu,
            round(avg(round(cast(m1 + m2 + m3 + m4 as double) / greatest(h1 + h2 + h3 + h4, r1 + r2 + r3 + r4), 4)), 6) google_bleu,
            round(avg(case when trim(before, {WS}) = trim(after, {WS}) then 1.0 else 0.0 end), 6) accuracy,
            round(avg(h1), 6) gen_len
            from pairs p join wide w on p.pair_id = w.pair_id""", "pairs", **_ngrams()),
    "confusion_metrics": sql(
        f"select {_AS_INT}, {_RATIOS} from (select {_COUNTS} from (select y, sc >= 0.5 p from scored_rows))",
        "scored_rows"),
    "roc_auc": sql(
        """select round((sum(case when y = 1 then r end) - max(p) * (max(p) + 1) / 2) / (max(p) * max(n)), 6) roc_auc
           from (select y, rank() over (order by sc) + (count(*) over (partition by sc) - 1) / 2.0 r,
                 count(*) filter (where y = 1) over () p, count(*) filter (where y = 0) over () n from scored_rows)""",
        "scored_rows"),
    "pr_auc": sql(
        """select round(sum((rec - prec_rec) * (pre + prev_pre) / 2), 6) pr_auc from (
               select rec, pre, lag(rec, 1, 0.0) over (order by sc desc) prec_rec,
                   lag(pre, 1, 1.0) over (order by sc desc) prev_pre
               from (select sc, cast(sum(p) over (order by sc desc) as double) / sum(p) over () rec,
                         cast(sum(p) over (order by sc desc) as double) / sum(c) over (order by sc desc) pre
                     from (select sc, sum(y) p, count(*) c from scored_rows group by sc)))""", "scored_rows"),
    "tpr_by_class": sql(_CLASS, "scored_rows", "names"),
    "tpr_top10": sql(f"select * from ({_CLASS}) order by tpr desc, total desc, cwe limit 10", "scored_rows", "names"),
    "rank_lines": sql(
        """select pair_id, pos, y, row_number() over (partition by pair_id order by sc desc, pos) as rank
           from scored_lines""", "scored_lines"),
    "top_k_accuracy": sql(
        "select " + ", ".join(f"round(avg(case when f <= {k} then 1.0 else 0.0 end), 6) top_{k}" for k in (1, 3, 5, 10))
        + f" from ({_FIRST})", "scored_lines"),
    "initial_false_alarm": sql(f"select round(avg(f - 1), 6) ifa from ({_FIRST})", "scored_lines"),
    "effort_at_recall": sql(
        f"select round(cast(min(i) as double) / max(n), 6) effort from ({_LINE_CUT}) where run >= 0.2 * hits",
        "scored_lines"),
    "recall_at_effort": sql(
        f"select round(cast(sum(y) as double) / max(hits), 6) recall from ({_LINE_CUT}) where i <= floor(0.01 * n)",
        "scored_lines"),
    "recall_by_pred_prob": sql(
        f"select round(cast(sum(y) as double) / max(hits), 6) recall from "
        f"({_SCORED_CUT.format(tie='id', view='scored_rows')}) where i <= floor(0.2 * n)", "scored_rows"),
    "longest_first": sql(
        f"select pair_id, len(regexp_extract_all(before, {_TOKEN})) n_tokens from functions", "functions"),
    "first_of_group": """select source, lang, doc_id, n_chars from documents
        qualify row_number() over (partition by source, lang order by doc_id) = 1""",
    "batch_score": sql(
        """select pair_id, line prediction from lines
           qualify row_number() over (partition by pair_id order by length(line) desc, pos) = 1""", "lines"),
    "bow_vectors": sql(
        """select f.pair_id, count(i.token) features,
               coalesce(string_agg(feature_id || ':' || n, ' ' order by feature_id) filter (where i.token is not null), '') bag
           from functions f left join bags b on f.pair_id = b.pair_id left join idx i on b.token = i.token group by f.pair_id""",
        "functions",
        bags=r"""select pair_id, token, count(*) n from (select pair_id, unnest(regexp_extract_all(before,
            '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]')) token from functions) group by 1, 2""",
        idx="select token, row_number() over (order by count(*) desc, token) - 1 feature_id from bags group by token having count(*) >= 2"),
    "embedding_counts": sql(
        f"""select pair_id, 17 as size, len(regexp_extract_all(before, '{C.C_TOKEN.replace("'", "''")}')) tokens
            from functions""", "functions"),
    "model_score": sql(
        f"""select pair_id, cast(floor(slope * length(before) + level) as bigint) prediction from functions,
            (select regr_slope(n, length(before)) slope, regr_intercept(n, length(before)) level
             from (select before, cast(len(string_split(before, {NL})) as double) n from functions))""", "functions"),
    "compare_variants": sql(
        f"""select variant, setting, {_AS_INT}, {_RATIOS} from (select variant, setting, {_COUNTS} from (
                select y, sc * 10 >= variant p, cast(variant as int) variant,
                    case when id % 2 = 0 then 'balanced' else 'imbalanced' end setting
                from (select *, unnest(range(1, 8)) variant from scored_rows)) group by 1, 2)""", "scored_rows"),
}
