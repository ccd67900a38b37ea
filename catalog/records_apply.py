"""Training records and edit application."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.diff_sql import script_views
from catalog.fixtures import NL, WS, sql, table
from pairloom import schema as S
from pairloom.functions import text as C
from pairloom.functions import wire
from pairloom.operators import apply as A, metrics
from pairloom.operators import records as R
from pairloom.operators.ranking import longest_first
from pairloom.plans import datasets, slices
from pairloom.session import scratch_path, store_texts


def _prompts(spark, sf):
    """Prompts with the predicted locations as the answer."""
    rows = X.applied_input(spark, sf)
    return rows.select("pair_id", wire.prompt(
        F.col("before"), F.coalesce("locations", F.lit("")), "<eos>").alias("prompt"))


def _lengths(spark, sf):
    return _prompts(spark, sf).select("pair_id", R.token_count(F.col("prompt")).cast("long").alias("n_tokens"))


def filter_max_tokens(spark, sf):
    kept, rest = R.within_limit(_lengths(spark, sf), "n_tokens")
    return kept.select("pair_id", F.lit(True).alias("kept")).unionByName(
        rest.withColumn("kept", F.lit(False)))


def oversize_rows(spark, sf):
    rows = X.applied_input(spark, sf).select(
        "pair_id", R.token_count(F.col("before")).alias("n_in"),
        R.token_count(F.coalesce("injections", F.lit(""))).alias("n_out"))
    return R.oversize_rows(rows)


def _encoded(spark, sf, length=None):
    f = X.functions(spark, sf)
    n_pad = F.col("n_pad")
    return R.encode_tokens(f, "before", R.vocabulary(f, "before"), length, runs=True).select(
        "pair_id", R.joined(F.col("input_ids"), 0, n_pad).alias("input_ids"),
        R.joined(F.col("attention_mask"), 0, n_pad, "").alias("attention_mask"),
        F.col("n_tokens").cast("long").alias("n_tokens"))


def encode_tokens(spark, sf):
    """Whole texts, padded to the longest."""
    return _encoded(spark, sf, R.LONGEST)


def encode_tokens_cut(spark, sf):
    """The model input: cut and padded to its fixed length."""
    return _encoded(spark, sf, S.INPUT_TOKENS)



def token_buckets(spark, sf):
    f = X.functions(spark, sf)
    return R.bucket_totals(R.encode_tokens(f, "before", R.vocabulary(f, "before")))


def sliced_job(spark, sf):
    """A job over slices of a thousand texts that is stopped after two and taken up again."""
    def job(rows):
        return rows.select("doc_id", "row_number", F.size(C.words(F.col("text"))).cast("long").alias("words"))

    folder = scratch_path(spark, "slices")
    slices.prepare(table(spark, sf, "documents").select("doc_id", "source", "text"), ["source", "doc_id"], 1000, folder)
    slices.run(spark, folder, job, limit=2)
    slices.run(spark, folder, job)
    return slices.result(spark, folder)


def mask_label_padding(spark, sf):
    # Stored, since they are read for the vocabulary and for the ids.
    rows = store_texts(X.predictions(spark, sf).withColumn("injections", F.coalesce("injections", F.lit(""))))
    ids = R.encode_tokens(rows, "injections", R.vocabulary(rows, "injections"), R.LONGEST, runs=True)
    masked = ids.select("pair_id", R.mask_label_padding(F.col("input_ids"), n_pad=F.col("n_pad")).alias("_m"))
    return masked.select("pair_id", R.joined(F.col("_m.head"), S.IGNORED_LABEL, F.col("_m.n_ignored")).alias("labels"))


def train_test_build(spark, sf):
    """Records of both splits: train rows are deduplicated, test rows are not."""
    rows = X.pairs(spark, sf).join(table(spark, sf, "labels").select(
        F.col("doc_id").alias("pair_id"), F.lit("test").alias("split")), "pair_id", "left")
    built = datasets.build_records(rows, dedup_rows=F.col("split").isNull())
    return (built.drop("before", "after").join(rows.select("pair_id", "split"), "pair_id")
            .withColumn("split", F.coalesce("split", F.lit("train"))))


def location_records(spark, sf):
    """Location prompts of both splits; see ``train_test_build``."""
    rows = datasets.dataset_table(X.pairs(spark, sf)).join(table(spark, sf, "labels").select(
        F.col("doc_id").alias("pair_id"), F.lit("test").alias("split")), "pair_id", "left")
    return datasets.location_records(rows, dedup_rows=F.col("split").isNull(), eos="<eos>")


def _scored(spark, sf):
    """Predicted edits applied to the source texts, with true texts and classes."""
    truth = X.pairs(spark, sf).select("pair_id", "after")
    cwe = X.names(spark, sf).select("pair_id", F.regexp_extract("name", "CWE-[0-9]+", 0).alias("cwe"))
    return _applied(spark, sf).join(truth, "pair_id").join(cwe, "pair_id")


def generate_and_score(spark, sf):
    """Pairs, matches, accuracy, problems and classes among the matches, of applied edits."""
    done = _scored(spark, sf)
    hit = metrics.canonical_match(F.col("generated"), F.col("after"))
    return done.agg(
        F.count("*").alias("pairs"), F.count_if(hit).alias("matched"), F.round(metrics.share(hit), 6).alias("accuracy"),
        F.count_if(A.problem()).alias("problems"), F.countDistinct(F.when(hit, F.col("cwe"))).alias("classes"))


def exact_match_misses(spark, sf):
    return datasets.misses(_scored(spark, sf)).select("pair_id", "status")


def split_balanced(spark, sf):
    rows = X.scored_rows(spark, sf).select("id", F.col("y").alias("target"))
    return R.split_balanced(rows, "target", "id")


def chunk_rows(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id")
    return R.chunk_rows(rows, ["source", "doc_id"], 100)


def drop_large_graph_rows(spark, sf):
    rows = X.functions(spark, sf).select("pair_id", R.token_count(F.col("before")).cast("long").alias("nodes"))
    return R.drop_large(rows, "nodes", 287)


def parse_script(spark, sf):
    return (X.predictions(spark, sf).select(
        "pair_id", F.explode(A.parse_script(F.col("injections"))).alias("p")).select("pair_id", "p.*"))


def locations_present(spark, sf):
    rows = X.applied_input(spark, sf)
    return rows.select("pair_id", A.locations_present(F.col("before"), F.col("locations")).alias("present"))


def _steps(spark, sf):
    return A.with_steps(X.applied_input(spark, sf))


def resolve_anchor(spark, sf):
    return (_steps(spark, sf).select("pair_id", F.inline("_inserts"))
            .select("pair_id", "at", F.col("line").alias("inserted")))


def apply_inserts(spark, sf):
    """All inserts, no replacement; without a prediction the text stays as it is."""
    new = F.when(F.col("injections").isNull(), F.col("_lines")).otherwise(
        A.with_inserts(F.col("_lines"), F.col("_inserts")))
    return _steps(spark, sf).select("pair_id", F.array_join(new, "\n").alias("text"))


def apply_replacements(spark, sf):
    given = F.col("locations").isNotNull() & F.col("injections").isNotNull()
    new = F.when(given, A.replaced_lines()).otherwise(F.col("_lines"))
    return _steps(spark, sf).select(
        "pair_id", F.array_join(new, "\n").alias("text"),
        F.when(given, F.size("_at")).otherwise(0).cast("long").alias("n_applied"))


def assemble_text(spark, sf):
    return X.answers(spark, sf).select(
        "pair_id", A.assemble_text(C.lines(F.replace("pred", F.lit("mod"), F.lit("   ")))).alias("text"))


def _applied(spark, sf):
    return A.apply_edits(X.applied_input(spark, sf))


def apply_status(spark, sf):
    return _applied(spark, sf).select(
        "pair_id", "status", A.problem("strict").alias("problem"),
        A.problem("custom").alias("problem_custom"))


QUERIES = {
    "build_prompt": _prompts,
    "split_prompt": lambda s, d: R.split_prompt(_prompts(s, d)).drop("prompt"),
    "token_lengths": lambda s, d: longest_first(_lengths(s, d), "n_tokens"),
    "filter_max_tokens": filter_max_tokens,
    "oversize_rows": oversize_rows,
    "vocabulary": lambda s, d: R.vocabulary(X.functions(s, d), "before"),
    "encode_tokens": encode_tokens, "encode_tokens_cut": encode_tokens_cut,
    "mask_label_padding": mask_label_padding,
    "token_buckets": token_buckets,
    "sliced_job": sliced_job,
    "train_test_build": train_test_build,
    "location_records": location_records,
    "dataset_table": lambda s, d: datasets.dataset_table(X.pairs(s, d)),
    "generate_and_score": generate_and_score,
    "exact_match_misses": exact_match_misses,
    "split_balanced": split_balanced,
    "chunk_rows": chunk_rows,
    "drop_large_graph_rows": drop_large_graph_rows,
    "parse_script": parse_script,
    "locations_present": locations_present,
    "resolve_anchor": resolve_anchor,
    "apply_inserts": apply_inserts,
    "apply_replacements": apply_replacements,
    "assemble_text": assemble_text,
    "apply_status": apply_status,
    "apply_edits": lambda s, d: _applied(s, d).select(
        "pair_id", "generated", "status", F.col("n_applied").cast("long").alias("n_applied")),
    "status_summary": lambda s, d: A.status_summary(_applied(s, d)),
    "round_trip": lambda s, d: datasets.round_trip(X.pairs(s, d)).select("pair_id", "status", "same"),
}

_TOKEN = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]'"
_HEAD = r"'^[ \t\n\x0B\f\r]*'"
_PROMPT = f"""select pair_id, 'function:' || {NL} || before || {NL} || 'Instruction:' || {NL}
    || coalesce(locations, '') || '<eos>' prompt from applied_input"""
_LENGTH = f"select pair_id, len(regexp_extract_all(prompt, {_TOKEN})) n_tokens from ({_PROMPT})"


def _vocab(source, column):
    return f"""select token, count(*) n, row_number() over (order by count(*) desc, token) token_id
        from (select unnest(regexp_extract_all({column}, {_TOKEN})) token from {source}) group by token"""


def _ids(source, column):
    return f"""select t.pair_id, pos, token_id from (
            select pair_id, generate_subscripts(l, 1) pos, unnest(l) token
            from (select pair_id, regexp_extract_all({column}, {_TOKEN}) l from {source})) t
        join vocab v on t.token = v.token"""


# Fold rule for the check engine: brace-only lines join the line before.
def _folded(table_sql: str, column: str) -> str:
    return f"""select pair_id, string_agg(piece, {NL} order by g) txt from (
        select pair_id, g, string_agg(case when brace then ' ' || trim(x, {WS}) else x end, '' order by i) piece
        from (select *, sum(case when brace then 0 else 1 end) over (partition by pair_id order by i) g
              from (select *, i > 1 and trim(x, {WS}) in ('{{', '}}') brace from (
                  select pair_id, generate_subscripts(string_split({column}, {NL}), 1) i,
                      unnest(string_split({column}, {NL})) x from ({table_sql}))))
        group by pair_id, g) group by pair_id"""


# Smallest power of two that is not below a number of tokens.
_WIDTH = "case when %s = 0 then 0 else list_filter(list_transform(range(31), lambda i: 1 << i), lambda x: x >= %s)[1] end"


def _width(n: str) -> str:
    return _WIDTH.replace("%s", n)


def _encode_sql(width: str, kept: str) -> str:
    return sql(
        f"""select pair_id, s || case when n in (0, w) then '' else ' ' end || rtrim(repeat('0 ', w - n)) input_ids,
            repeat('1', n) || repeat('0', w - n) attention_mask, n n_tokens
           from (select *, cast({width} as bigint) w from (
               select f.pair_id, count(pos) n, coalesce(string_agg(token_id, ' ' order by pos), '') s
               from functions f left join ids i on f.pair_id = i.pair_id and {kept} group by f.pair_id))""",
        "functions", vocab=_vocab("functions", "before"), ids=_ids("functions", "before"))


# Prepared pairs from the view ``stay``: braces folded, lines of before unique.
_READY = {
    "fb": _folded("select pair_id, before from stay", "before"),
    "fa": _folded("select pair_id, after from stay", "after"),
    "fl": f"""select pair_id, generate_subscripts(string_split(txt, {NL}), 1) i,
        unnest(string_split(txt, {NL})) x from fb""",
    "ub": f"""select pair_id, string_agg(x || repeat(' ', cast(n - 1 as int)), {NL} order by i) txt from (
        select *, row_number() over (partition by pair_id, trim(x, {WS}) order by i) n from fl) group by pair_id""",
    "ready": "select ub.pair_id, ub.txt before, fa.txt after from ub join fa on ub.pair_id = fa.pair_id",
}
_DATASET = """select r.pair_id, before, after, lines_with_vul, lines_after_fix
    from ready r join targets t on r.pair_id = t.pair_id"""


def _location_sql() -> str:
    return sql(
        f"""select pair_id, 'function:' || {NL} || before || {NL} || 'Instruction:' || {NL} || lines_after_fix
                || '<eos>' prompt
            from (select d.pair_id, ltrim(before, {WS}) before, lines_after_fix, l.doc_id is not null test
                  from ({_DATASET}) d left join labels l on d.pair_id = l.doc_id)
            qualify test or row_number() over (partition by test,
                regexp_replace(before || lines_after_fix, '[ \\n\\r\\t]', '', 'g') order by pair_id) = 1""",
        "pairs", stay="select * from pairs", **_READY, **script_views("ready"))


def _train_test_sql() -> str:
    stay = f"""select pair_id, split, before, after from (
            select p.pair_id, case when l.doc_id is null then 'train' else 'test' end split,
                ltrim(before, {WS}) before, after
            from pairs p left join labels l on p.pair_id = l.doc_id)
        qualify split = 'test' or row_number() over (partition by split,
            regexp_replace(before || after, '[ \\n\\r\\t]', '', 'g') order by pair_id) = 1"""
    return sql("select r.pair_id, inputs, outputs, split from records r join stay s on r.pair_id = s.pair_id",
               "pairs", stay=stay, **_READY, **script_views("ready"))


# Application as joins over exploded tables: lines and locations are unique here,
# so a location applies if it and all earlier ones have rising positions.
_APPLY = {
    "given": "select * from predicted_edits",
    "loc": f"""select pair_id, cast(row_number() over (partition by pair_id order by ord) as int) j, loc
        from given where loc is not null""",
    "chg": f"""select pair_id, cast(row_number() over (partition by pair_id order by ord) as int) j, chg
        from given where chg is not null and not starts_with(chg, 'A:')""",
    "hit": f"""select l.pair_id, l.j, u.pos, chg, lag(u.pos) over (partition by l.pair_id order by l.j) prev
        from loc l join chg c on l.pair_id = c.pair_id and l.j = c.j
        left join unique_lines u on l.pair_id = u.pair_id and ltrim(l.loc, {WS}) = ltrim(u.line, {WS})""",
    "used": """select * from (select *, bool_and(pos is not null and (prev is null or pos > prev)) over (
            partition by pair_id order by j) good from hit) where good""",
    "ins": f"""select g.pair_id, u.pos as at_pos, g.ord, split_part(chg, '<endRow>', 2) line
        from given g left join unique_lines u on g.pair_id = u.pair_id
            and ltrim(substr(split_part(chg, '<endRow>', 1), 3), {WS}) = ltrim(u.line, {WS})
        where starts_with(chg, 'A:')""",
    "swapped": f"""select u.pair_id, u.pos, case when h.pair_id is null then u.line
            else regexp_extract(u.line, {_HEAD}) || replace(replace(trim(h.chg, {WS}), '<s>', {NL}), 'EmptyLine', '')
            end line
        from unique_lines u left join used h on u.pair_id = h.pair_id and u.pos = h.pos""",
    "stat": f"""select i.pair_id, case when i.locations is null then 'IS NAN'
            when exists (select 1 from loc l where l.pair_id = i.pair_id
                         and not contains(i.before, trim(l.loc, {WS}))) then 'no location'
            when i.locations = i.injections then 'wrong location'
            when exists (select 1 from ins x where x.pair_id = i.pair_id and x.at_pos is null) then 'error'
            else 'ok' end status from applied_input i""",
    "gen": f"""select pair_id, string_agg(x, {NL} order by pos, k, ord) generated from (
            select pair_id, pos, 0 k, 0 ord, rtrim(line, {WS}) x from swapped
            union all select pair_id, at_pos, 1, ord, rtrim(line, {WS}) from ins)
        where x <> '' group by pair_id""",
}


def apply_sql(body: str, *views: str, **extra: str) -> str:
    return sql(body, "applied_input", "predicted_edits", "unique_lines", *views, **_APPLY, **extra)


_CANON = f"""array_to_string(list_filter(list_transform(string_split(%s, {NL}),
    lambda x: ltrim(x, {WS})), lambda x: x <> ''), {NL})"""
_JUDGED = f"""select s.pair_id, status, cwe, coalesce(status = 'ok' and {_CANON % "g.generated"} = {_CANON % "p.after"}, false) hit
    from stat s join pairs p on s.pair_id = p.pair_id left join gen g on s.pair_id = g.pair_id
    join (select pair_id, regexp_extract(name, 'CWE-[0-9]+') cwe from names) n on s.pair_id = n.pair_id"""


ORACLES = {
    "build_prompt": sql(_PROMPT, "applied_input"),
    "split_prompt": sql(
        f"""select pair_id, substr(prompt, 1, p - 1) model_input, substr(prompt, p) target
            from (select *, strpos(prompt, 'Instruction:' || {NL}) + 13 p from ({_PROMPT}))""", "applied_input"),
    "token_lengths": sql(_LENGTH, "applied_input"),
    "filter_max_tokens": sql(f"select pair_id, n_tokens <= 1400 kept from ({_LENGTH})", "applied_input"),
    "oversize_rows": sql(
        """select pair_id from n where n_in >= 2048
           or (n_out >= 500 and (select max(n_out) from n) > 500)""", "applied_input",
        n=f"""select pair_id, len(regexp_extract_all(before, {_TOKEN})) n_in,
              len(regexp_extract_all(coalesce(injections, ''), {_TOKEN})) n_out from applied_input"""),
    "vocabulary": sql(f"select * from ({_vocab('functions', 'before')})", "functions"),
    "encode_tokens": _encode_sql("(select max(len(regexp_extract_all(before, %s))) from functions)" % _TOKEN, "true"),
    "encode_tokens_cut": _encode_sql("2048", "pos <= 2048"),
    "token_buckets": sql(
        f"""select cast({_width('n')} as int) width, count(*) texts, cast(sum(n) as bigint) tokens,
            cast(sum({_width('n')}) as bigint) cells
            from (select len(regexp_extract_all(before, {_TOKEN})) n from functions) group by 1""", "functions"),
    "sliced_job": f"""select doc_id, r row_number, (r - 1) // 1000 chunk,
            len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) words
        from (select *, row_number() over (order by source, doc_id) r from documents)""",
    "mask_label_padding": sql(
        """select p.pair_id, array_to_string(list_concat(coalesce(l, []),
                case when w = coalesce(len(l), 0) then [] else
                    list_concat([0], list_transform(range(w - coalesce(len(l), 0) - 1), lambda x: -100)) end), ' ') labels
           from predictions p left join g on p.pair_id = g.pair_id
           cross join (select max(len(l)) w from g)""",
        "predictions", vocab=_vocab("predictions", "injections"), ids=_ids("predictions", "injections"),
        g="select pair_id, list(token_id order by pos) l from ids group by pair_id"),
    "train_test_build": _train_test_sql(),
    "location_records": _location_sql(),
    "dataset_table": sql(_DATASET, "pairs", stay="select * from pairs", **_READY, **script_views("ready")),
    "generate_and_score": apply_sql(
        """select count(*) pairs, count(*) filter (where hit) matched,
            round(avg(case when hit then 1.0 else 0.0 end), 6) accuracy, count(*) filter (where status <> 'ok') problems,
            count(distinct cwe) filter (where hit) classes from judged""", "pairs", "names", judged=_JUDGED),
    "exact_match_misses": apply_sql(
        "select pair_id, status from judged where not hit", "pairs", "names", judged=_JUDGED),
    "split_balanced": sql(
        """select id, target, r as rank, case when r <= m * 8 // 10 then 'train'
                when r <= m * 9 // 10 then 'val' else 'test' end split
           from (select id, y as target, row_number() over (partition by y order by md5(cast(id as varchar)), id) r
                 from scored_rows), (select min(c) m from (select count(*) c from scored_rows group by y))
           where r <= m""", "scored_rows"),
    "chunk_rows": """select *, (row_number - 1) // 100 chunk from (
        select source, doc_id, row_number() over (order by source, doc_id) row_number from documents)""",
    "drop_large_graph_rows": sql(
        f"""select * from (select pair_id, len(regexp_extract_all(before, {_TOKEN})) nodes from functions)
            where nodes <= 287""", "functions"),
    "parse_script": sql(
        f"""select pair_id, cast(i - 1 as int) ord, starts_with(x, 'A:') is_insert,
                case when starts_with(x, 'A:') then substr(split_part(x, '<endRow>', 1), 3) end anchor,
                case when starts_with(x, 'A:') then split_part(x, '<endRow>', 2) else x end line
            from (select pair_id, generate_subscripts(l, 1) i, unnest(l) x from (
                select pair_id, string_split(injections, {NL}) l from predictions))""", "predictions"),
    "locations_present": sql(
        f"""select i.pair_id, bool_and(contains(before, trim(loc, {WS}))) present
            from applied_input i left join predicted_edits e on i.pair_id = e.pair_id and loc is not null
            group by i.pair_id""", "applied_input", "predicted_edits"),
    "resolve_anchor": apply_sql('select pair_id, at_pos as "at", line inserted from ins'),
    "apply_inserts": apply_sql(
        f"""select pair_id, string_agg(line, {NL} order by pos, k, ord) as text from (
                select pair_id, pos, 0 k, 0 ord, line from unique_lines
                union all select pair_id, at_pos, 1, ord, line from ins)
            group by pair_id"""),
    "apply_replacements": apply_sql(
        f"""select s.pair_id, string_agg(line, {NL} order by pos) as text,
                coalesce(any_value(n), 0) n_applied
            from swapped s left join (select pair_id, count(*) n from used group by 1) u on s.pair_id = u.pair_id
            group by s.pair_id"""),
    "assemble_text": sql(
        f"""select pair_id, string_agg(rtrim(x, {WS}), {NL} order by i) as text from (
                select pair_id, generate_subscripts(l, 1) i, unnest(l) x from (
                    select pair_id, string_split(replace(pred, 'mod', '   '), {NL}) l from answers))
            where rtrim(x, {WS}) <> '' group by pair_id""", "answers"),
    "apply_status": apply_sql(
        """select pair_id, status, status <> 'ok' problem,
           status not in ('ok', 'wrong location') problem_custom from stat"""),
    "apply_edits": apply_sql(
        """select s.pair_id, status, case when status = 'ok' then generated end generated,
            case when status = 'ok' then coalesce(n, 0) end n_applied
           from stat s left join gen g on s.pair_id = g.pair_id
           left join (select pair_id, count(*) n from used group by 1) u on s.pair_id = u.pair_id"""),
    "status_summary": apply_sql(
        "select status, count(*) pairs, status = 'ok' usable from stat group by status"),
    "round_trip": sql("select pair_id, 'ok' status, true same from functions", "functions"),
}
