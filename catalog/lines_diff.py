"""Line normalisation, diff and edit scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.diff_sql import diff_sql, script_sql
from catalog.fixtures import NL, WS, sql
from pairloom.functions import text as C
from pairloom.operators import diff as D
from pairloom.operators import lines as L
from pairloom.session import store_texts

_join = lambda c: F.array_join(c, "\n")


#: What makes the texts look like code: calls, operators, literals and comments, some of them open.
_AS_CODE = (("er ", "er ("), (" the ", " == the"), (" la ", ' "la \\" la" '), (" and ", " /* and"), (" of ", " of */ += "),
            (" que ", " 'q' -> "), (" und ", " // und "), (" de ", " 0x1F ... "))


def _called(spark, sf):
    """Functions with calls, literals, comments and operators."""
    body = F.col("before")
    for find, put in _AS_CODE:
        body = F.replace(body, F.lit(find), F.lit(put))
    return X.functions(spark, sf).withColumn("before", body)


def _as_code_sql() -> str:
    body = "before"
    for find, put in _AS_CODE:
        body = "replace({}, '{}', '{}')".format(body, find, put.replace("'", "''"))
    return body


def hunks(spark, sf):
    h = D.hunks(D.line_diff(X.pairs(spark, sf), "strip", True))
    return h.select("pair_id", "gap", "anchor", _join(F.col("deletes.line")).alias("deletes"),
                    _join(F.col("inserts.line")).alias("inserts"))


def _edits(spark, sf):
    return D.edits_of(X.pairs(spark, sf))


def injection_records(spark, sf):
    """The pairs are stored once; script and record both read them."""
    pairs = store_texts(X.pairs(spark, sf))
    return D.injection_records(pairs, D.edit_script(D.edits_of(pairs)))


def edit_script(spark, sf):
    one = lambda e: F.concat_ws("|", e["ord"], e["kind"], F.coalesce(e["key"], F.lit("")),
                                F.array_join(e["value"], "~"))
    return D.scripts_of(X.pairs(spark, sf)).select(
        "pair_id", F.size("script").cast("long").alias("edits"), _join(F.transform("script", one)).alias("script"))


def contiguous_locations(spark, sf):
    return D.contiguous_locations(X.applied_input(spark, sf))


QUERIES = {
    "explode_lines": lambda s, d: L.explode_lines(X.functions(s, d), "before"),
    "fold_braces": lambda s, d: X.functions(s, d).select(
        "pair_id", C.fold_braces(F.col("before")).alias("text")),
    "uniquify_lines": lambda s, d: L.uniquify_lines(X.functions(s, d), "before"),
    "canonical_text": lambda s, d: X.answers(s, d).select(
        "pair_id", C.canonical_text(F.col("pred")).alias("text")),
    "fingerprint": lambda s, d: X.pairs(s, d).select(
        "pair_id", C.fingerprint(F.col("before"), F.col("after")).alias("fingerprint")),
    "fingerprint_raw": lambda s, d: X.pairs(s, d).select(
        "pair_id", C.fingerprint_raw(F.col("before"), F.col("after")).alias("fingerprint")),
    "normalise_identifiers": lambda s, d: L.normalise_identifiers(_called(s, d), "before").select(
        "pair_id", F.array_join("tokens", " ").alias("tokens")),
    "extract_cwe": lambda s, d: X.names(s, d).select(
        F.explode(C.cwe_ids(F.col("name"))).alias("cwe")).distinct().orderBy("cwe"),
    "line_diff": lambda s, d: D.line_diff(X.pairs(s, d)).drop("moved"),
    "line_moves": lambda s, d: D.line_moves(D.line_diff(X.moved_pairs(s, d))),
    "insert_anchor": lambda s, d: D.insert_anchors(D.line_diff(X.pairs(s, d), "strip", True)),
    "hunks": hunks,
    "drop_noop_edits": lambda s, d: _edits(s, d).withColumn("value", _join(F.col("value"))),
    "edit_script": edit_script,
    "location_targets": lambda s, d: D.location_targets(D.scripts_of(X.pairs(s, d))),
    "injection_records": injection_records,
    "edit_stats": lambda s, d: D.edit_stats(D.scripts_of(X.pairs(s, d))),
    "contiguous_locations": contiguous_locations,
}

_RESERVED = ", ".join(f"'{w}'" for w in L.RESERVED)

ORACLES = {
    "explode_lines": sql("select pair_id, pos, line from lines", "lines"),
    "fold_braces": sql(
        f"""select pair_id, string_agg(piece, {NL} order by g) as text from (
                select pair_id, g, string_agg(case when brace then ' ' || trim(line, {WS}) else line end,
                                              '' order by pos) piece
                from (select *, sum(case when brace then 0 else 1 end) over (
                          partition by pair_id order by pos) g
                      from (select *, pos > 0 and trim(line, {WS}) in ('{{', '}}') brace from lines))
                group by pair_id, g) group by pair_id""", "lines"),
    "uniquify_lines": sql("select pair_id, before from unique_functions", "unique_functions"),
    "canonical_text": sql(
        f"""select pair_id, array_to_string(list_filter(list_transform(string_split(pred, {NL}),
            lambda x: ltrim(x, {WS})), lambda x: x <> ''), {NL}) as text from answers""", "answers"),
    "fingerprint": sql(
        r"""select pair_id, sha256(regexp_replace(before || after, '[ \n\r\t]', '', 'g')) fingerprint
            from pairs""", "pairs"),
    "fingerprint_raw": sql("select pair_id, sha256(before || after) fingerprint from pairs", "pairs"),
    "normalise_identifiers": sql(
        f"""select t.pair_id, string_agg(case when f.pair_id is null then t.token
                when f.call then 'FUN' || f.r else 'VAR' || f.r end, ' ' order by pos) tokens
            from t left join (
                select *, row_number() over (partition by pair_id, call order by p) r from (
                    select pair_id, token, min(pos) p, coalesce(arg_min(coalesce(nxt = '(', false), pos), false) call
                    from t where regexp_matches(token, '^[A-Za-z_][A-Za-z0-9_]*$')
                        and token not in ({_RESERVED}) group by 1, 2)) f
            on t.pair_id = f.pair_id and t.token = f.token group by t.pair_id""",
        "functions",
        t=f"""select *, lead(token) over (partition by pair_id order by pos) nxt from (
                select pair_id, generate_subscripts(l, 1) pos, unnest(l) token from (
                    select pair_id, regexp_extract_all({_as_code_sql()}, '{C.C_TOKEN.replace("'", "''")}') l from functions))"""),
    "extract_cwe": sql(
        "select distinct unnest(regexp_extract_all(name, 'CWE-[0-9]+')) cwe from names order by 1", "names"),
    "line_diff": diff_sql("select pair_id, bpos, apos, op, line from diff"),
    "line_moves": diff_sql(
        "select pair_id, bpos, apos, op, line from diff where moved", "moved_pairs",
        # In a rotation the longest increasing run is the larger of the two blocks;
        # of equal blocks the one with the smaller positions in after.
        anchors=f"""select u.pair_id, k, b, a from (
                select u.*, b < n // 3 as head,
                    count(*) filter (where b < n // 3) over (partition by u.pair_id) heads,
                    count(*) filter (where b >= n // 3) over (partition by u.pair_id) tails
                from uniq u join (select pair_id, len(string_split(before, {NL})) n from moved_pairs) m
                on u.pair_id = m.pair_id) u
            where head = (heads > tails)"""),
    "insert_anchor": script_sql(
        "select pair_id, pos as apos, line, anchor from gaps where side = 1 and not is_kept"),
    "hunks": script_sql(
        f"""select pair_id, gap, max(anchor) filter (where side = 1) anchor,
            coalesce(string_agg(line, {NL} order by pos) filter (where side = 0), '') deletes,
            coalesce(string_agg(line, {NL} order by pos) filter (where side = 1), '') inserts
            from touched group by pair_id, gap"""),
    "drop_noop_edits": script_sql(
        f"select pair_id, gap, idx, kind, key, array_to_string(value, {NL}) as value from edits"),
    "edit_script": script_sql(
        f"""select p.pair_id, count(n) edits, coalesce(string_agg(n || '|' || kind || '|' || coalesce(key, '') || '|'
                || array_to_string(value, '~'), {NL} order by n), '') script
            from pairs p left join (
                select *, row_number() over (partition by pair_id order by gap, idx) n from edits) e
            on p.pair_id = e.pair_id group by p.pair_id"""),
    "location_targets": script_sql(
        """select pair_id, case when n_gone < 15 and n_new < 15 then lines_with_vul end lines_with_vul,
            case when n_gone < 15 and n_new < 15 then lines_after_fix end lines_after_fix from targets"""),
    "injection_records": script_sql(
        "select r.pair_id, before, after, inputs, outputs from records r join pairs p on r.pair_id = p.pair_id"),
    "edit_stats": script_sql(
        """select count(*) pairs, count(*) filter (where not (n_gone < 15 and n_new < 15)) oversize,
            count(*) filter (where n_gone < 15 and n_new < 15) kept,
            cast(sum(n_gone) as bigint) lines_gone, cast(sum(n_new) as bigint) lines_new from targets"""),
    "contiguous_locations": sql(
        f"""select i.pair_id, bool_and(l.k is null or c.k = l.k) filter (where c.pair_id is not null) contiguous
            from applied_input i left join (select w.*, p0, w.i - 1 + p0 want from loc w join (
                    select f.pair_id, min(pos) p0 from fl f join loc w
                    on f.pair_id = w.pair_id and w.i = 1 and f.k = w.k group by f.pair_id) s
                on w.pair_id = s.pair_id) c on i.pair_id = c.pair_id
            left join fl l on c.pair_id = l.pair_id and l.pos = c.want
            group by i.pair_id""",
        "applied_input",
        loc=f"""select pair_id, i, trim(x, {WS}) k from (
            select pair_id, generate_subscripts(string_split(locations, {NL}), 1) i,
                unnest(string_split(locations, {NL})) x from applied_input where locations is not null)""",
        fl=f"select pair_id, pos, trim(line, {WS}) k from unique_lines"),
}
