"""The line diff and its edit scripts as plain joins, for the check engine.

Built another way than the Spark operators: anchors by grouping, segments by a
running count over all lines, kept lines by self joins.
"""

from __future__ import annotations

from catalog.fixtures import NL, WS, sql


def diff_views(source: str, key: str = "exact", anchors: str = "select * from uniq") -> dict[str, str]:
    k = "line" if key == "exact" else f"trim(line, {WS})"
    blank = "" if key == "exact" else f" where trim(x, {WS}) <> ''"

    def side(n, column):
        return f"""select pair_id, {n} side, line, {k} as k,
            cast(row_number() over (partition by pair_id order by i) - 1 as int) pos
            from (select pair_id, i, x line from (
                select pair_id, generate_subscripts(string_split({column}, {NL}), 1) i,
                       unnest(string_split({column}, {NL})) x from {source}){blank})"""
    return {
        "sl": f"{side(0, 'before')} union all {side(1, 'after')}",
        "uniq": """select pair_id, k, max(pos) filter (where side = 0) b, max(pos) filter (where side = 1) a
            from sl group by pair_id, k
            having count(*) filter (where side = 0) = 1 and count(*) filter (where side = 1) = 1""",
        "anchors": anchors,
        "seg": """select s.*, n.k is not null as fixed,
            sum(case when n.k is null then 0 else 1 end) over (
                partition by s.pair_id, side order by pos) seg
            from sl s left join anchors n on s.pair_id = n.pair_id and s.k = n.k""",
        "rest": """select *, row_number() over (partition by pair_id, side, seg, k order by pos) occ
            from seg where not fixed""",
        "cand": """select x.pair_id, x.pos b, y.pos a, max(y.pos) over (
                partition by x.pair_id, x.seg order by x.pos
                rows between unbounded preceding and 1 preceding) reach
            from rest x join rest y on x.pair_id = y.pair_id and x.seg = y.seg and x.k = y.k
                and x.occ = y.occ and x.side = 0 and y.side = 1""",
        "kept": """select pair_id, b, a from anchors
            union all select pair_id, b, a from cand where reach is null or a > reach""",
        "swapped": """select pair_id, b, a from uniq where (pair_id, k) not in (select (pair_id, k) from anchors)
            union select pair_id, b, a from cand where a < reach""",
        "marked": """select s.pair_id, s.side, s.pos, s.line, kb.b as bpos, kb.a as apos,
                kb.pair_id is not null as is_kept
            from sl s left join kept kb on s.pair_id = kb.pair_id
                and s.pos = case when s.side = 0 then kb.b else kb.a end""",
        "diff": """select pair_id, pos as bpos, apos, case when is_kept then 'K' else 'D' end op, line,
                not is_kept and (pair_id, pos) in (select (pair_id, b) from swapped) moved
            from marked where side = 0
            union all select pair_id, null, pos, 'I', line,
                (pair_id, pos) in (select (pair_id, a) from swapped)
            from marked where side = 1 and not is_kept""",
    }


def script_views(source: str) -> dict[str, str]:
    v = diff_views(source, "strip")
    v["gaps"] = """select m.pair_id, m.side, m.pos, m.line, m.is_kept,
            cast(sum(case when m.is_kept then 1 else 0 end) over w as int) gap,
            last_value(case when m.is_kept then b.line end ignore nulls) over w anchor
        from marked m left join marked b on m.is_kept and m.pair_id = b.pair_id and b.side = 0 and b.pos = m.bpos
        window w as (partition by m.pair_id, m.side order by m.pos)"""
    v["touched"] = """select pair_id, gap, side, pos, line, anchor,
            row_number() over (partition by pair_id, gap, side order by pos) - 1 idx,
            count(*) filter (where side = 0) over (partition by pair_id, gap) nd,
            count(*) filter (where side = 1) over (partition by pair_id, gap) ni
        from gaps where not is_kept"""
    v["added"] = """select pair_id, gap, list(line order by pos) lines from touched
        where side = 1 group by pair_id, gap"""
    v["all_edits"] = """select t.pair_id, t.gap, cast(idx as int) idx,
            case when side = 1 then 'insert' when idx = nd - 1 and ni > 0 then 'replace' else 'remove' end kind,
            case when side = 1 then anchor else line end as key,
            case when side = 1 then [line] when idx = nd - 1 and ni > 0 then lines
                 else cast([] as varchar[]) end as value
        from touched t left join added x on t.pair_id = x.pair_id and t.gap = x.gap
        where side = 0 or nd = 0"""
    v["edits"] = f"""select * from all_edits where not (kind = 'replace' and len(value) = 1
        and trim(value[1], {WS}) = trim(key, {WS}))"""
    v["targets"] = f"""select p.pair_id,
            count(*) filter (where kind <> 'insert') n_gone, coalesce(sum(len(value)), 0) n_new,
            coalesce(string_agg(' ' || key, {NL} order by gap, idx) filter (where kind <> 'insert'), '') lines_after_fix,
            coalesce(string_agg(array_to_string(list_transform(value, lambda x: case kind when 'insert' then x
                else ' ' || x end), {NL}), {NL} order by gap, idx) filter (where len(value) > 0), '') lines_with_vul
        from {source} p left join edits e on p.pair_id = e.pair_id group by p.pair_id"""
    v["records"] = f"""select p.pair_id,
            any_value(before) || '<|endoftext|>' || {NL} || coalesce(
                string_agg(' ' || key, {NL} order by gap, idx) filter (where kind <> 'insert'), 'Empty') inputs,
            coalesce(string_agg(case kind when 'remove' then 'EmptyLine'
                when 'insert' then 'A:' || coalesce(key, '') || '<endRow>' || value[1]
                else ' ' || array_to_string(value, '<s> ') end, {NL} order by gap, idx), '') outputs
        from {source} p left join edits e on p.pair_id = e.pair_id group by p.pair_id"""
    return v


def diff_sql(body: str, source: str = "pairs", key: str = "exact", **kw) -> str:
    return sql(body, source, **diff_views(source, key, **kw))


def script_sql(body: str, source: str = "pairs", *views: str, **extra: str) -> str:
    return sql(body, source, *views, **{**script_views(source), **extra})
