"""Sources, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from catalog import fixtures as X
from catalog.diff_sql import script_sql
from catalog.fixtures import NL, WS, sql, table
from pairloom.functions import text as C
from pairloom.operators import dedup, diff, tables
from pairloom.session import scratch_path
from pairloom.sources import files

_PAIR_TEXTS = T.StructType([
    T.StructField("pair_id", T.LongType()), T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType())])


def scan_pairs(spark, sf):
    source = scratch_path(spark, "pairs-csv")
    files.write_csv(X.pairs(spark, sf), source)
    return files.csv_to_parquet(spark, source, scratch_path(spark, "pairs"), _PAIR_TEXTS,
                                ("before", "after")).select("pair_id", "before", "after")


def _broken_json(spark, sf):
    """events.props as JSON lines; each tenth line is cut short."""
    line = F.when(F.col("event_id") % 10 == 3, F.expr("substr(props, 1, length(props) - 1)")) \
        .otherwise(F.col("props"))
    path = scratch_path(spark, "json-lines")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return files.read_jsonl(spark, path, T.StructType([T.StructField("k", T.LongType())]))


def scan_jsonl(spark, sf):
    good, bad = _broken_json(spark, sf)
    per_key = good.groupBy(F.col("k")).agg(F.count("*").alias("rows"), F.lit(False).alias("bad"))
    return per_key.unionByName(bad.agg(
        F.lit(None).cast("long").alias("k"), F.count("*").alias("rows"), F.lit(True).alias("bad")))


def _corpus(spark, sf):
    """Function corpus: func, target, source and language of each document."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l.select("doc_id", F.col("quality").alias("target")), "doc_id", "left").select(
        "doc_id", F.col("text").alias("func"), F.coalesce("target", F.lit(0)).alias("target"),
        "lang", "source")


_CORPUS = """select d.doc_id, d.text func, coalesce(l.quality, 0) target, d.lang, d.source
    from documents d left join labels l on d.doc_id = l.doc_id"""


def write_jsonl(spark, sf):
    """Written as JSON lines and read back, rendered with a fixed field order."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(_corpus(spark, sf).select("doc_id", "target", "lang"), path)
    back, _ = files.read_jsonl(spark, path, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("target", T.LongType()), T.StructField("lang", T.StringType())]))
    return back.select("doc_id", files.json_lines("doc_id", "target", "lang").alias("json"))


def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(X.pairs(spark, sf).select("before", "after", "pair_id"), path, index="pair_id")
    return files.read_csv(spark, path, _PAIR_TEXTS)


def _too_long(spark, sf):
    return X.functions(spark, sf).where(F.char_length("before") > 3000)


def exclusion_table(spark, sf):
    path = scratch_path(spark, "keys")
    files.write_keys(_too_long(spark, sf), path)
    return files.read_keys(spark, path)


def scan_hub_export(spark, sf):
    return files.read_export(spark, f"{sf}/documents.parquet", commit_id="doc_id", func="text")


def assign_row_id(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return files.assign_row_id(d, ["source", "doc_id"])


def drop_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("nullif(lang, 'es')").alias("lang"), "source")
    return tables.drop_missing(d, "lang", "source")


def fill_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("nullif(lang, 'es')").alias("lang"))
    return tables.fill_missing(d, "lang")


def filter_contains(spark, sf):
    f, u = X.functions(spark, sf), X.names(spark, sf)
    left, right = tables.drop_where_contains(f, "before", "tion", "pair_id", f, u)
    return left.select("pair_id", F.char_length("before").alias("chars")).join(right, "pair_id")


def filter_line_counts(spark, sf):
    rows = X.applied_input(spark, sf)
    return tables.few_locations_short_function(rows, 60).select("pair_id")


def _scripts(spark, sf):
    return diff.scripts_of(X.pairs(spark, sf))


def filter_edit_size(spark, sf):
    kept = diff.location_targets(_scripts(spark, sf), max_lines=30)
    return tables.drop_missing(kept, "lines_with_vul", "lines_after_fix")


def _reworded(spark, sf):
    """Pairs with words changed, dropped and added inside lines, besides whole lines."""
    def edit(l, i):
        w = C.words(l)
        return (F.when(i % 7 == 3, F.array().cast("array<string>"))
                .when(i % 5 == 2, F.array(F.regexp_replace(l, "([aeiou])(\\S*) ", "$1x$2 ")))
                .when(i % 11 == 6, F.array(F.concat(F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " "), F.lit(" cut"))))
                .when(i % 13 == 8, F.array(F.concat(l, F.lit(" and more")), F.lit("one new line"))).otherwise(F.array(l)))
    return X.functions(spark, sf).withColumn(
        "after", F.array_join(F.flatten(F.transform(C.lines(F.col("before")), edit)), "\n"))


X.VIEWS["reworded"] = f"""select f.pair_id, any_value(before) before, string_agg(x, {NL} order by pos, k) filter (where k >= 0) after
    from functions f join (
        select pair_id, pos, case when pos % 7 = 3 then -1 else 0 end k,
               case when pos % 5 = 2 then regexp_replace(line, '([aeiou])(\\S*) ', '\\1x\\2 ', 'g')
                    when pos % 11 = 6 then array_to_string(list_filter(string_split_regex(trim(line, {WS}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x, i: i > 1), ' ') || ' cut'
                    when pos % 13 = 8 then line || ' and more' else line end x from lines
        union all select pair_id, pos, 1, 'one new line' from lines
            where pos % 13 = 8 and pos % 7 <> 3 and pos % 5 <> 2 and pos % 11 <> 6) e
    on f.pair_id = e.pair_id group by f.pair_id"""


def size_buckets(spark, sf):
    sizes = diff.scripts_of(_reworded(spark, sf)).select("pair_id", diff.changed_words(F.col("script")).alias("changed_words"))
    return tables.size_buckets(sizes, "changed_words")


def file_row_ids(spark, sf):
    """Texts written to several files in order, without any key, and numbered on reading."""
    path = scratch_path(spark, "no-key")
    (table(spark, sf, "documents").select("doc_id", "text").repartitionByRange(6, "doc_id")
     .sortWithinPartitions("doc_id").select("text").write.json(path))
    rows = files.file_row_ids(spark.read.schema("text string").json(path))
    return rows.select("pair_id", F.md5("text").alias("digest"))


def split_leak_check(spark, sf):
    rows = _dedup_fixture(spark, sf)
    train, test = rows.where(F.col("pair_id") % 5 != 0), rows.where(F.col("pair_id") % 5 == 0)
    key = C.fingerprint(F.col("before"), F.col("after"))
    return dedup.split_leaks(train, test, key)


def sample_k(spark, sf):
    return tables.sample_k(table(spark, sf, "documents").select("doc_id", "lang"), 100, "-42", "doc_id")


def strip_number_suffix(spark, sf):
    n = table(spark, sf, "documents").select(
        "doc_id", F.concat("lang", F.lit("_"), F.col("n_chars").cast("string")).alias("name"))
    return n.select("doc_id", C.strip_number_suffix(F.col("name")).alias("name"))


def _dedup_fixture(spark, sf):
    """Pairs whose white space differs between copies: only one key catches that."""
    d = table(spark, sf, "documents")
    before = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("pair_id"), before.alias("before"), F.col("lang").alias("after"))


_DEDUP = f"""select doc_id pair_id, case when doc_id % 2 = 0 then replace(text, ' ', {NL}) else text end before,
    lang after from documents"""


def _locations_of_pairs(spark, sf):
    return X.functions(spark, sf).join(X.predictions(spark, sf), "pair_id", "left") \
        .withColumn("locations", F.coalesce("locations", F.lit("")))


def dedup_location_pairs(spark, sf):
    d = _locations_of_pairs(spark, sf)
    return dedup.keep_first(d, C.fingerprint(F.col("before"), F.col("locations"))).select("pair_id")


def exclude_rows(spark, sf):
    f = X.functions(spark, sf)
    return tables.exclude_rows(f, _too_long(spark, sf)).select("pair_id", F.md5("before").alias("digest"))


def join_predictions(spark, sf):
    return X.applied_input(spark, sf).select(
        "pair_id", F.md5("before").alias("before_digest"), "locations", "injections")


def attach_locations(spark, sf):
    rows = X.applied_input(spark, sf)
    return rows.select("pair_id", tables.attach_locations(F.col("before"), F.col("locations")).alias("inputs"))


def commit_to_cwe(spark, sf):
    name = X.names(spark, sf).select(
        F.split("name", "_")[1].alias("commit_id"), F.col("pair_id").alias("row_id"),
        F.when(F.col("pair_id") % 5 == 0, "NA").otherwise(F.split("name", "_")[2]).alias("cwe"))
    commits = tables.from_source(X.names(spark, sf), "CVEFixes").select("commit_id").distinct()
    return tables.commit_to_cwe(name, commits)


def distinct_values(spark, sf):
    return table(spark, sf, "documents").agg(
        F.count_distinct("source").alias("sources"), F.count_distinct("lang", "source").alias("pairs"))


QUERIES = {
    "scan_pairs": scan_pairs,
    "scan_jsonl": scan_jsonl,
    "write_jsonl": write_jsonl,
    "write_csv": write_csv,
    "exclusion_table": exclusion_table,
    "scan_hub_export": scan_hub_export,
    "assign_row_id": assign_row_id,
    "file_row_ids": file_row_ids,
    "split_leak_check": split_leak_check,
    "select_columns": lambda s, d: _corpus(s, d).select("func", "target"),
    "drop_columns": lambda s, d: _corpus(s, d).drop("lang", "source"),
    "drop_missing": drop_missing,
    "fill_missing": fill_missing,
    "lstrip_text": lambda s, d: X.answers(s, d).select(
        "pair_id", C.lstrip(F.col("pred")).alias("text")),
    "collapse_indent": lambda s, d: X.answers(s, d).select(
        "pair_id", C.collapse_indent(F.col("pred")).alias("text")),
    "filter_label_length": lambda s, d: tables.short_negatives(_corpus(s, d)).select("doc_id", "target"),
    "filter_contains": filter_contains,
    "filter_line_counts": filter_line_counts,
    "filter_source_name": lambda s, d: tables.from_source(X.names(s, d), "CVEFixes"),
    "filter_edit_size": filter_edit_size,
    "size_buckets": size_buckets,
    "sample_k": sample_k,
    "apply_filter": lambda s, d: tables.apply_filter(
        _corpus(s, d), (F.col("lang") == "en") & (F.col("target") == 1)).select("doc_id", "source"),
    "strip_number_suffix": strip_number_suffix,
    "dedup_pairs": lambda s, d: dedup.keep_first(
        _dedup_fixture(s, d), C.fingerprint(F.col("before"), F.col("after"))),
    "dedup_location_pairs": dedup_location_pairs,
    "dedup_raw": lambda s, d: dedup.keep_first(
        _dedup_fixture(s, d), C.fingerprint_raw(F.col("before"), F.col("after"))),
    "duplicate_groups": lambda s, d: dedup.duplicate_groups(
        _dedup_fixture(s, d), C.fingerprint(F.col("before"), F.col("after"))),
    "exclude_rows": exclude_rows,
    "join_predictions": join_predictions,
    "attach_locations": attach_locations,
    "commit_to_cwe": commit_to_cwe,
    "distinct_values": distinct_values,
}

_SQUEEZE = r"regexp_replace(%s, '[ \n\r\t]', '', 'g')"
_FP = f"sha256({_SQUEEZE % 'before'} || {_SQUEEZE % 'after'})"

ORACLES = {
    "scan_pairs": sql("select pair_id, before, after from pairs", "pairs"),
    "scan_jsonl": """with r as (select case when event_id % 10 = 3 then substr(props, 1, length(props) - 1)
            else props end p from events)
        select case when json_valid(p) then cast(json_extract_string(p, '$.k') as bigint) end k,
            count(*) as rows, not json_valid(p) bad from r group by 1, 3""",
    "write_jsonl": f"""with c as ({_CORPUS}) select doc_id,
        '{{"doc_id":' || doc_id || ',"target":' || target || ',"lang":"' || lang || '"}}' json from c""",
    "write_csv": sql("select pair_id, before, after from pairs", "pairs"),
    "exclusion_table": sql("select pair_id from functions where length(before) > 3000", "functions"),
    "scan_hub_export": "select doc_id commit_id, text func from documents",
    "assign_row_id": """select source, doc_id, row_number() over (order by source, doc_id) - 1 pair_id
        from documents""",
    "file_row_ids": """select row_number() over (order by doc_id) - 1 pair_id, md5(text) digest from documents""",
    "split_leak_check": f"""with d as (select pair_id, pair_id % 5 = 0 is_test, {_FP} fp from ({_DEDUP}))
        select case when is_test then 'test' else 'train' end split, pair_id, fp fingerprint from d
        where fp in (select fp from d where is_test) and fp in (select fp from d where not is_test)""",
    "select_columns": f"with c as ({_CORPUS}) select func, target from c",
    "drop_columns": f"with c as ({_CORPUS}) select doc_id, func, target from c",
    "drop_missing": "select doc_id, lang, source from documents where lang <> 'es'",
    "fill_missing": "select doc_id, case when lang = 'es' then '' else lang end lang from documents",
    "lstrip_text": sql(f"select pair_id, ltrim(pred, {WS}) as text from answers", "answers"),
    "collapse_indent": sql(
        f"""select pair_id, string_agg(case when i = 1 then trim(x, {WS}) else ltrim(x, {WS}) end,
                {NL} order by i) as text
            from (select pair_id, generate_subscripts(l, 1) i, unnest(l) x from
                  (select pair_id, string_split(trim(pred, {WS}), {NL}) l from answers))
            where i = 1 or trim(x, {WS}) <> '' group by pair_id""", "answers"),
    "filter_label_length": f"""with c as ({_CORPUS}) select doc_id, target from c
        where target = 0 and length(func) < 4000""",
    "filter_contains": sql(
        """select f.pair_id, cast(length(before) as int) chars, name
           from functions f join names n on f.pair_id = n.pair_id where strpos(before, 'tion') = 0""",
        "functions", "names"),
    "filter_line_counts": sql(
        f"""select pair_id from applied_input
            where len(string_split(locations, {NL})) < len(string_split(injections, {NL}))
              and len(string_split(before, {NL})) < 60""", "applied_input"),
    "filter_source_name": sql(
        """select pair_id, name, split_part(name, '_', 2) commit_id from names
           where name like '%CVEFixes%'""", "names"),
    "filter_edit_size": script_sql(
        """select pair_id, lines_with_vul, lines_after_fix from targets where n_gone < 30 and n_new < 30"""),
    # The edit distance by its table, one row of all edits a step; the minimum to the left of a cell
    # is a running one.
    "size_buckets": script_sql(
        """select pair_id, n changed_words, n < 5 below_5, n < 10 below_10, n < 20 below_20, n < 30 below_30
           from (select p.pair_id, cast(coalesce(sum(coalesce(d, len(old) + len(new))), 0) as bigint) n
                 from reworded p left join worded e on p.pair_id = e.pair_id left join cells c
                   on c.id = e.id and c.i = len(old) and c.j = len(new) group by p.pair_id)""",
        "reworded",
        worded="""select row_number() over () id, pair_id, kind,
            case when kind = 'insert' then [] else regexp_extract_all(key, '[^ \\t\\n\\x0B\\f\\r]+') end old,
            regexp_extract_all(array_to_string(value, ' '), '[^ \\t\\n\\x0B\\f\\r]+') new from edits""",
        cells="""select id, 0 i, unnest(range(0, len(new) + 1)) j, unnest(range(0, len(new) + 1)) d from worded where kind = 'replace'
            union all select id, i + 1, j, min(up - j) over (partition by id order by j rows unbounded preceding) + j
            from (select c.id, i, j, old, new, case when j = 0 then i + 1 else least(d + 1,
                      lag(d) over (partition by c.id order by j) + case when old[i + 1] = new[j] then 0 else 1 end) end up
                  from cells c join worded w on c.id = w.id where i < len(old))"""
    ).replace("with ", "with recursive ", 1).replace("cells as materialized", "cells as", 1),
    "sample_k": """select doc_id, lang from documents
        order by md5(cast(doc_id as varchar) || '-42'), doc_id limit 100""",
    "apply_filter": f"with c as ({_CORPUS}) select doc_id, source from c where lang = 'en' and target = 1",
    "strip_number_suffix": """select doc_id, case when n_chars < 1000 then lang
        else lang || '_' || n_chars end as name from documents""",
    "dedup_pairs": f"""with d as ({_DEDUP}) select pair_id, before, after from d
        qualify row_number() over (partition by {_FP} order by pair_id) = 1""",
    "dedup_location_pairs": sql(
        f"""select pair_id from d qualify row_number() over (
            partition by sha256({_SQUEEZE % 'before'} || {_SQUEEZE % 'l'}) order by pair_id) = 1""",
        "functions", "predictions",
        d="""select f.pair_id, before, coalesce(locations, '') l
             from functions f left join predictions p on f.pair_id = p.pair_id"""),
    "dedup_raw": f"""with d as ({_DEDUP}) select pair_id, before, after from d
        qualify row_number() over (partition by before || after order by pair_id) = 1""",
    "duplicate_groups": f"""with d as (select pair_id, {_FP} fingerprint from ({_DEDUP}))
        select fingerprint, pair_id, count(*) over w copies, min(pair_id) over w first_id from d
        window w as (partition by fingerprint) qualify copies > 1""",
    "exclude_rows": sql(
        "select pair_id, md5(before) digest from functions where not length(before) > 3000", "functions"),
    "join_predictions": sql(
        "select pair_id, md5(before) before_digest, locations, injections from applied_input", "applied_input"),
    "attach_locations": sql(
        f"""select pair_id, before || '<|endoftext|>' || {NL} || coalesce(locations, '') inputs
            from applied_input""", "applied_input"),
    "commit_to_cwe": sql(
        """select distinct cwe from (
               select split_part(name, '_', 2) c, arg_max(split_part(name, '_', 3), pair_id) cwe
               from names where pair_id % 5 <> 0 group by 1)
           where c in (select split_part(name, '_', 2) from names where starts_with(name, 'CVEFixes'))""",
        "names"),
    "distinct_values": """select count(distinct source) sources,
        (select count(*) from (select distinct lang, source from documents)) pairs from documents""",
}
