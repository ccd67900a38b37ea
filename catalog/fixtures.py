"""Views over the given tables, once for Spark and once as SQL for the check engine.

``documents`` stands for functions; the pair, prediction, name and score views are
derived from it by rule (FIXTURES.md).  Every view covers all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions import text as X
from pairloom.operators import lines as L


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and whole texts of ``documents``, partitioned as the scan gives them at any size."""
    return table(spark, sf, "documents").select("doc_id", "text")


def functions(spark: SparkSession, sf: str) -> DataFrame:
    body = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("\n{\n")), F.lit(". "), F.lit(";\n}\n"))
    return texts(spark, sf).select(F.col("doc_id").alias("pair_id"), body.alias("before"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    def edit(l, i):
        main = (F.when(i % 7 == 3, F.array().cast("array<string>"))
                .when(i % 5 == 2, F.array(F.concat(l, F.lit(" mod"))))
                .when(i % 13 == 6, F.array(F.concat(F.lit("  "), l))).otherwise(F.array(l)))
        extra = F.when(i % 11 == 4, F.array(F.concat(F.lit("ins_"), i.cast("string")))).otherwise(
            F.array().cast("array<string>"))
        return F.concat(main, extra)
    return functions(spark, sf).withColumn(
        "after", F.array_join(F.flatten(F.transform(X.lines(F.col("before")), edit)), "\n"))


def moved_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """after = before with its first third moved to the end."""
    k = F.floor(F.size("_l") / 3).cast("int")
    return (functions(spark, sf).withColumn("_l", X.lines(F.col("before")))
            .withColumn("after", F.array_join(F.concat(
                F.slice("_l", k + 1, F.size("_l")), F.slice("_l", F.lit(1), k)), "\n"))
            .drop("_l"))


def unique_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.unique_lines(functions(spark, sf), "before")


def unique_functions(spark: SparkSession, sf: str) -> DataFrame:
    return L.assemble(unique_lines(spark, sf), "pair_id", "before")


def predicted_edits(spark: SparkSession, sf: str) -> DataFrame:
    kind, pos, line = F.col("pair_id") % 6, F.col("pos"), F.col("line")
    touched, added = pos % 5 == 2, (kind == 5) & (pos % 5 == 4)
    loc = (F.when(~touched | (kind == 0), F.lit(None))
           .when((kind == 1) & (pos == 2), "no such line").otherwise(line))
    chg = (F.when(kind == 0, F.lit(None))
           .when(~touched, F.concat(F.lit("A:"), line, F.lit("<endRow>new "), pos.cast("string")))
           .when(kind == 2, line)
           .when((kind == 4) & (pos % 10 == 7), "EmptyLine")
           .when((kind == 5) & (pos % 10 == 7), F.concat(line, F.lit(" one<s>two")))
           .otherwise(F.concat(line, F.lit(" mod"))))
    return (unique_lines(spark, sf).where(touched | added)
            .select("pair_id", F.when(kind == 3, -pos).otherwise(pos).alias("ord"),
                    loc.alias("loc"), chg.alias("chg")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    def joined(c):
        ordered = F.col(f"_e.{c}")
        kept = F.filter(ordered, lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).alias(
            "locations" if c == "loc" else "injections")
    return (predicted_edits(spark, sf).groupBy("pair_id")
            .agg(F.sort_array(F.collect_list(F.struct("ord", "loc", "chg"))).alias("_e"))
            .select("pair_id", joined("loc"), joined("chg")))


def applied_input(spark: SparkSession, sf: str) -> DataFrame:
    from pairloom.operators.tables import join_predictions
    return join_predictions(unique_functions(spark, sf), predictions(spark, sf))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"),
        F.expr("""case when doc_id % 3 = 0 then 'CVEFixes' else 'Other' end || '_'
                  || substr(md5(cast(doc_id % 50 as string)), 1, 8)
                  || '_CWE-' || cast(20 + doc_id % 7 * 33 as string)""").alias("name"))


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", "quality")
    return l.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"),
        F.round((F.col("n_chars") % 97).cast("double") / 97, 6).alias("sc"))


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    return unique_lines(spark, sf).select(
        "pair_id", "pos",
        (F.char_length("line").cast("double") / (F.col("pos") + 1)).alias("sc"),
        F.contains("line", F.lit("}")).cast("int").alias("y"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Generated and true texts: padded, indented or wrong ones in turn."""
    kind, after = F.col("pair_id") % 3, F.col("after")
    pred = (F.when(kind == 0, F.concat(F.lit("\n  "), after, F.lit("\n")))
            .when(kind == 1, F.concat(after, F.lit(" x")))
            .otherwise(F.replace(after, F.lit("\n"), F.lit("\n  "))))
    cwe = F.regexp_extract("name", "CWE-[0-9]+", 0)
    return (pairs(spark, sf).select("pair_id", pred.alias("pred"), after.alias("truth"))
            .join(names(spark, sf).select("pair_id", cwe.alias("cwe")), "pair_id"))


NL = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
EDGE = r"'^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$'"

VIEWS = {
    "functions": f"""select doc_id pair_id,
        replace(replace(text, ', ', {NL}||'{{'||{NL}), '. ', ';'||{NL}||'}}'||{NL}) before
        from documents""",
    "lines": f"""select pair_id, cast(generate_subscripts(string_split(before, {NL}), 1) - 1 as int) pos,
        unnest(string_split(before, {NL})) line from functions""",
    "pairs": f"""select f.pair_id, any_value(before) before,
        string_agg(x, {NL} order by pos, k) filter (where k >= 0) after
        from functions f join (
            select pair_id, pos, case when pos % 7 = 3 then -1 else 0 end k,
                   case when pos % 5 = 2 then line || ' mod' when pos % 13 = 6 then '  ' || line else line end x
            from lines
            union all select pair_id, pos, 1, 'ins_' || pos from lines where pos % 11 = 4) e
        on f.pair_id = e.pair_id group by f.pair_id""",
    "moved_pairs": f"""select pair_id, before,
        array_to_string(list_concat(l[k + 1:], l[:k]), {NL}) after
        from (select pair_id, before, string_split(before, {NL}) l,
                     len(string_split(before, {NL})) // 3 k from functions)""",
    "unique_lines": f"""select pair_id, pos, line || repeat(' ', cast(n - 1 as int)) line
        from (select *, row_number() over (
                partition by pair_id, regexp_replace(line, {EDGE}, '', 'g') order by pos) n from lines)""",
    "unique_functions": f"""select pair_id, string_agg(line, {NL} order by pos) before
        from unique_lines group by pair_id""",
    "predicted_edits": """select pair_id, case when pair_id % 6 = 3 then -pos else pos end ord,
        case when pos % 5 <> 2 or pair_id % 6 = 0 then null
             when pair_id % 6 = 1 and pos = 2 then 'no such line' else line end loc,
        case when pair_id % 6 = 0 then null
             when pos % 5 <> 2 then 'A:' || line || '<endRow>new ' || pos
             when pair_id % 6 = 2 then line
             when pair_id % 6 = 4 and pos % 10 = 7 then 'EmptyLine'
             when pair_id % 6 = 5 and pos % 10 = 7 then line || ' one<s>two'
             else line || ' mod' end chg
        from unique_lines where pos % 5 = 2 or (pair_id % 6 = 5 and pos % 5 = 4)""",
    "predictions": f"""select pair_id, string_agg(loc, {NL} order by ord) locations,
        string_agg(chg, {NL} order by ord) injections
        from predicted_edits group by pair_id""",
    "applied_input": """select u.pair_id, before, locations, injections
        from unique_functions u left join predictions p on u.pair_id = p.pair_id""",
    "names": """select doc_id pair_id, case when doc_id % 3 = 0 then 'CVEFixes' else 'Other' end || '_'
        || substr(md5(cast(doc_id % 50 as varchar)), 1, 8)
        || '_CWE-' || cast(20 + doc_id % 7 * 33 as varchar) name from documents""",
    "scored_rows": """select l.doc_id id, l.quality y, round(cast(d.n_chars % 97 as double) / 97, 6) sc
        from labels l join documents d on l.doc_id = d.doc_id""",
    "scored_lines": """select pair_id, pos, cast(length(line) as double) / (pos + 1) sc,
        case when line like '%}%' then 1 else 0 end y from unique_lines""",
    "answers": f"""select p.pair_id, case p.pair_id % 3 when 0 then {NL}||'  '||after||{NL}
            when 1 then after||' x' else replace(after, {NL}, {NL}||'  ') end pred,
        after truth, regexp_extract(name, 'CWE-[0-9]+') cwe
        from pairs p join names n on p.pair_id = n.pair_id""",
}

NEEDS = {
    "reworded": ["functions", "lines"],
    "lines": ["functions"], "pairs": ["lines"], "moved_pairs": ["functions"],
    "unique_lines": ["lines"], "unique_functions": ["unique_lines"],
    "predicted_edits": ["unique_lines"], "predictions": ["predicted_edits"],
    "applied_input": ["unique_functions", "predictions"],
    "scored_lines": ["unique_lines"], "answers": ["pairs", "names"],
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` below a WITH list of the views it needs; ``extra`` adds more."""
    order: list[str] = []

    def visit(name):
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    parts = [f"{v} as materialized ({VIEWS[v]})" for v in order]
    parts += [f"{k} as materialized ({v})" for k, v in extra.items()]
    return (f"with {', '.join(parts)} " if parts else "") + body
