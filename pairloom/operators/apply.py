"""Apply predicted edits to source text.

Everything here is a column expression over one (before, locations, injections)
row: no explode, no shuffle.  A location list is consumed by one forward pass over
the lines, which is exact for repeated lines too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import schema as S
from pairloom.functions import text as X
from pairloom.functions import wire
from pairloom.functions.arrays import fold_list, let, places

_INTS = "array<int>"


def parse_script(injections: Column) -> Column:
    """Array of (ord, is_insert, anchor, line): the change lines in order.

    A line is an insert if it starts with the tag and holds the anchor end mark;
    the first letter alone would also catch plain code.
    """
    def parse(c, i):
        tagged = F.startswith(c, F.lit(S.INSERT_TAG)) & F.contains(c, F.lit(S.ANCHOR_END))
        head = F.substring_index(c, S.ANCHOR_END, 1)
        return F.struct(
            i.alias("ord"), tagged.alias("is_insert"),
            F.when(tagged, wire.unescape(F.substr(head, F.lit(len(S.INSERT_TAG) + 1)))).alias("anchor"),
            F.when(tagged, wire.unescape(F.split_part(c, F.lit(S.ANCHOR_END), F.lit(2))))
            .otherwise(c).alias("line"))
    return F.transform(X.lines(injections), parse)


#: So many locations search the text one by one.
FEW_LOCATIONS = 200


def locations_present(before: Column, locations: Column) -> Column:
    """Every stripped location is a substring of the text; no location is fine.

    Of many locations, those that are whole lines are found in one pass, and only the others
    search the text; each of a few searches it.
    """
    stripped = lambda c: F.transform(X.lines(c), X.strip)
    inside = lambda wanted: F.forall(wanted, lambda x: F.contains(before, x))
    return (locations == S.NO_LOCATIONS) | let(stripped(locations), lambda wanted: F.when(
        F.size(wanted) <= FEW_LOCATIONS, inside(wanted)).otherwise(inside(F.array_except(wanted, stripped(before)))))


def resolve_anchor(keys: Column, anchor: Column) -> Column:
    """0-based line behind which an insert goes; -1 is the head, NULL not found.

    ``keys`` are the left-stripped lines; white space on the right counts.
    """
    at = F.array_position(keys, X.lstrip(anchor)).cast("int")
    return F.when(X.lstrip(anchor) == "", F.lit(-1)).when(at > 0, at - 1)


def _inserts(keys: Column, parsed: Column) -> Column:
    """Array of (at, grp, ord, line).  Neighbouring inserts on one anchor form a
    group; a later group on the same anchor lands before an earlier one."""
    tagged = F.transform(F.filter(parsed, lambda p: p["is_insert"]), lambda p: F.struct(
        resolve_anchor(keys, p["anchor"]).alias("at"), p["ord"].alias("ord"), p["line"].alias("line")))

    def step(state, x):
        goes_on = (x["at"].eqNullSafe(state["at"])) & (x["ord"] == state["ord"] + 1)
        grp = state["grp"] + F.when(goes_on, 0).otherwise(1)
        return (F.struct(grp.alias("grp"), x["at"].alias("at"), x["ord"].alias("ord")),
                F.array(F.struct(x["at"].alias("at"), grp.alias("grp"), x["ord"].alias("ord"), x["line"].alias("line"))))

    start = F.struct(F.lit(0).alias("grp"), F.lit(None).cast("int").alias("at"), F.lit(-2).alias("ord"))
    return fold_list(tagged, start, step, "struct<at:int,grp:int,ord:int,line:string>")


def matched_lines(keys: Column, locations: Column, limit: Column) -> Column:
    """Line numbers at which locations 1, 2, .. are consumed, in one walk.

    A location is consumed at the first later line with the same left-stripped
    text; one that is not found holds up all that follow.
    """
    def step(state, key, most):
        wanted = F.get(locations, state["j"])
        hit = F.coalesce((state["j"] < most) & (wanted == key) & (key != ""), F.lit(False))
        return (F.struct((state["i"] + 1).alias("i"), (state["j"] + hit.cast("int")).alias("j")),
                F.when(hit, F.array(state["i"])).otherwise(F.array().cast(_INTS)))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))
    return let(limit, lambda most: fold_list(keys, start, lambda state, key: step(state, key, most), "int"))


def replaced_line(line: Column, change: Column) -> Column:
    """The line with its text, not its indent, exchanged."""
    return F.concat(F.regexp_extract(line, "^" + X.WS_CLASS + "*", 0),
                    wire.decode_change(X.strip(change)))


def with_steps(df: DataFrame) -> DataFrame:
    """Intermediate arrays: lines, parsed changes, inserts and matched lines."""
    return (df
            .withColumn("_lines", X.lines(F.col("before")))
            .withColumn("_keys", F.transform("_lines", X.lstrip))
            .withColumn("_parsed", parse_script(F.col("injections")))
            .withColumn("_locs", F.transform(X.lines(F.col("locations")), X.lstrip))
            .withColumn("_changes", F.transform(
                F.filter("_parsed", lambda p: ~p["is_insert"]), lambda p: p["line"]))
            .withColumn("_inserts", let(
                F.col("_keys"), lambda keys: _inserts(keys, F.col("_parsed"))))
            .withColumn("_at", let(F.col("_locs"), lambda locs: matched_lines(
                F.col("_keys"), locs, F.least(F.size(locs), F.size("_changes"))))))


def replaced_lines() -> Column:
    """Lines after the replacements, still one array entry per source line."""
    def merge(given):
        def change(line, i):
            j = F.get(given["place"], i)
            return F.when(j > 0, replaced_line(line, F.get(given["changes"], j - 1))).otherwise(line)
        return F.transform("_lines", change)
    place = places(F.size("_lines"), F.col("_at"))
    return F.when(F.size("_at") == 0, F.col("_lines")).otherwise(
        let(F.struct(place.alias("place"), F.col("_changes").alias("changes")), merge))


def with_inserts(lines: Column, inserts: Column) -> Column:
    """Merge inserts behind their anchor lines by one sort of small keys."""
    own = F.transform(lines, lambda l, i: F.struct(
        i.alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("grp"), F.lit(0).alias("ord"),
        l.alias("line")))
    new = F.transform(inserts, lambda x: F.struct(
        x["at"].alias("at"), F.lit(1).alias("kind"), (-x["grp"]).alias("grp"),
        x["ord"].alias("ord"), x["line"].alias("line")))
    merged = F.transform(F.sort_array(F.concat(own, new)), lambda r: r["line"])
    return F.when(F.size(inserts) == 0, lines).otherwise(merged)


def assemble_text(lines: Column) -> Column:
    """Right-strip every line, drop the empty ones, join."""
    return F.array_join(F.filter(F.transform(lines, X.rstrip), lambda l: l != ""), "\n")


def status() -> Column:
    """First problem that applies, else ok."""
    broken = (F.col("injections").isNull()
              | F.exists("_parsed", lambda p: ~p["is_insert"] & (p["line"] == ""))
              | F.exists("_inserts", lambda x: x["at"].isNull()))
    return (F.when(F.col("before").isNull() | F.col("locations").isNull(), S.STATUS_MISSING)
            .when(~locations_present(F.col("before"), F.col("locations")), S.STATUS_ABSENT)
            .when(F.col("injections").eqNullSafe(F.col("locations")), S.STATUS_UNCHANGED)
            .when(broken, S.STATUS_ERROR)
            .otherwise(S.STATUS_OK))


def apply_edits(df: DataFrame) -> DataFrame:
    """Add ``generated``, ``status`` and ``n_applied`` to rows with the columns
    before, locations and injections.  ``generated`` is NULL unless ok."""
    done = with_steps(df).withColumn("status", status())
    ok = F.col("status") == S.STATUS_OK
    text = assemble_text(with_inserts(replaced_lines(), F.col("_inserts")))
    return done.select(
        *df.columns, F.when(ok, text).alias("generated"), "status",
        F.when(ok, F.size("_at")).alias("n_applied"))


def in_band(applied: DataFrame, mode: str = "strict") -> DataFrame:
    """One text column with the problem code in place of a missing result.

    ``strict`` writes the status text, ``custom`` the empty string.
    """
    code = {"strict": F.col("status"), "custom": F.lit("")}[mode]
    return applied.withColumn("generated", F.coalesce("generated", code))


def problem(mode: str = "strict") -> Column:
    """Does the row count as a problem?  ``custom`` tolerates unchanged text."""
    tolerated = {"strict": [S.STATUS_OK], "custom": [S.STATUS_OK, S.STATUS_UNCHANGED]}[mode]
    return ~F.col("status").isin(tolerated)


def status_summary(applied: DataFrame) -> DataFrame:
    return (applied.groupBy("status").agg(F.count("*").alias("pairs"))
            .withColumn("usable", F.col("status") == S.STATUS_OK))
