"""Line diff of text pairs, and the edit scripts made from it.

Anchors are lines that occur once on each side.  They are found per pair with
array functions, so the texts are not exploded for it.  Kept anchors cut both
sides into segments; the remaining lines of a segment are matched by their text
and their occurrence number with one aggregation and two windows.  The pairs are
hash-partitioned by ``pair_id`` once, while each is still a single compact row,
and every later grouping reuses that partitioning.

The result is monotone in both positions but not always minimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import schema as S
from pairloom.functions import text as X
from pairloom.functions import wire
from pairloom.functions.arrays import let, places
from pairloom.operators.scale import dealt_by_id

_INTS = "array<int>"


def longest_increasing(seq: Column) -> Column:
    """Indexes of a longest increasing subsequence of an integer array.

    Patience sorting: each value goes on the first pile whose top is not smaller
    (found by bisection) and remembers its pile; one walk from the right then
    picks a value per pile.
    """
    def pile(tops, x):
        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            smaller = F.get(tops, mid) < x
            return F.when(s["lo"] < s["hi"], F.struct(
                F.when(smaller, mid + 1).otherwise(s["lo"]).alias("lo"),
                F.when(smaller, s["hi"]).otherwise(mid).alias("hi"))).otherwise(s)
        n = F.size(tops)
        steps = F.sequence(F.lit(0), F.floor(F.log2(n + 1)).cast("int"))
        found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve,
                            lambda s: s["lo"])
        return F.when((n == 0) | (F.get(tops, n - 1) < x), n).otherwise(found)

    def place(acc, x):
        return let(pile(acc["tops"], x), lambda k: F.struct(
            F.concat(F.slice(acc["tops"], F.lit(1), k), F.array(x),
                     F.slice(acc["tops"], k + 2, F.size(acc["tops"]))).alias("tops"),
            F.concat(acc["piles"], F.array(k)).alias("piles")))

    empty = F.array().cast(_INTS)
    piles = F.aggregate(seq, F.struct(empty.alias("tops"), empty.alias("piles")), place,
                        lambda acc: acc["piles"])

    def pick(acc, v):
        hit = (v["pile"] == acc["need"]) & (v["x"] < acc["below"])
        return F.when(hit, F.struct(
            (acc["need"] - 1).alias("need"), v["x"].alias("below"),
            F.concat(F.array(v["i"]), acc["out"]).alias("out"))).otherwise(acc)

    def walk(piles):
        values = F.reverse(F.transform(piles, lambda k, i: F.struct(
            k.alias("pile"), F.get(seq, i).alias("x"), i.alias("i"))))
        start = F.struct(F.array_max(piles).alias("need"), F.lit(2**31 - 1).alias("below"),
                         empty.alias("out"))
        return F.aggregate(values, start, pick, lambda acc: acc["out"])

    return let(piles, walk)


def _key(mode: str):
    return {"exact": lambda c: c, "strip": X.strip}[mode]


def _side(text: Column, mode: str, drop_blank: bool, side: int) -> Column:
    """Array of (key, side, pos, line); ``pos`` counts the lines that are kept."""
    kept = X.lines(text)
    if drop_blank:
        kept = F.filter(kept, lambda l: X.strip(l) != "")
    return F.transform(kept, lambda l, i: F.struct(
        _key(mode)(l).alias("key"), F.lit(side).alias("side"), i.alias("pos"), l.alias("line")))


def _anchors(merged: Column) -> Column:
    """(b, a) positions of keys seen exactly once per side, ordered by b.

    ``merged`` holds both sides sorted by (key, side, pos): such a key is a run of
    two neighbours with sides 0 and 1.
    """
    def look(r, j):
        nxt, after, prev = F.get(merged, j + 1), F.get(merged, j + 2), F.get(merged, j - 1)
        same = lambda other: F.coalesce(other["key"] == r["key"], F.lit(False))
        hit = ((r["side"] == 0) & same(nxt) & (nxt["side"] == 1) & ~same(after) & ~same(prev))
        return F.when(hit, F.struct(r["pos"].alias("b"), nxt["pos"].alias("a")))
    return F.sort_array(F.filter(F.transform(merged, look), lambda r: r.isNotNull()))


def complete_by_id(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides, hash-partitioned by id: the one shuffle of the texts.

    The partitions follow the bytes of the texts, and all windows and groupings up to the script
    lie inside them: what a task holds does not grow with the table.  A second use in the same
    job of pairs stored already (``session.store_texts``) reads the same exchange.
    """
    complete = (pairs.select("pair_id", "before", "after")
                .where(F.col("before").isNotNull() & F.col("after").isNotNull()))
    return dealt_by_id(complete, "pair_id", "before")


def anchored_pairs(pairs: DataFrame, key: str = "exact", drop_blank: bool = False) -> DataFrame:
    """(pair_id, bl, al, anchors, moved): both line arrays, the kept anchors in
    order, and the anchors given up because their order changed."""
    lined = (complete_by_id(pairs)
             .select("pair_id", _side(F.col("before"), key, drop_blank, 0).alias("bl"),
                     _side(F.col("after"), key, drop_blank, 1).alias("al")))
    found = lined.withColumn("cand", let(F.sort_array(F.concat("bl", "al")), _anchors))
    a = F.col("cand.a")
    crossing = F.exists(
        F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.coalesce(y < x, F.lit(False))),
        lambda x: x)
    every = F.sequence(F.lit(0), F.size("cand") - 1)
    found = found.withColumn("_in", F.when(crossing, let(a, longest_increasing)))
    pick = lambda at: let(F.col("cand"), lambda cand: F.transform(at, lambda i: F.get(cand, i)))
    kept = F.when(F.col("_in").isNull(), F.col("cand")).otherwise(pick(F.col("_in")))
    moved = F.when(F.col("_in").isNull(), F.slice("cand", 1, 0)).otherwise(
        pick(F.array_except(every, "_in")))
    return found.select("pair_id", "bl", "al", kept.alias("anchors"), moved.alias("moved"))


def _segment_rows(starts: Column) -> Column:
    """All lines of a pair as (seg, fixed, bpos, apos, key, line, moved).

    Segment i runs from anchor i (a fixed row) to anchor i + 1; segment 0 opens
    at the head of both texts.
    """
    bl, al = F.col("bl"), F.col("al")
    none = F.lit(None).cast("int")

    def row(seg, fixed, bpos, apos, r, was_moved):
        return F.struct(seg.alias("seg"), F.lit(fixed).alias("fixed"), bpos.alias("bpos"),
                        apos.alias("apos"), r["key"].alias("key"), r["line"].alias("line"),
                        was_moved.alias("moved"))

    def segment(s, i, moved):
        e = F.get(starts, i + 1)
        end_b = F.coalesce(e["b"], F.size(bl))
        end_a = F.coalesce(e["a"], F.size(al))
        opening = F.when(s["b"] >= 0, F.array(
            row(i, True, s["b"], s["a"], F.get(bl, s["b"]), F.lit(False)))).otherwise(F.array())
        out = F.transform(F.slice(bl, s["b"] + 2, end_b - s["b"] - 1), lambda r: row(
            i, False, r["pos"], none, r, F.coalesce(F.get(moved["b"], r["pos"]) > 0, F.lit(False))))
        new = F.transform(F.slice(al, s["a"] + 2, end_a - s["a"] - 1), lambda r: row(
            i, False, none, r["pos"], r, F.coalesce(F.get(moved["a"], r["pos"]) > 0, F.lit(False))))
        return F.concat(opening, out, new)

    any_moved = F.size("moved") > 0
    moved = F.struct(F.when(any_moved, places(F.size(bl), F.col("moved.b"))).alias("b"),
                     F.when(any_moved, places(F.size(al), F.col("moved.a"))).alias("a"))
    return let(moved, lambda m: F.flatten(
        F.transform(starts, lambda s, i: segment(s, i, m))))


def line_diff(pairs: DataFrame, key: str = "exact", drop_blank: bool = False, heads: bool = False) -> DataFrame:
    """(pair_id, bpos, apos, op, line, moved) with op K (kept), D or I.

    ``key`` says when two lines are equal: ``exact`` (rebuilds ``after`` byte for
    byte) or ``strip`` (white-space edits count as kept).  K carries both
    positions and the line of the before side.  ``moved`` marks D and I rows of a
    line that is on both sides in another order.  With ``heads`` every complete pair has
    a row of op H before all its lines too, so that a pair without an edit is not lost.
    """
    head = F.array(F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("a")))
    lines = let(F.concat(head, "anchors"), _segment_rows)
    if heads:
        text = F.lit(None).cast("string")
        lines = F.concat(F.array(F.struct(
            F.lit(-1).alias("seg"), F.lit(True).alias("fixed"), F.lit(-1).alias("bpos"), F.lit(-1).alias("apos"),
            text.alias("key"), text.alias("line"), F.lit(False).alias("moved"))), lines)
    rows = (anchored_pairs(pairs, key, drop_blank)
            .select("pair_id", F.explode(lines).alias("r"))
            .select("pair_id", "r.*"))

    copy = Window.partitionBy("pair_id", "seg", "key", "fixed", F.col("bpos").isNull()) \
        .orderBy("bpos", "apos")
    rows = rows.withColumn("occ", F.row_number().over(copy))
    on_b = F.col("bpos").isNotNull()
    texts = [] if key == "exact" else [
        F.max(F.when(on_b, F.col("line"))).alias("bline"),
        F.max(F.when(~on_b, F.col("line"))).alias("aline")]
    met = (rows.groupBy("pair_id", "seg", "key", "fixed", "occ")
           .agg(F.max("bpos").alias("bpos"), F.max("apos").alias("apos"),
                F.max("moved").alias("moved"), *texts))
    if key == "exact":
        met = met.withColumns({"bline": F.col("key"), "aline": F.col("key")})

    both = F.col("bpos").isNotNull() & F.col("apos").isNotNull()
    earlier = (Window.partitionBy("pair_id", "seg").orderBy("bpos")
               .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.max(F.when(both & ~F.col("fixed"), F.col("apos"))).over(earlier)
    in_order = F.col("fixed") | reach.isNull() | (F.col("apos") > reach)

    def row(op, bpos, apos, line, moved):
        return F.struct(bpos.alias("bpos"), apos.alias("apos"), F.lit(op).alias("op"),
                        line.alias("line"), moved.alias("moved"))

    none, bpos, apos = F.lit(None).cast("int"), F.col("bpos"), F.col("apos")
    gone = lambda moved: row("D", bpos, none, F.col("bline"), moved)
    new = lambda moved: row("I", none, apos, F.col("aline"), moved)
    keep = F.when(bpos < 0, "H").otherwise("K") if heads else "K"
    out = (F.when(both & F.col("in_order"),
                  F.array(row(keep, bpos, apos, F.col("bline"), F.lit(False))))
           .when(both, F.array(gone(F.lit(True)), new(F.lit(True))))
           .when(apos.isNull(), F.array(gone(F.col("moved"))))
           .otherwise(F.array(new(F.col("moved")))))
    return (met.withColumn("in_order", in_order)
            .select("pair_id", F.inline(out)))


def line_moves(diff: DataFrame) -> DataFrame:
    """Lines kept in content but not in order: a delete and an insert each."""
    return diff.where("moved").select("pair_id", "bpos", "apos", "op", "line")


def with_gaps(diff: DataFrame) -> DataFrame:
    """Add ``gap`` (kept lines before the row) and, for inserts, ``anchor``: the
    nearest preceding kept line, NULL at the head of the text."""
    kept = F.col("op") == "K"
    by_b = Window.partitionBy("pair_id").orderBy("bpos").rowsBetween(Window.unboundedPreceding, 0)
    by_a = Window.partitionBy("pair_id").orderBy("apos").rowsBetween(Window.unboundedPreceding, 0)
    inserted = F.col("op") == "I"
    return (diff
            .withColumn("_gap_b", F.count(F.when(kept, 1)).over(by_b))
            .withColumn("_gap_a", F.count(F.when(kept, 1)).over(by_a))
            .withColumn("_last", F.last(F.when(kept, F.col("line")), ignorenulls=True).over(by_a))
            .select("pair_id", "bpos", "apos", "op", "line", "moved",
                    F.when(inserted, F.col("_gap_a")).otherwise(F.col("_gap_b")).cast("int").alias("gap"),
                    F.when(inserted, F.col("_last")).alias("anchor")))


def insert_anchors(diff: DataFrame) -> DataFrame:
    return with_gaps(diff).where(F.col("op") == "I").select("pair_id", "apos", "line", "anchor")


def hunks(diff: DataFrame) -> DataFrame:
    """One row per run of deletes and inserts between two kept lines.

    A diff with heads has a row for gap 0 of every pair, with empty lists if nothing is there.
    """
    part = lambda op, pos: F.sort_array(F.collect_list(
        F.when(F.col("op") == op, F.struct(F.col(pos).alias("pos"), F.col("line").alias("line")))))
    return (with_gaps(diff).where(F.col("op") != "K")
            .groupBy("pair_id", "gap")
            .agg(part("D", "bpos").alias("deletes"), part("I", "apos").alias("inserts"),
                 F.max("anchor").alias("anchor")))


def hunk_edits(hunk: DataFrame, heads: bool = False) -> DataFrame:
    """(pair_id, gap, idx, kind, key, value): the edits of each hunk.

    The inserts replace the last delete of the run; earlier deletes are removed.
    Without a delete every insert goes behind the anchor on its own.  With ``heads`` a
    run without lines gives a row with a null edit.
    """
    d, i = F.col("deletes"), F.col("inserts")
    last = F.size(d) - 1
    nothing = F.array().cast("array<string>")

    def edit(idx, kind, key, value):
        return F.struct(idx.alias("idx"), kind.alias("kind"), key.alias("key"), value.alias("value"))

    def deleted(x, j):
        taken = (j == last) & (F.size(i) > 0)
        return edit(j, F.when(taken, "replace").otherwise("remove"), x["line"],
                    F.when(taken, i["line"]).otherwise(nothing))

    inserted = F.transform(i, lambda x, j: edit(
        j, F.lit("insert"), F.col("anchor"), F.array(x["line"])))
    rows = F.inline_outer if heads else F.inline
    return hunk.select("pair_id", "gap", rows(
        F.when(F.size(d) > 0, F.transform(d, deleted)).otherwise(inserted)))


def drop_noop_edits(edits: DataFrame) -> DataFrame:
    """Remove replacements by one line that differs in outer white space only."""
    noop = ((F.col("kind") == "replace") & (F.size("value") == 1)
            & (X.strip(F.get("value", F.lit(0))) == X.strip(F.col("key"))))
    return edits.where(F.col("kind").isNull() | ~noop)


def edits_of(pairs: DataFrame, key: str = "strip", drop_blank: bool = True) -> DataFrame:
    return drop_noop_edits(hunk_edits(hunks(line_diff(pairs, key, drop_blank))))


def edit_script(edits: DataFrame) -> DataFrame:
    """(pair_id, script): the edits of a pair in text order, for pairs that have any row; a
    null edit is none."""
    ordered = F.sort_array(F.collect_list(F.when(
        F.col("kind").isNotNull(), F.struct("gap", "idx", "kind", "key", "value"))))
    return (edits.groupBy("pair_id").agg(ordered.alias("_s"))
            .select("pair_id", F.transform("_s", lambda e, n: F.struct(
                (n + 1).alias("ord"), e["kind"].alias("kind"), e["key"].alias("key"),
                e["value"].alias("value"))).alias("script")))


def scripts_of(pairs: DataFrame, key: str = "strip", drop_blank: bool = True) -> DataFrame:
    """(pair_id, script) for every complete pair; the script of a pair without an edit is empty."""
    edits = hunk_edits(hunks(line_diff(pairs, key, drop_blank, heads=True)), heads=True)
    return edit_script(drop_noop_edits(edits))


def location_lines(script: Column) -> Column:
    """Replaced and removed lines, in wire form (each behind one pad blank)."""
    touched = F.filter(script, lambda e: e["kind"] != "insert")
    return F.transform(touched, lambda e: F.concat(F.lit(S.LINE_PAD), e["key"]))


def new_lines(script: Column) -> Column:
    """Replacing and inserted lines in wire form; inserts carry no pad."""
    pad = lambda e: F.when(e["kind"] == "insert", "").otherwise(S.LINE_PAD)
    return F.flatten(F.transform(script, lambda e: F.transform(
        e["value"], lambda v: F.concat(pad(e), v))))


def _as_letters(words: Column, known: Column) -> Column:
    """A text with one letter per word: equal words, equal letters."""
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, letter), "")


def words_changed(old: Column, new: Column) -> Column:
    """Fewest words to replace, delete or insert between two arrays of words.

    The edit distance of the JVM, over texts in which each word is one letter.  What both
    sides begin and end with is left out first, so a long line with a small change is cheap.
    """
    def common(a, b):
        """Number of equal words at the front."""
        same = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")

    def inside(x, front, back):
        return F.slice(x, front + 1, F.greatest(F.size(x) - front - back, F.lit(0)))

    def middle(front):
        rest_old, rest_new = (F.reverse(F.slice(x, front + 1, F.size(x))) for x in (old, new))
        return let(common(rest_old, rest_new), lambda back: let(
            F.struct(inside(old, front, back).alias("a"), inside(new, front, back).alias("b")), lambda x: let(
                F.array_distinct(F.concat(x["a"], x["b"])),
                lambda known: F.levenshtein(_as_letters(x["a"], known), _as_letters(x["b"], known)))))

    return let(common(old, new), middle)


def changed_words(script: Column) -> Column:
    """Words that an edit script changes: those of removed and inserted lines, and the edit
    distance in words between a replaced line and the lines in its place."""
    def one(e):
        old = F.when(e["kind"] == "insert", F.array().cast("array<string>")).otherwise(X.words(e["key"]))
        new = F.flatten(F.transform(e["value"], X.words))
        return (F.when(e["kind"] == "replace", words_changed(old, new))
                .otherwise(F.size(old) + F.size(new)).cast("long"))
    return F.aggregate(F.transform(script, one), F.lit(0).cast("long"), lambda total, n: total + n)


def location_targets(scripts: DataFrame, max_lines: int | None = S.MAX_EDIT_LINES) -> DataFrame:
    """(pair_id, lines_with_vul, lines_after_fix); both NULL for oversize pairs."""
    gone, new = location_lines(F.col("script")), new_lines(F.col("script"))
    fits = F.lit(True) if max_lines is None else (
        (F.size(gone) < max_lines) & (F.size(new) < max_lines))
    return scripts.select(
        "pair_id", F.when(fits, F.array_join(new, "\n")).alias("lines_with_vul"),
        F.when(fits, F.array_join(gone, "\n")).alias("lines_after_fix"))


def injection_records(pairs: DataFrame, scripts: DataFrame) -> DataFrame:
    """(pair_id, before, after, inputs, outputs) for every complete pair, also for
    those without an edit."""
    locations = F.array_join(location_lines(F.col("script")), "\n")
    encoded = F.transform("script", lambda e: wire.encode_edit(e["kind"], e["key"], e["value"]))
    return (complete_by_id(pairs).join(scripts, "pair_id", "left")
            .select("pair_id", "before", "after",
                    F.concat("before", F.lit(S.END_OF_FUNCTION), F.when(
                        F.coalesce(locations, F.lit("")) == "", F.lit(S.NO_LOCATIONS))
                        .otherwise(locations)).alias("inputs"),
                    F.coalesce(F.array_join(encoded, "\n"), F.lit("")).alias("outputs")))


def edit_stats(scripts: DataFrame, max_lines: int = S.MAX_EDIT_LINES) -> DataFrame:
    """Oversize pairs, pairs kept and lines changed over the whole table."""
    gone, new = F.size(location_lines(F.col("script"))), F.size(new_lines(F.col("script")))
    fits = (gone < max_lines) & (new < max_lines)
    return (scripts.select(gone.alias("gone"), new.alias("new"), fits.alias("fits"))
            .agg(F.count("*").alias("pairs"), F.count_if(~F.col("fits")).alias("oversize"),
                 F.count_if("fits").alias("kept"), F.sum("gone").alias("lines_gone"),
                 F.sum("new").alias("lines_new")))


def contiguous_locations(pairs: DataFrame, locations: str = "locations") -> DataFrame:
    """(pair_id, contiguous): do the location lines stand as one block from the first?

    Reaching the function end is a yes; without locations, or if the first is not
    found, the answer is NULL."""
    keys = lambda c: F.transform(X.lines(F.col(c)), X.strip)
    start = F.array_position("_f", F.get("_l", F.lit(0))).cast("int")
    n = F.least(F.size("_l"), F.size("_f") - F.col("_at") + 1)
    block = F.slice("_f", F.col("_at"), n) == F.slice("_l", F.lit(1), n)
    return (pairs.select("pair_id", keys("before").alias("_f"), keys(locations).alias("_l"))
            .withColumn("_at", start)
            .select("pair_id", F.when(F.col("_at") > 0, block).alias("contiguous")))
