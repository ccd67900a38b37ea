"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down the tree domain - language - source.  At every node the children
share it by weight; a child that has less than its share gives all it has, and what it lacks
goes to its siblings by weight.  Only what a whole subtree lacks reaches the siblings of its
parent, because every node's supply is the sum of its leaves'.  Each leaf then reads its
documents in seeded order, epoch after epoch, up to its budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.tables import size_checked
from pairloom.session import durable

LEVELS = ("domain", "lang", "source")
#: A leaf's documents are spread over 16 ** SLICE_DIGITS slices of the seeded order, and the slice
#: on the cut again, until it holds about SLICE_ROWS rows, which one task puts in order.
SLICE_DIGITS, SLICE_ROWS = 3, 1 << 16
#: Equal rows are written this many at a time.
COPIES = 4096
#: Label of a null domain, language or source.
NONE = "(none)"


def word_count(text: Column) -> Column:
    """Words between ASCII white space in a whole text; 0 for a null or blank one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def share_out(children: DataFrame, parents: Sequence[str], child: str, budget: str, supply: str,
              weight: str, name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children into column ``name``.

    In order of supply / weight, the children up to a point give all they have; the others
    share the rest by weight.  A child gives all if, at its own level of supply per weight,
    the parent's children together still stay within the budget.  Whole tokens, rounded
    down; a child without weight gets nothing.
    """
    within = Window.partitionBy(*parents)
    order = within.orderBy(F.col("_ratio").asc_nulls_last(), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = (children.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(supply) / F.col(weight)))
            .withColumn("_given", F.coalesce(F.sum(supply).over(before), F.lit(0)))
            .withColumn("_open", F.sum(weight).over(onward)))
    all_ = (F.col(weight) > 0) & (F.col("_given") * F.col(weight) + F.col(supply) * F.col("_open")
                                  <= F.col(budget) * F.col(weight))
    sums = sums.withColumn("_all", all_)
    rest = F.col(budget) - F.sum(F.when(F.col("_all"), F.col(supply)).otherwise(0)).over(within)
    left = F.sum(F.when(F.col("_all"), 0).otherwise(F.col(weight))).over(within)
    sums = sums.withColumn("_rest", rest).withColumn("_left", left)
    share = (F.when(F.col("_all"), F.col(supply))
             .when(F.col(weight) > 0, F.expr(f"(_rest * {weight}) div _left")).otherwise(F.lit(0)).cast("long"))
    return sums.withColumn(name, share).drop("_ratio", "_given", "_open", "_all", "_rest", "_left")


def leaf_budgets(leaves: DataFrame, total: Column, epochs: int, weights: Sequence[Column]) -> DataFrame:
    """Token budget of every leaf: the leaf's columns, tokens, and budget.

    ``leaves`` has domain, lang, source and tokens; ``total`` is written over ``corpus``, the
    tokens of all leaves.  ``weights`` are whole numbers up to 10,000 over the level columns,
    so that products of tokens and weights fit a long up to 10^14 tokens.
    """
    tree = leaves.withColumn("supply", (F.col("tokens") * epochs).cast("long"))
    for depth, weight in enumerate(weights):
        tree = tree.withColumn(f"_w{depth}", weight.cast("long"))
    level = (tree.groupBy("domain").agg(F.sum("supply").alias("s"), F.sum("tokens").alias("t"),
                                        F.max("_w0").alias("w")))
    whole = Window.partitionBy(F.lit(0))
    level = level.withColumn("corpus", F.sum("t").over(whole)).withColumn("b", total.cast("long")).withColumn("_root", F.lit(0))
    given = share_out(level, ["_root"], "domain", "b", "s", "w", "_b0").select("domain", "_b0")
    for depth in (1, 2):
        keys = list(LEVELS[:depth + 1])
        level = tree.groupBy(*keys).agg(F.sum("supply").alias("s"), F.max(f"_w{depth}").alias("w"),
                                        F.sum("tokens").alias("tokens"))
        given = share_out(level.join(given, list(LEVELS[:depth])), LEVELS[:depth], LEVELS[depth],
                          f"_b{depth - 1}", "s", "w", f"_b{depth}").select(*keys, "tokens", f"_b{depth}")
        if depth == 1:
            given = given.drop("tokens")
    return given.withColumnRenamed("_b2", "budget")


def mix(docs: DataFrame, domain: Column, total: Column, weights: Sequence[Column], epochs: int = 1,
        seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """How often every document is taken to meet the weights.

    Columns: doc_id, domain, lang, source, tokens, copies (0: left out), text_key (64-bit
    hash of the text).  ``domain`` and ``weights`` are columns over the table's own (weights:
    over domain, lang and source); ``epochs`` is how often a leaf may be read at most.

    A leaf takes whole epochs first.  In the last one it takes the documents whose running
    total in the seeded order of that epoch stays within what is left.  The running total
    goes over slices of the order first, then over slices of the slice where the leaf's budget
    ends, and row by row only inside a slice of about SLICE_ROWS rows, so no task sees a whole
    leaf, however hot.  The order is that of a hash of id and text, so null or repeated ids
    spread too; rows equal in both are counted first and stand side by side.

    Null levels count as "(none)"; null and blank texts have 0 tokens; each of several equal
    rows has a result of its own.  An empty table gives an empty one.  Very long texts are
    counted whole; only their hash and count go on.  Other columns are not read.
    """
    label = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    rows = durable(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), label(domain).alias("domain"),
        label(F.col("lang")).alias("lang"), label(F.col("source")).alias("source"),
        word_count(F.col(text)).alias("tokens"), F.xxhash64(text).alias("text_key")))
    leaf = list(LEVELS)
    leaves = size_checked(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    most = leaves.agg(F.max("rows")).first()[0] or 0
    plan = leaf_budgets(leaves, total, epochs, weights)
    plan = size_checked(plan.select(
        *leaf, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int").alias("_full"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("_part")))

    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("_full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.col("text_key")))
    placed = rows.join(plan, leaf).withColumn("_place", place)
    digits = SLICE_DIGITS
    cut = _cuts(placed.withColumn("_before", F.lit(0).cast("long")), leaf, digits)
    while most > SLICE_ROWS * 16 ** digits:
        inside = placed.join(cut, leaf).where(F.substring("_place", 1, digits) == F.col("_cut"))
        digits += SLICE_DIGITS
        cut = _cuts(inside, leaf, digits)
    placed = placed.withColumn("_slice", F.substring("_place", 1, digits)).join(cut, leaf, "left")

    on_cut = F.col("_slice").eqNullSafe(F.col("_cut"))
    clear = placed.where(~on_cut).withColumn(
        "_taken", (F.col("_part") > 0) & (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut"))))
    return clear.unionByName(_on_cut(placed.where(on_cut), leaf), allowMissingColumns=True).select(
        "doc_id", *leaf, "tokens", (F.col("_full") + F.col("_taken").cast("int")).alias("copies"), "text_key")


def _cuts(placed: DataFrame, leaf: Sequence[str], digits: int) -> DataFrame:
    """The slice of every leaf in which its budget ends (``_cut``), and the tokens before it."""
    slices = (placed.groupBy(*leaf, F.substring("_place", 1, digits).alias("_slice"), "_part", "_before")
              .agg(F.sum("tokens").alias("_sum")))
    upto = Window.partitionBy(*leaf).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return size_checked(
        slices.withColumn("_upto", F.col("_before") + F.sum("_sum").over(upto)).where("_upto > _part").groupBy(*leaf)
        .agg(F.min("_slice").alias("_cut"), F.min(F.col("_upto") - F.col("_sum")).alias("_before")))


def _on_cut(edge: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """Rows of the slices on the cut, with ``_taken``; equal rows are one row until they are written."""
    own = [*leaf, "doc_id", "tokens", "text_key", "_place", "_full", "_part", "_before"]
    upto = Window.partitionBy(*leaf).orderBy("_place", "tokens", "text_key", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.col("tokens") * F.col("_n")
    room = F.col("_part") - F.col("_before") - F.sum(size).over(upto) + size
    fit = F.when((F.col("_part") <= 0) | (F.col("_room") < 0), 0).when(F.col("tokens") == 0, F.col("_n")).otherwise(
        F.least(F.col("_n"), F.expr("_room div tokens")))
    counted = edge.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_room", room).withColumn("_fit", fit)
    return (counted.withColumn("_block", F.expr(f"explode(sequence(0L, (_n - 1) div {COPIES}))"))
            .withColumn("_i", F.expr(f"explode(sequence(_block * {COPIES} + 1, least(_n, (_block + 1) * {COPIES})))"))
            .withColumn("_taken", F.col("_i") <= F.col("_fit")).drop("_n", "_room", "_fit", "_block", "_i"))
