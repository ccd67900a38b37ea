"""Helpers for array expressions that stay near-linear in the array length."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Without the binding an expression that is referenced inside a lambda would be
    worked out again for every array element.
    """
    return F.transform(F.array(value), body)[0]


#: Values that an inner fold of ``fold_list`` takes.
BLOCK = 512


def fold_list(values: Column, start: Column, step, item: str) -> Column:
    """The list that a fold makes: ``step(state, value)`` gives the next state and an array of
    new entries of type ``item``.

    A fold copies all of its state at every step, so a list of n entries in it costs n squares.
    Here an inner fold takes BLOCK values at a time and hands its part on; only the outer fold,
    with one step a block, carries the whole list.
    """
    none = F.array().cast(f"array<{item}>")

    def inner(acc, x):
        state, new = step(acc["state"], x)
        out = F.when(F.size(new) > 0, F.concat(acc["out"], new)).otherwise(acc["out"])
        return F.struct(state.alias("state"), out.alias("out"))

    def blocks(bound):
        def outer(acc, block):
            part = F.slice(bound, block * BLOCK + 1, F.lit(BLOCK))
            done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
            return let(done, lambda r: F.struct(
                r["state"].alias("state"), F.concat(acc["full"], F.array(r["out"])).alias("full")))
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{item}>>").alias("full"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / BLOCK).cast("int"))
        return F.when(F.size(bound) > 0, F.aggregate(numbers, first, outer, lambda acc: F.flatten(acc["full"]))) \
            .when(F.size(bound) == 0, none)

    return let(values, blocks)


def places(size: Column, positions: Column) -> Column:
    """For 0 .. size-1: 1 + the index of that number in ``positions``, or 0.

    Sorts both sequences together and looks at the neighbour, where searching the
    array once per number would be quadratic.  ``positions`` are distinct.
    """
    slots = F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.struct(
        p.alias("p"), F.lit(1).alias("slot"), F.lit(0).alias("j")))
    given = F.transform(positions, lambda p, j: F.struct(
        p.alias("p"), F.lit(0).alias("slot"), (j + 1).alias("j")))

    def look(both):
        def one(x, k):
            prev = F.get(both, k - 1)
            hit = (x["slot"] == 1) & F.coalesce((prev["slot"] == 0) & (prev["p"] == x["p"]), F.lit(False))
            return F.when(hit, prev["j"]).when(x["slot"] == 1, F.lit(0))
        return F.filter(F.transform(both, one), lambda v: v.isNotNull())

    return F.when(size > 0, let(F.sort_array(F.concat(slots, given)), look))
