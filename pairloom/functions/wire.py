"""Wire format of edit scripts: sentinel escaping, encoding, prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom import schema as S

# A sentinel that occurs in source text gets one more backslash; decoding takes
# one away, so every text survives the round trip.
_ESCAPES = (
    (r"<(\\*)(s|endRow)>", r"<\\$1$2>", r"<\\(\\*)(s|endRow)>", r"<$1$2>"),
    (r"(\\*)EmptyLine", r"\\$1EmptyLine", r"\\(\\*)EmptyLine", r"$1EmptyLine"),
)


def escape(c: Column) -> Column:
    for find, put, _, _ in _ESCAPES:
        c = F.regexp_replace(c, find, put)
    return c


def unescape(c: Column) -> Column:
    for _, _, find, put in _ESCAPES:
        c = F.regexp_replace(c, find, put)
    return c


def encode_edit(kind: Column, key: Column, value: Column) -> Column:
    """One output line per edit; ``value`` is the array of new lines."""
    padded = F.array_join(
        F.transform(value, lambda v: F.concat(F.lit(S.LINE_PAD), escape(v))), S.LINE_JOIN)
    inserted = F.concat(
        F.lit(S.INSERT_TAG), escape(F.coalesce(key, F.lit(""))), F.lit(S.ANCHOR_END),
        escape(F.get(value, F.lit(0))))
    return (F.when(kind == "insert", inserted)
            .when(kind == "remove", F.lit(S.REMOVED_LINE))
            .otherwise(padded))


def decode_change(c: Column) -> Column:
    """Text that takes the place of a location line."""
    plain = F.replace(c, F.lit(S.LINE_JOIN), F.lit("\n"))
    gone = F.regexp_replace(plain, r"(?<!\\)EmptyLine", "")
    return unescape(gone)


def prompt(function: Column, answer: Column, eos: str = "") -> Column:
    return F.concat(F.lit(S.PROMPT_HEAD), function, F.lit("\n" + S.PROMPT_RESPONSE),
                    answer, F.lit(eos))


def prompt_cut(text: Column) -> Column:
    """Position right behind the first response marker; 0 if there is none."""
    at = F.locate(S.PROMPT_RESPONSE, text)
    return F.when(at > 0, at + len(S.PROMPT_RESPONSE)).otherwise(F.lit(0))
