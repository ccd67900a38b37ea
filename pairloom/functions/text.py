"""Column functions over whole texts.  All run row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One explicit white-space class, so that no engine-specific \s is involved.
WS = " \t\n\x0b\f\r"
WS_CLASS = r"[ \t\n\x0B\f\r]"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"
#: Tokens of C: comments and literals whole, then names, numbers, operators of several
#: characters ("->" is two tokens, as in the published tables) and single marks.
C_TOKEN = (
    r"""//[^\n]*|(?s:/\*.*?\*/)|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"""
    r"""|[A-Za-z_][A-Za-z0-9_]*|[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*"""
    r"""|\.\.\.|\+\+|--|<<=|>>=|<<|>>|&&|\|\||[-+*/%&|^!=<>]=|##|[^ \t\n\x0B\f\r]""")
#: C_TOKEN for Python, where "." leaves out fewer line ends.
C_TOKEN_PY = C_TOKEN.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]")
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def normalise_newlines(c: Column) -> Column:
    """Drop the carriage return of each line end; done once at ingest."""
    return F.regexp_replace(c, "\r(?=\n|\\z)", "")


def fold_braces(c: Column) -> Column:
    """Append lines that hold only a brace to the line before them."""
    return F.regexp_replace(c, r"\n[^\S\n]*([{}])[^\S\n]*(?=\n|\z)", " $1")


def collapse_indent(c: Column) -> Column:
    """Strip the text, then remove white space after every line break."""
    return F.regexp_replace(strip(c), "\n" + WS_CLASS + "*", "\n")


def canonical_text(c: Column) -> Column:
    """Left-strip every line and drop the empty ones."""
    head = F.regexp_replace(c, "(^|\n)" + WS_CLASS + "+", "$1")
    return F.regexp_replace(head, "\n\\z", "")


def strip_number_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"_[0-9]{1,3}\z", "")


def fingerprint(a: Column, b: Column, sep: str = "") -> Column:
    """SHA-256 of two texts without blanks, tabs and line ends.

    The default joins without a separator, as the published data sets do; pass
    ``sep`` to keep ("ab", "c") apart from ("a", "bc").
    """
    squeeze = lambda c: F.translate(c, " \n\r\t", "")
    return F.sha2(F.concat(squeeze(a), F.lit(sep), squeeze(b)), 256)


def fingerprint_raw(a: Column, b: Column, sep: str = "") -> Column:
    return F.sha2(F.concat(a, F.lit(sep), b), 256)


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    """Runs of non-white-space characters."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, WS_CLASS + "+"))


def cwe_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"CWE-[0-9]+"), F.lit(0))
