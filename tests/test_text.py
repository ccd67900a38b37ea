import hashlib

import pytest

from pairloom.functions import text as X
from pairloom.functions import wire
from pairloom.operators import lines as L


@pytest.mark.parametrize("text,want", [
    ("int f()\n{\n  return 0;\n}", "int f() {\n  return 0; }"),
    ("{\na", "{\na"),                       # line 0 stays
    ("a\n{\n}\n{", "a { } {"),              # runs chain
    ("a\n  } \t\nb", "a }\nb"),
    ("a\n{}\nb", "a\n{}\nb"),
    ("", ""),
])
def test_fold_braces(column, text, want):
    assert column(X.fold_braces, text) == want


@pytest.mark.parametrize("text,want", [
    ("  a\n\n\t b \n   \nc\n", "a\nb \nc"),
    ("\n\n", ""), ("", ""), ("a", "a"), ("a\n  ", "a"),
])
def test_canonical_text(column, text, want):
    assert column(X.canonical_text, text) == want
    assert want == "\n".join(l for l in (x.lstrip() for x in text.split("\n")) if l)


def test_collapse_indent(column):
    assert column(X.collapse_indent, "  a\n   b\n\n  c  \n") == "a\nb\nc"


def test_strip_number_suffix(column):
    assert column(X.strip_number_suffix, "f_12") == "f"
    assert column(X.strip_number_suffix, "f_1234") == "f_1234"
    assert column(X.strip_number_suffix, "f_1_2") == "f_1"


def test_fingerprint(column):
    a, b = "x \n\t y", "z\r"
    assert column(X.fingerprint, a, b) == hashlib.sha256(b"xyz").hexdigest()
    assert column(X.fingerprint_raw, a, b) == hashlib.sha256((a + b).encode()).hexdigest()
    assert column(X.fingerprint, "ab", "c") == column(X.fingerprint, "a", "bc")
    sep = lambda p, q: X.fingerprint(p, q, sep="|")
    assert column(sep, "ab", "c") != column(sep, "a", "bc")


def test_newlines_are_normalised(column):
    assert column(X.normalise_newlines, "a\r\nb\rc\r") == "a\nb\rc"


def test_cwe_ids(column):
    assert column(X.cwe_ids, "p_CWE-119_CWE-20 CWE-x") == ["CWE-119", "CWE-20"]


@pytest.mark.parametrize("text", [
    "a <s> b", "EmptyLine", "x<endRow>y", r"a <\s> \EmptyLine <\\endRow>", "plain"])
def test_escaping_round_trip(column, text):
    assert column(wire.escape, text) != text or text == "plain"
    assert column(lambda c: wire.unescape(wire.escape(c)), text) == text
    assert column(lambda c: wire.decode_change(wire.escape(c)), text) == text


def test_decode_change(column):
    assert column(wire.decode_change, "a<s> b<s>EmptyLine") == "a\n b\n"


def uniquified(spark, text):
    df = spark.createDataFrame([(1, text)], "pair_id long, before string")
    return L.uniquify_lines(df, "before").first()["before"]


def test_uniquify_lines(spark):
    assert uniquified(spark, "a\nb\na\n  a\n\n\nb") == "a\nb\na \n  a  \n\n \nb "
    text = uniquified(spark, "\n".join(["x"] * 20))
    assert text.split("\n") == ["x" + " " * n for n in range(20)]


def test_normalise_identifiers(spark):
    code = "static int go(int a) {\n b = a + go(b);\n c->a = f2 (a);\n}"
    df = spark.createDataFrame([(1, code), (2, "z ( y")], "pair_id long, t string")
    got = {r.pair_id: " ".join(r.tokens) for r in L.normalise_identifiers(df, "t").collect()}
    assert got[1] == ("static int FUN1 ( int VAR1 ) { VAR2 = VAR1 + FUN1 ( VAR2 ) ; "
                      "VAR3 - > VAR1 = FUN2 ( VAR1 ) ; }")
    assert got[2] == "FUN1 ( VAR1"


def test_words_and_tokens(column):
    assert column(X.words, " a  b\n") == ["a", "b"]
    assert column(X.words, " \n") == []
    assert column(X.tokens, "a_1+b;") == ["a_1", "+", "b", ";"]


def lexed(column, code):
    return column(lambda c: X.tokens(c, X.C_TOKEN), code)


def test_c_tokens(column):
    assert lexed(column, 'a==b<=c') == ["a", "==", "b", "<=", "c"]
    assert lexed(column, 'f("x == \\"y\\" // no", \'"\', 1)') == ["f", "(", '"x == \\"y\\" // no"', ",", "\'\"\'", ",", "1", ")"]
    assert lexed(column, "a /* b == 'c\n\" */ d // e \"f\ng") == ["a", "/* b == 'c\n\" */", "d", '// e "f', "g"]
    assert lexed(column, "x>>=1.5e-3f;y--->z&&!w...") == ["x", ">>=", "1.5e-3f", ";", "y", "--", "-", ">", "z", "&&", "!", "w", "..."]
    assert lexed(column, 'it\'s "open\n/* open') == ["it", "'", "s", '"', "open", "/", "*", "open"]
    assert lexed(column, "") == []
    long = "x" * 300_000
    assert lexed(column, f'"{long}" /*{long}*/ {long}') == [f'"{long}"', f"/*{long}*/", long]


def test_literals_and_comments_keep_their_words(spark):
    df = spark.createDataFrame([(1, 'go(a); // go a\nputs("go a"); a == go;')], "pair_id long, t string")
    assert L.normalise_identifiers(df, "t").first().tokens == [
        "FUN1", "(", "VAR1", ")", ";", "// go a", "FUN2", "(", '"go a"', ")", ";", "VAR1", "==", "FUN1", ";"]


def test_published_tokenization_example(spark):
    """The example of the detector's tables; there a closing bracket sticks to the token before it
    and one type name keeps its spelling, here neither."""
    code = """static void v4l2_free_buffer(void *opaque, uint8_t *unused)
{
    V4L2Buffer* avbuf = opaque;
    V4L2m2mContext *s = buf_to_m2mctx(avbuf);
    if (atomic_fetch_sub(&avbuf->context_refcount, 1) == 1) {
        atomic_fetch_sub_explicit(&s->refcount, 1, memory_order_acq_rel);
        if (s->reinit) {
            if (!atomic_load(&s->refcount))
              sem_post(&s->refsync);
        } else if (avbuf->context->streamon)
            ff_v4l2_buffer_enqueue(avbuf);
        av_buffer_unref(&avbuf->context_ref);
    }
}
"""
    want = """static void FUN1 ( void * VAR1 , uint8_t * VAR2 ) { VAR3 * VAR4 = VAR1 ; VAR5 * VAR6 = FUN2 ( VAR4 ) ;
        if ( FUN3 ( & VAR4 - > VAR7 , 1 ) == 1 ) { FUN4 ( & VAR6 - > VAR8 , 1 , VAR9 ) ; if ( VAR6 - > VAR10 ) {
        if ( ! FUN5 ( & VAR6 - > VAR8 ) ) FUN6 ( & VAR6 - > VAR11 ) ; } else if ( VAR4 - > VAR12 - > VAR13 )
        FUN7 ( VAR4 ) ; FUN8 ( & VAR4 - > VAR14 ) ; } }"""
    df = spark.createDataFrame([(1, code)], "pair_id long, t string")
    assert L.normalise_identifiers(df, "t").first().tokens == want.split()
