import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import canonical as C
from docloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "given,want",
    [("abc\0def", "abcdef"), ("alpha\x01 beta\x02", "alpha beta"), (" alpha\t\tbeta  \n\n\n gamma ", "alpha beta\n\ngamma"), (None, ""), ("", ""), ("  \n ", ""), ("a\r\nb", "a\nb"), ("a​b", "a b"), (" x ", "x")],
)
def test_sanitize(spark, given, want):
    assert one(spark, given, T.sanitize) == want


def test_normalize_and_links(spark):
    assert one(spark, "See ![pic](a.png) the [Guide](x.md), [Old] one!", T.normalize) == "see pic the guide old one"
    assert one(spark, None, T.normalize) == ""


def test_queries(spark):
    q = "How do I set up the PMS/POS interface for V5-Alpha and set up reports?"
    assert one(spark, q, T.query_terms) == ["set", "pms", "pos", "interface", "v5-alpha", "reports"]
    assert one(spark, q, T.context_terms) == ["i", "pms", "pos", "v5-alpha"] or one(spark, q, T.context_terms) == ["pms", "pos", "v5-alpha"]
    assert one(spark, "open the night audit", lambda c: T.query_phrases(T.query_terms(c))) == ["open night audit", "open night", "night audit"]
    assert one(spark, None, T.query_terms) == [] and one(spark, "", lambda c: T.query_phrases(T.query_terms(c))) == []


def test_line_kinds(spark):
    assert one(spark, "![x](y.gif)", T.is_image_line) and not one(spark, "text ![x](y.gif)", T.is_image_line)
    assert one(spark, "[Previous](a) | [Next](b)", T.is_navigation_line) and one(spark, "---", T.is_navigation_line) and not one(spark, "open the next account", lambda c: T.is_navigation_line(F.concat(c, F.lit(" and then close it again before leaving the room"))))
    assert one(spark, "Home > Reports > Daily", T.is_breadcrumb_line) and not one(spark, "no path here", T.is_breadcrumb_line)


def test_shingles_and_similarity(spark):
    assert one(spark, "a b c", T.shingles) == ["a", "b", "c"]
    assert one(spark, "a b c d e f", T.shingles) == ["a b c d e", "b c d e f"]
    assert one(spark, "", T.shingles) == []
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "c"]), (["a"], []), (["a", "b", "c", "d"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.set_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.25]


def test_near_duplicate_body(spark):
    text = "---\ntitle: X\n---\n[Home](a) > [Docs](b)\n![p](q.png)\nPrevious | Next\n1. Open the [Screen](s.md) at https://x.y/z now."
    assert one(spark, text, T.body_for_near_duplicates) == "1 open the screen at now"
    assert one(spark, text, T.context_lines) == "title: X [Home](a) > [Docs](b)"


def test_headings(spark):
    for yes in ("1.2 Setup", "NIGHT AUDIT", "Night Audit", "Über Uns"):
        assert one(spark, yes, T.looks_like_heading), yes
    for no in ("Night audit runs late", "Ends Here.", "", None, "lower case", "X" * 121, "A McDonald Farm"):
        assert not one(spark, no, T.looks_like_heading), no


def test_chunk_types(spark):
    for text, want in [("", "empty"), (None, "empty"), ("![a](b.png)", "navigation"), ("A > B > C", "navigation"), ("Contents", "navigation"), ("Click here " * 10, "procedure"), ("See also the other guide " * 5, "reference"), ("Plain words " * 9, "content")]:
        assert one(spark, text, T.chunk_type) == want


def test_uuid5(spark):
    ns = uuid.uuid4()
    for name in ("a.md:0", "файл.md:12", ""):
        assert one(spark, name, lambda c: T.uuid5(F.lit(str(ns)), c)) == str(uuid.uuid5(ns, name))


def test_truncate(spark):
    assert one(spark, "one  two three", lambda c: T.truncate_at_word(c, 9)) == "one two..."
    assert one(spark, "short", lambda c: T.truncate_at_word(c, 9)) == "short"


def test_canonical(spark):
    assert one(spark, "HTTPS://Help.X.example//a/b", C.site_of) == "help.x.example" and one(spark, ".\\Docs.x\\a", C.site_of) == "docs.x"
    assert one(spark, "/", C.site_of) is None and one(spark, None, C.site_of) is None
    assert one(spark, "SHA256=" + "AB" * 32, C.sha256_digits) == "ab" * 32 and one(spark, "ab" * 16, C.sha256_digits) is None


def test_values_of_any_depth(spark):
    df = spark.sql("SELECT named_struct('a', 'x\u0001 y ', 'b', array('p\u0000q', NULL), 'c', named_struct('n', 3, 'm', map('k', array(' v ')))) AS v UNION ALL SELECT NULL")
    kind = df.schema["v"].dataType
    rows = df.select(T.sanitize_value(F.col("v"), kind).alias("v"), T.flattened(F.col("v"), kind).alias("f")).collect()
    one = next(r for r in rows if r.v is not None)
    assert one.v.a == "x y" and one.v.b == ["pq", None] and one.v.c.n == 3 and one.v.c.m == {"k": ["v"]}
    assert one.f.split() == ["x\x01", "y", "p\x00q", "3", "v"] and next(r for r in rows if r.v is None).f is None
