from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import conditions as C
from weft.functions import dates as D
from weft.functions import strings as S


def values(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_strings(spark):
    got = values(
        spark, S.trim(F.lit("  \thello\n")), S.trim(F.lit("xxhixy"), "xy"), S.split(F.lit("a.b.c"), "."), S.split(F.lit("abc"), ""), S.substring(F.lit("hello world"), 0, 5),
        S.substring(F.lit("hello world"), -5, 0), S.substring(F.lit("abc"), 5, 9), S.substring(F.lit("äöü"), 1, 2), S.title_case(F.lit("hello wORLD foo-bar")), S.capitalize(F.lit("élan")),
        S.concatenate(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), separator="-"), S.join(F.array(F.lit("a"), F.lit("b")), "+"), S.length(F.lit("äb")), S.capitalize(F.lit("")),
    )
    assert got == ["hello", "hi", ["a", "b", "c"], ["abc"], "hello", "world", "", "ö", "Hello World Foo-Bar", "Élan", "a-b", "a+b", 2, ""]


def test_replace(spark):
    got = values(
        spark, S.replace(F.lit("aXbXc"), "X", "-"), S.replace(F.lit("aXbXc"), "X", "-", 1), S.replace(F.lit("abc"), "", "-"), S.replace(F.lit("abc"), "", "-", 2), S.replace(F.lit("aXb"), "X", "$1", 0),
        S.replace(F.lit("a1b22"), r"(\d+)", "<$1>", use_regex=True), S.replace(F.lit("a1b22"), r"\d+", "$1", 1, True), S.replace(F.lit("a1"), r"(?P<n>\d)", "${n}0$$", use_regex=True),
    )
    assert got == ["a-b-c", "a-bXc", "-a-b-c-", "-a-bc", "aXb", "a<1>b<22>", "a$1b22", "a10$"]


def test_patterns_are_checked_on_the_driver():
    for bad in ("[invalid", "(?=x)", r"(a)\1", "(?<!a)b"):
        with pytest.raises(ValueError):
            S.checked(bad)


def test_extract_encode_normalize(spark):
    got = values(
        spark, S.regex_extract(F.lit("hello123world456"), r"\d+"), S.regex_extract(F.lit("a1b2"), r"([a-z])(\d)"), S.regex_extract(F.lit("abc"), r"\d"), S.base64_encode(F.lit("x" * 90)), S.base64_decode(F.lit("aGk=")),
        S.base64_decode(F.lit("%%%")), S.uri_encode(F.lit("hello world*~ü")), S.uri_decode(F.lit("a+b%20c")), S.uri_decode(F.lit("%zz")), S.normalize(F.lit("Æßéñé")), S.format_text("${a} {b} {c}", {"a": F.lit(1), "b": F.lit("y")}),
    )
    assert got[:3] == [[["123"], ["456"]], [["a1", "a", "1"], ["b2", "b", "2"]], None]
    assert "\n" not in got[3] and got[4:] == ["hi", None, "hello+world%2A~%C3%BC", "a b c", None, "AEssene", "1 y {c}"]


@pytest.mark.parametrize(
    ("form", "text", "out", "want"),
    [
        ("ANSIC", "Mon Jan 15 10:30:00 2023", "DateOnly", "2023-01-15"), ("UnixDate", "Mon Jan 15 10:30:00 MST 2023", "RFC3339", "2023-01-15T10:30:00Z"),
        ("RubyDate", "Mon Jan 15 10:30:00 -0700 2023", "UTC", "2023-01-15T17:30:00Z"), ("RFC822", "15 Jan 23 10:30 MST", "DateOnly", "2023-01-15"), ("RFC822Z", "15 Jan 69 10:30 -0700", "DateOnly", "1969-01-15"),
        ("RFC850", "Monday, 15-Jan-23 10:30:00 MST", "RFC1123", "Sun, 15 Jan 2023 10:30:00 MST"), ("RFC3339Nano", "2023-01-15T10:30:00.123456789+02:00", "RFC3339Nano", "2023-01-15T10:30:00.123456+02:00"),
        ("Kitchen", "10:30AM", "TimeOnly", "10:30:00"), ("Stamp", "Jan  5 10:30:00", "TimeOnly", "10:30:00"), ("DateTime", "2023-01-15", "DateTime", "2023-01-15 00:00:00"),
        ("DateTime", "2023-01-15 10:30", "DateTime", "2023-01-15 10:30:00"), ("DateOnly", "20230115", "DateOnly", "2023-01-15"), ("CompactOffset", "20230115103000-0500", "RFC1123Z", "Sun, 15 Jan 2023 10:30:00 -0500"),
        ("Layout", "01/15 10:30:00AM '23 -0700", "DateOnly", "2023-01-15"), ("DateTime", "bad", "DateOnly", None), ("DateTime", "  ", "DateOnly", None),
    ],
)
def test_date_formats(spark, form, text, out, want):
    r = spark.createDataFrame([(text,)], "s string").select(D.reformat(F.col("s"), D.DateFormat(form, out)).alias("r")).first().r
    assert r.result == want
    assert (r.error is not None) == (text == "bad")


def test_date_zones_and_styles(spark):
    df = spark.createDataFrame([("2023-07-15 12:00:00",)], "s string")
    got = df.select(
        D.reformat(F.col("s"), D.DateFormat("DateTime", "RFC850", out_timezone="America/New_York"))["result"], D.reformat(F.col("s"), D.DateFormat("DateTime", "UTC", in_timezone="Europe/Berlin"))["result"],
        D.reformat(F.col("s"), D.DateFormat("DateTime", "DateTime", date_style="DD/MM/YYYY", time_style="12h-HM"))["result"],
    ).first()
    assert list(got) == ["Saturday, 15-Jul-23 08:00:00 EDT", "2023-07-15T10:00:00Z", "15/07/2023 12:00 PM"]
    for bad in (("x", "UTC"), ("DateTime", "UTC", "No/Zone"), ("DateTime", "Kitchen", "", "", "DD/MM/YYYY")):
        with pytest.raises(ValueError):
            D.DateFormat(*bad)


def test_conditions(spark):
    schema = "d double, s string, b boolean, xs array<int>, z struct<q: string>"
    df = spark.createDataFrame([(12345678.0, "5.0", True, [], ("v",)), (None, "", False, None, None)], schema)
    kind = df.schema
    node = lambda *c, logic="AND": C.node(kind, list(c), logic)
    rows = df.select(
        node(C.Condition("d", "equals", "12345678", "number")).alias("a"), node(C.Condition("s", "equals", "5", "string")).alias("b"), node(C.Condition("/z/q", "regex", "^v")).alias("c"),
        node(C.Condition("s", "is_empty")).alias("e"), node(C.Condition("xs", "is_empty")).alias("f"), node(C.Condition("nope", "equals", "x")).alias("g"), node(C.Condition("nope", "is_empty")).alias("h"),
        node(C.Condition("z.q", "greater_than", "3", "number")).alias("i"), node(C.Condition("b", "equals", "TRUE", "boolean"), C.Condition("s", "is_empty"), logic="OR").alias("j"), node().alias("k"),
    ).collect()
    one, two = rows
    assert [one.a.route, one.b.route, one.c.route, one.e.route, one.f.route, one.g.route, one.h.route, one.j.route, one.k.route] == [True, False, True, False, True, None, True, True, False]
    assert one.g.warning and one.i.error and one.i.route is None
    assert [two.a.route, two.e.route, two.f.route, two.j.route] == [False, True, True, True]
    with pytest.raises(ValueError):
        C.Condition("x", "contains", "y", "number")
    with pytest.raises(ValueError):
        C.Condition("x", "equals", "maybe", "boolean")


def test_canonical_numbers(spark):
    got = values(spark, *[C.canonical(F.lit(x), T.DoubleType()) for x in (12345678.0, 0.00001, 1e20, -2.5, 0.0)])
    assert got == ["12345678", "0.00001", "100000000000000000000", "-2.5", "0"]
