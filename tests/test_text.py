import html
import html.entities

import pytest
from frames import column
from pyspark.sql import functions as F

from deskwise.functions import text as tx
from deskwise.functions import vectors as vx


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)


def test_clean_strict(spark):
    df = texts(
        spark,
        "@Élan_9 see https://a.b/c?d=1 and www.x.org/z now ^JS ",
        "mid ^JS text ^abcd",
        "&amp;lt; &lt;b&gt; &quot;hi&quot;",
        "line\\nbreak\\ttab nbsp \t\n end",
        None,
        "   ",
        "five ^ABCDE",
    )
    assert column(df, tx.clean_text("t")) == [
        "see and now",
        "mid ^JS text",
        '&lt; <b> "hi"',
        "line break tab nbsp end",
        "",
        "",
        "five ^ABCDE",
    ]


def test_clean_runtime_differs_in_url_and_signature_rules(spark):
    df = texts(spark, "www.x.org stays ^JS mid ^AB, ^ABCD ^ab", "http://x.y gone", "^JSé ^JS_")
    assert column(df, tx.clean_text("t", "runtime")) == [
        "www.x.org stays mid , ^ABCD ^ab",
        "gone",
        "^JSé ^JS_",
    ]


def test_cluster_normaliser(spark):
    df = texts(spark, "See HTTPS://X.Y/z and WWWhat ever  Done")
    assert column(df, tx.clean_for_clustering("t")) == ["see and ever done"]


def test_strip_is_unicode(spark):
    df = texts(spark, " \t a b  \n", "\x1fx\x85")
    assert column(df, tx.strip("t")) == ["a b", "x"]


def test_entities_column_mode_agrees_with_exact_mode(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    both = pages.select(tx.decode_entities("html").alias("a"), tx.decode_entities_exact("html").alias("b"), "html")
    got = both.collect()
    assert all(r["a"] == r["b"] == html.unescape(r["html"]) for r in got)


def test_every_entity_is_decoded_inside_the_jvm(spark):
    broken = ["&", "&&amp;", "&amp;lt;", "&notit;", "&amp", "&ampx", "&;", "&#;", "&#x;", "&nosuch;", "a&b=c&copy=1", "&CounterClockwiseContourIntegral;"]
    codes = [0, 1, 8, 9, 10, 13, 0x1F, 65, 0x7F, 0x80, 0x81, 0x92, 0x9F, 0xA0, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFF, 0x110000, 10**9, 10**30]
    numbers = [f"x&#{n}{end}y" for n in codes for end in (";", "")] + [f"x&#x000{n:x};y" for n in codes]
    names = ["".join(f"&{name}|" for name in html.entities.html5)]
    sent = broken + numbers + names
    df = spark.createDataFrame(list(enumerate([*sent, None])), "i int, t string").repartition(1)
    got = {r["i"]: r["d"] for r in df.select("i", tx.decode_entities("t").alias("d")).collect()}
    assert [got[i] for i in range(len(sent))] == [html.unescape(t) for t in sent]
    assert got[len(sent)] is None


def test_exact_entities_keep_null(spark):
    df = texts(spark, "&frac12;&#8364;", None)
    assert column(df, tx.decode_entities_exact("t")) == ["½€", None]


@pytest.mark.parametrize(
    "text,expected",
    [("Thank you!!", True), (" OK. ", True), ("ok then", False), ("got  it", False), ("né", False), ("t.h.x", True), ("thanks !", False)],
)
def test_acknowledgement(spark, text, expected):
    # The last case: the blank in front of the removed mark stays, so it is no exact match.
    assert column(texts(spark, text), tx.is_acknowledgement("t")) == [expected]


def test_contains_any_is_a_substring_test(spark):
    df = texts(spark, "An URGENT agenda", "humanity", "can’t log in", "can't log in", "x")
    terms = ["agen", "human", "can't log in"]
    assert column(df, tx.contains_any("t", terms)) == [True, True, False, True, False]
    assert column(df, tx.contains_any(tx.straight_quotes("t"), terms))[2] is True
    assert column(df, tx.contains_any("t", ["agen", "human"], whole_word=True)) == [False] * 5
    assert column(df, tx.contains_any("t", ["agenda", "x"], whole_word=True)) == [True, False, False, False, True]


def test_tokens_and_bigrams(spark):
    df = texts(spark, "The late parcel, a late_parcel!", "x", "")
    terms = tx.let(tx.tokens("t", ("the",)), tx.with_bigrams)
    assert column(df, terms) == [
        ["late", "parcel", "late_parcel", "late parcel", "parcel late_parcel"], [], [],
    ]


def test_language_share(spark):
    df = texts(spark, "the order is late and we are sad", "der die das und nicht", "123", "")
    assert column(df, F.round(tx.language_share("t"), 3)) == [1.0, 0.0, 0.0, 0.0]


def test_missing_tokens_and_numbers(spark):
    df = texts(spark, "", "NA", "null", "na", "5.0", "x", None)
    assert column(df, tx.na_to_null("t")) == [None, None, None, "na", "5.0", "x", None]
    assert column(df, tx.to_number("t")) == [None, None, None, None, 5.0, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").coalesce(1)
    assert column(df, vx.l2_normalize("v")) == [[0.6, 0.8], [0.0, 0.0]]
    assert column(df, vx.argmax("v")) == [1, 0]
    assert column(df, vx.softmax("v"))[1] == [0.5, 0.5]


def test_whitespace_is_pythons(spark):
    import re

    chars = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    df = texts(spark, *[f"{c}a{c}{c}b{c}" for c in chars])
    got = df.select("t", tx.squeeze_space("t").alias("q"), tx.strip("t").alias("s"), tx.strip_urls(F.concat(F.lit("http://"), "t")).alias("u")).collect()
    assert all(r["q"] == re.sub(r"\s+", " ", r["t"]).strip() for r in got)
    assert all(r["s"] == r["t"].strip() for r in got)
    assert all(r["u"] == re.sub(r"https?://\S+", " ", "http://" + r["t"]) for r in got)
    assert all((" " in r["q"]) == r["t"][0].isspace() for r in got)


def test_ampersands_that_begin_no_entity_are_left_alone(spark):
    odd = ["&", "&&", "& &amp;&", "&;&#;&#x;&#xg;&#38;&#x26;", "a&b&amp&ampx&notit;&&lt&&", "&é;&1;&_lt;", "&&amp;lt;", "&#\n1;& #38;"]
    got = column(texts(spark, *odd).orderBy("i"), tx.decode_entities("t"))
    assert got == [html.unescape(t) for t in odd]


def test_a_text_of_bare_ampersands_is_not_taken_apart(spark):
    df = texts(spark, "& " * 1000 + "&lt;")
    assert column(df, F.size(F.split("t", tx.AMPERSAND, -1)).alias("n")) == [2]
    assert tx.AMPERSAND in str(tx.decode_entities("t"))
    assert column(df, tx.decode_entities("t").alias("d")) == ["& " * 1000 + "<"]
