import html

from helpers import rows
from parcelwise.functions.entities import decoded_entities

TEXTS = [
    "plain", "", "&", "a & b", "&;", "&#;", "&#x;", "&#8201;", "&#8201", "&#x20AC;&#X20ac", "&#0065;B", "&#65B", "&#128;&#x99;",
    "&#0;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#129;", "&amp;lt;", "&lt;b&gt;", "&euro;", "&euro", "&eacute;t&eacute",
    "&notit;", "&not", "&nbsp12&nbsp;%", "&NotEqualTilde;", "&CounterClockwiseContourIntegral;", "&Unknown;", "&copy1", "x&&amp;&",
    "&#x1F69A;", "&frac34;", "tom &jerry", "&AMP", "&amp&amp;",
]


def test_like_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    found = dict(rows(df, "t", decoded_entities(df["t"])))
    # Control characters without meaning are left out by the library; browsers keep them.
    expected = {t: html.unescape(t) for t in TEXTS} | {None: None, "&#129;": "\x81"}
    assert found == expected
