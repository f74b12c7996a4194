from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pactline.functions import dates, money, text, urls


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_first_figure(spark):
    got = values(spark, ["$1.2bn", "$850mm", "$1.1 trillion", "$2,500,000", "$ 3.5 Billion", "$400k", "none"], money.first_figure)
    assert got[:6] == pytest.approx([1.2e9, 8.5e8, 1.1e12, 2.5e6, 3.5e9, 4e5]) and got[6] is None


def test_figures_have_offsets(spark):
    (row,) = values(spark, ["pays $5M, then $1.5bn more"], money.figures)
    assert [(f.start, f.end, f.value) for f in row] == [(5, 8, 5e6), (15, 21, 1.5e9)]


def test_money_label_rounds_like_the_exact_value(spark):
    df = spark.createDataFrame([(1.2e9,), (1.275e9,), (2.5e6,), (1e12,), (0.0,)], "v double")
    assert [r[0] for r in df.select(money.money_label(F.col("v"))).collect()] == ["$1.2B", "$1.27B", "$2M", "$1T", None]


def test_canonical_url(spark):
    cases = {"https://example.com/x?gclid=1&id=7&a=2": "https://example.com/x?a=2&id=7",
             "http://example.com:8080/x/": "http://example.com:8080/x",
             "HTTPS://WWW.Example.com:443/a/b/?utm_source=x&id=2#frag": "https://www.example.com/a/b?id=2"}
    assert values(spark, list(cases), urls.canonical_url) == list(cases.values())


def test_clean_link_keeps_case_and_slash(spark):
    assert values(spark, ["https://Example.com/A/?utm_x=1&b=2&a=1#z"], urls.clean_link) == ["https://Example.com/A/?b=2&a=1"]


def test_html_text(spark):
    got = values(spark, ["<p>Acme &amp; Beta&#8217;s  deal</p><script>x()</script> Read more", "Body text. The post Acme appeared first on Site."],
                 text.html_text)
    assert got == ["Acme & Beta’s deal", "Body text."]


def test_truncate_words(spark):
    (got,) = values(spark, ["word " * 100], text.truncate_words)
    assert len(got) <= 300 and got.endswith("word…")


def test_strip_source_suffix(spark):
    df = spark.createDataFrame([("Acme buys Beta | Think Advisor", "Think Advisor"), ("Acme buys Beta - ThinkAdvisor.com", "Think Advisor"),
                                ("Acme - Beta deal", "Other")], "t string, s string")
    got = [r[0] for r in df.select(text.strip_source_suffix(F.col("t"), F.col("s"))).collect()]
    assert got == ["Acme buys Beta", "Acme buys Beta", "Acme - Beta deal"]


def test_parse_date(spark):
    got = values(spark, ["Fri, 25 Sep 2026 10:30:00 -0700", "2026-09-25T17:30:00Z", "2026-09-25", "Sept. 25, 2026", "9/25/2026", "soon"],
                 dates.parse_date)
    day = datetime(2026, 9, 25, 7)
    assert got == [datetime(2026, 9, 25, 17, 30), datetime(2026, 9, 25, 17, 30), day, day, day, None]
