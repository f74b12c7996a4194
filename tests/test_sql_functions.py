import pytest
from pyspark.sql import functions as F

from pactline.functions import sql, urls
from pactline.sources import feeds

URLS = ["https://WWW.Example.com:443/a/b/?utm_source=x&b=2&a=1#top", "http://user@host.org:8080//", "https://e.com/?q=a%20b*c&q=&empty&FBCLID=1", "https://e.com/?utmost=1&utm_=2",
        "no address", "", None, "  https://e.com/x/?a=~._-  ", "https://e.com?a=b=c&d=%zz", "HTTP://e.com:80/é?ü=1"]


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register(spark)


def test_url_functions_equal_the_column_functions(spark, registered):
    u = spark.createDataFrame(list(enumerate(URLS)), "id int, u string")
    u.createOrReplaceTempView("some_urls")
    got = spark.sql("select id, url_canonical(u), url_clean(u), url_host(u), url_bare_host(u) from some_urls order by id").collect()
    want = u.select("id", urls.canonical_url(F.col("u")), urls.clean_link(F.col("u")), urls.host(F.col("u")), urls.bare_host(F.col("u"))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_page_links_equal_the_anchors_of_pages(spark, registered):
    html = ("<nav><h2><a href='/menu'>Menu</a></h2></nav><article><h2><a class=x href=\"https://e.com/a\">One <b>bold</b> word</a></h2></article>"
            "<h3><a href='https://e.com/b'>Two</a> and <a href=\"https://e.com/c\">Three</a></h3>")
    p = spark.createDataFrame([(1, "https://e.com/", html), (2, "https://e.com/", ""), (3, "https://e.com/", None)], "page_id int, url string, html string")
    p.createOrReplaceTempView("some_pages")
    got = spark.sql("select page_id, l.pos, l.href, l.label from some_pages, lateral page_links(html) l order by 1, 2").collect()
    want = feeds.page_anchors(p).select("page_id", "pos", "href", "text").orderBy("page_id", "pos").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 3


def test_headline_functions(spark, registered):
    row = spark.sql("select headline_norm('  Acme, Inc. buys—Beta! '), headline_jaccard('Acme buys Beta', 'Beta buys Gamma'), headline_norm(null), headline_jaccard(null, 'a')").first()
    assert tuple(row) == ("acme inc buys beta", 0.5, None, None)
    t = spark.createDataFrame([(1, "Acme buys Beta"), (2, "!"), (3, None)], "id int, t string")
    t.createOrReplaceTempView("some_titles")
    assert [tuple(r) for r in spark.sql("select id, w.pos, w.word from some_titles, lateral headline_words(t) w order by 1, 2").collect()] == [
        (1, 0, "acme"), (1, 1, "buys"), (1, 2, "beta")]
