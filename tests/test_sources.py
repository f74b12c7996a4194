from pyspark.sql import functions as F

from pactline.operators import geo
from pactline.sources import advisers, feeds

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>
<item><title>Acme buys Beta &amp; Co | Outlet</title><link>https://e.com/a?utm_source=x</link><pubDate>Fri, 25 Sep 2026 10:30:00 GMT</pubDate>
<description>Short teaser</description></item><item><title></title><link>https://e.com/b</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title>Gamma to buy Delta</title><link href="https://e.com/c"/><updated>2026-09-25T10:00:00Z</updated></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "c.xml").write_text("<html><body>no</body></html>")
    e = feeds.read_feed_entries(spark, str(tmp_path))
    i = feeds.to_items(e, F.lit("2026-09-25 18:00:00").cast("timestamp"), F.lit("Outlet"), F.lit(False)).orderBy("url").collect()
    assert [(r.title, r.canonical_url, r.description, str(r.published_at)) for r in i] == [
        ("Acme buys Beta & Co", "https://e.com/a", "Short teaser", "2026-09-25 10:30:00"),
        ("Gamma to buy Delta", "https://e.com/c", "", "2026-09-25 10:00:00")]
    assert {r.file: r.is_feed for r in feeds.feed_validity(spark, str(tmp_path)).collect()} == {"a.xml": True, "b.xml": True, "c.xml": False}


def test_adviser_file(spark, tmp_path):
    p = tmp_path / "ia.csv"
    p.write_text('SEC#|Organization CRD#|Legal Name|Primary Business Name|Main Office City|Main Office State|5F(2)(c)\n'
                 '801-1|123|ACME WEALTH PARTNERS, LLC|ACME WEALTH|SEATTLE|WA|1,200,000,000\n802-9|999|EXEMPT LLC|EXEMPT|BOISE|ID|\n'
                 '801-2|456.0|BETA ADVISORS INC.||PORTLAND|or|850000000\n')
    rows = {r.crd: r for r in advisers.read_adviser_file(spark, str(p), "2026-09-01").collect()}
    assert set(rows) == {"123", "456"} and rows["123"].aum_usd == 1.2e9 and rows["123"].state == "WA"
    assert rows["456"].business_name == "BETA ADVISORS INC." and rows["456"].state == "OR"


def test_latest_file(spark):
    df = spark.createDataFrame([("x/ia090126.zip",), ("x/ia20260801.zip",), ("x/ia10012026.zip",), ("x/ia-era-100126.zip",)], "name string")
    assert str(advisers.latest_file(df).first().data_date) == "2026-10-01"


def test_projection_and_fan_out(spark):
    df = spark.createDataFrame([("ny", -74.0, 40.7), ("ak", -149.9, 61.2), ("hi", -157.8, 21.3), ("pr", -66.1, 18.4)], "k string, lon double, lat double")
    got = {r.k: (r.x, r.y) for r in geo.project(df).collect()}
    assert got["pr"] == (None, None) and all(got[k][0] is not None for k in ("ny", "ak", "hi"))
    pts = spark.createDataFrame([("1", 5.0, 5.0), ("2", 5.0, 5.0), ("3", 5.0, 5.0)], "crd string, x double, y double")
    out = {r.crd: (r.x, r.y) for r in geo.fan_out(pts).collect()}
    assert out["1"] == (5.0, 5.0) and len(set(out.values())) == 3


def test_adviser_file_with_lines_before_the_header(spark, tmp_path):
    rows = "\n".join(f'{100 + i},"Firm {i}, LLC",Firm {i},Boston,MA' for i in range(5))
    head = "Organization CRD#,Legal Name,Primary Business Name,Main Office City,Main Office State"
    for k, before in enumerate(("", "\n", "Report of advisers\n", "\nas of,today\n\n", "a,b,c,d,e\n")):
        path = tmp_path / f"ia{k}.csv"
        path.write_text(before + head + "\n" + rows + "\n")
        got = advisers.read_adviser_file(spark, str(path), "2026-09-01")
        assert sorted(r.crd for r in got.collect()) == [str(100 + i) for i in range(5)]
