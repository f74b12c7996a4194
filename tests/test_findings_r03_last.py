"""Findings of round 3 that were settled last: F19, F39, F45, F47, F51."""

import random

from pyspark.sql import functions as F

from pactline.functions import dates
from pactline.operators import deals, similarity
from pactline.plans.registry import tuned


def test_pairs_are_scored_once(spark):
    """the scored pairs are stored, so that reading every edge twice does not score them again."""
    rows = [(i, "abcdef"[i % 6] + "one completes acquisition of target", f"o{i}", "2001-07-01 00:00:00", []) for i in range(6)]
    items = spark.createDataFrame(rows, "id bigint, title string, source string, published_at string, firms array<string>")
    edges = similarity.story_edges(items)
    assert edges.count() > 0
    assert "ArrowEvalPython" not in edges._jdf.queryExecution().toString()


def test_fused_code_is_small_enough_to_be_compiled(spark):
    """chains of expressions above the compiler's limit are not fused."""
    assert int(tuned(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_edit_distances_of_a_batch(spark):
    """distances of a whole batch, long, empty and non-ASCII strings among them, against the table of all prefixes."""
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(above[j - 1] if x == y else 1 + min(above[j], row[j - 1]))
        return row[-1]

    pick = random.Random(3)
    texts = ["".join(pick.choice(signs) for _ in range(pick.choice((0, 1, 9, 40, 63, 64, 65, 90, 300)))) for signs in ("ab ", "bcdfgh 12", "aé漢 𝒳")
             for _ in range(60)]
    pairs = [(a, pick.choice(texts)) for a in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.indel("a", "b").alias("d")).collect()
    assert all(r.d == plain(r.a, r.b) for r in got) and len(got) == len(pairs)


def test_kept_headlines_are_counted_in_one_reading(spark):
    """counts per source come from forms counted once; the headlines are not read again for the result."""
    titles = ["Bcdfghj completes acquisition of Klmnpqr", "Xzwvtrq completes acquisition of Ghjklmn", "Why Bcdfghj deals keep getting bigger", "", None]
    rows = [(s, t) for s in ("one", "two", None) for t in titles] + [("three", titles[2])]
    df = spark.createDataFrame(rows, "source string, title string")
    got = deals.is_deal_counts(df)
    assert {tuple(r) for r in got.collect()} == {("one", 5, 2, 3), ("two", 5, 2, 3), (None, 5, 2, 3), ("three", 1, 0, 1)}
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


def test_dates_are_tidied_once(spark):
    """the patterns that tidy a date stand once in the plan, not once for every layout and every use of the result."""
    texts = {"Mon, 2 Jul 2001 10:00:00 GMT": "2001-07-02 10:00:00", "2 Jul 2001 10:00:00 +00:00": "2001-07-02 10:00:00",
             "2001-07-02T10:00:00.5Z": "2001-07-02 10:00:00", "2001-07-02T03:00:00-07:00": "2001-07-02 10:00:00",
             "July 2, 2001": "2001-07-02 07:00:00", "7/2/2001": "2001-07-02 07:00:00", "2 Jul 2001 06:00 EDT": "2001-07-02 10:00:00",
             "2 Jul 2031 06:00 EDT": "2001-07-03 00:00:00", "soon": "2001-07-03 00:00:00", None: "2001-07-03 00:00:00"}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "d string, want string")
    at = dates.published_or_fetched(dates.parse_date(F.col("d")), F.lit("2001-07-03 00:00:00").cast("timestamp"))["at"]
    got = df.select("d", "want", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []
    assert got._jdf.queryExecution().optimizedPlan().toString().count("mon|tue|wed") == 1
