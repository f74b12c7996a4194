import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pactline.operators import feed, geo, map_index, search_index

STORIES = ("id bigint, headline string, firms array<struct<name:string>>, sources array<struct<name:string>>, industries array<string>, "
           "states array<string>, deal struct<acquirer:string,target:string>")


def _stories(spark):
    rng = random.Random(5)
    words = ["acme", "acre", "beta", "bank", "$5m", "q&a", "über", "été", "1st", "buys", "Buys-out", "o'neil"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5))), [(rng.choice(words),)], [("Wire",)], [], [], (rng.choice(words), None)) for i in range(300)]
    rows += [(1000, None, None, None, None, None, None), (1001, "", [], [], [], [], ("", "")), (None, "acme", [], [], [], [], None)]
    return spark.createDataFrame(rows, STORIES).repartition(4)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    c = _stories(spark)
    path = str(tmp_path / "words")
    search_index.write_index(c, feed.search_words(c), path)
    for q in ("ac", "a b", "ac acm", "b bu wire", "$5", "ü é", "1 q&", "nothing here", "o'n", "a a a", "", "..."):
        want = {r.id for r in feed.filter_feed(c, feed.FeedQuery(q=q)).collect() if r.id is not None}
        got = [r.id for r in feed.filter_feed(c.where("id is not null"), feed.FeedQuery(q=q), index=path).collect()]
        assert set(got) == want and len(got) == len(want), q


def test_index_reads_its_prefixes_only(spark, tmp_path, capsys):
    c = _stories(spark)
    path = str(tmp_path / "words")
    search_index.write_index(c, feed.search_words(c), path)
    search_index.find(spark, path, ["ac", "bu"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "lead#" in plan.split("PartitionFilters:")[1].split("\n")[0] and "StringStartsWith(term,ac)" in plan
    read = {f.split("lead=")[1][:2] for (f,) in search_index.postings(spark, path, ["ac", "bu"]).select(F.input_file_name()).distinct().collect()}
    assert read == {"wa", "wb"} and len(glob.glob(path + "/postings/lead=*")) > 5


def test_terms_that_others_imply(spark, tmp_path):
    assert search_index.needed_terms(["bo", "b", "bob", "c", "c"]) == ["bob", "c"]
    with pytest.raises(ValueError):
        search_index.find(spark, str(tmp_path), [])


def test_index_of_no_stories(spark, tmp_path):
    c = _stories(spark).limit(0)
    path = str(tmp_path / "words")
    search_index.write_index(c, feed.search_words(c), path)
    assert search_index.find(spark, path, ["a"]).count() == 0


def _points(spark, n=3000):
    rng = random.Random(9)
    rows = [(i, rng.uniform(-20, 1100), rng.uniform(-20, 700), float(i)) for i in range(n)]
    rows += [(n + 1, None, 5.0, 1.0), (n + 2, float("nan"), 5.0, 1.0), (n + 3, 5.0, float("inf"), 1.0), (n + 4, 5.0, 5.0, None)]
    rows += [(n + 10 + i, 100.0, 100.0, 1.0) for i in range(500)]
    return spark.createDataFrame(rows, "crd bigint, x double, y double, aum_usd double")


def test_boxes_hold_the_rows_of_a_scan(spark, tmp_path):
    p = _points(spark).cache()
    path = str(tmp_path / "map")
    map_index.write_map(p.repartition(8), path)
    boxes = [(100, 50, 600, 400), (100, 100, 100, 100), (-50, -50, 3, 3), (1000, 600, 5000, 5000), (0, 0, 2000, 2000), (300, 10, 301, 690), (9, 9, 1, 1)]
    rng = random.Random(1)
    boxes += [(x, y, x + rng.uniform(0, 80), y + rng.uniform(0, 80)) for x, y in ((rng.uniform(0, 900), rng.uniform(0, 600)) for _ in range(6))]
    for b in boxes:
        got, want = map_index.box(spark, path, *b), geo.viewport(p, *b)
        assert got.columns == want.columns and sorted(r.crd for r in got.collect()) == sorted(r.crd for r in want.collect()), b


def test_ranges_follow_the_curve(spark):
    rng = random.Random(2)
    for _ in range(20):
        x, y = rng.uniform(0, 900), rng.uniform(0, 600)
        ranges = map_index.z_ranges(x, y, x + 60, y + 40)
        assert 1 <= len(ranges) <= map_index.MAX_RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert map_index.z_ranges(0, 0, 1e9, 1e9) == [(0, 4 ** map_index.BITS - 1)]
    key = lambda x, y: spark.range(1).select(map_index.z_key(F.lit(x), F.lit(y)).alias("z")).first().z
    unit = map_index.EXTENT / (1 << map_index.BITS)
    assert [key(0.0, 0.0), key(unit, 0.0), key(0.0, unit), key(unit, unit), key(2 * unit, 0.0)] == [0, 1, 2, 3, 4]


def test_a_box_reads_few_row_groups(spark, tmp_path, capsys):
    path = str(tmp_path / "map")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        map_index.write_map(_points(spark, 20000), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    map_index.box(spark, path, 10, 10, 60, 60).explain("formatted")
    assert "GreaterThanOrEqual(_z," in capsys.readouterr().out
    ranges = map_index.z_ranges(10, 10, 60, 60)
    groups = []
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        col = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)].index("_z")
        groups += [meta.row_group(g).column(col).statistics for g in range(meta.num_row_groups)]
    hit = [s for s in groups if any(s.min <= b and s.max >= a for a, b in ranges)]
    assert len(groups) >= 4 and len(hit) <= len(groups) / 2
