import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactline.sources import sinks
from pactline.streaming import jobs, keyed, store

START = dt.datetime(2024, 3, 1)


def add_file(spark, path, rows):
    spark.createDataFrame(rows, "user long, kind string, at timestamp").coalesce(1).write.mode("append").parquet(path)


def at(day, hour=12):
    return START + dt.timedelta(days=day, hours=hour)


def like(spark):
    return spark.createDataFrame([], "user long, kind string, at timestamp")


def state_rows(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "n").load(f"{folder}/checkpoint").count()


def test_first_seen_continues_after_a_restart_and_sends_changes_only(spark):
    folder = jobs.work_folder(spark)
    add_file(spark, f"{folder}/in", [(1, "a", at(3)), (2, "a", at(4)), (1, "a", at(5)), (None, "a", at(1)), (4, "a", None)])

    def run():
        out = keyed.first_seen(jobs.file_stream(spark, f"{folder}/in", like(spark)), "user", "at")
        jobs.drain(out, jobs.batch_folder(f"{folder}/out"), "update", folder)

    run()
    add_file(spark, f"{folder}/in", [(1, "b", at(9)), (2, "b", at(2)), (3, "b", at(9))])
    run()
    got = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/out").orderBy("batch").collect():
        got[r["user"]].append(r["first_seen"])
    assert got == {1: [at(3)], 2: [at(4), at(2)], None: [at(1)], 3: [at(9)]}


def test_days_close_with_the_watermark_and_late_rows_are_corrections(spark):
    folder = jobs.work_folder(spark)
    r = random.Random(5)
    parts = [[(r.randrange(9), r.choice("ab"), at(d, r.randrange(24))) for d in days for _ in range(30)] for days in ((0, 1), (2, 3, 0), (4, 1, 0), (9,))]
    held = []
    for rows in parts:
        add_file(spark, f"{folder}/in", rows)
        out = keyed.closed_days(jobs.file_stream(spark, f"{folder}/in", like(spark)), "at", "kind", "UTC")
        jobs.drain(out, jobs.batch_folder(f"{folder}/out"), "append", folder)
        held.append(state_rows(spark, folder))
    got = jobs.result(spark, f"{folder}/out", out).collect()
    late = {g["day"] for g in got if g["row_kind"] == "late"}
    assert late == {"2024-03-01", "2024-03-02"}
    total = Counter()
    for g in got:
        total[g["day"], g["kind"]] += g["n"]
    want = Counter((str(x[2].date()), x[1]) for rows in parts for x in rows if x[2] < at(8, 0))
    assert total == want
    assert held == [4, 4, 4, 2]  # open days times keys: what the watermark has passed is gone


def test_retained_counts_leave_the_state(spark):
    folder = jobs.work_folder(spark)
    for day in (0, 1, 2, 6, 20):
        add_file(spark, f"{folder}/in", [(1, "a", at(day)), (2, "a", at(day, 13)), (2, None, at(day, 13))])
        out = keyed.retained_counts(jobs.file_stream(spark, f"{folder}/in", like(spark)), "at", "kind", 3)
        jobs.drain(out, jobs.batch_folder(f"{folder}/out"), "update", folder)
        last = state_rows(spark, folder)
    assert last == 2
    got = spark.read.parquet(f"{folder}/out").groupBy("day").agg(F.max_by(F.col("n"), "batch").alias("n"), F.sum("n").alias("all")).orderBy("day").collect()
    assert [g["n"] for g in got] == [0, 0, 0, 0, max(1, got[-1]["n"])] and got[-1]["all"] == 3


def test_a_bloom_filter_holds_its_keys():
    r = np.random.default_rng(2)
    a, b = r.integers(-2 ** 62, 2 ** 62, (2, 5000)), r.integers(-2 ** 62, 2 ** 62, (2, 5000))
    bits = store.bloom(*a)
    assert store.may_hold(bits, *a).all()
    assert store.may_hold(bits, *b).mean() < 0.02


def test_a_store_reads_only_what_may_hold_the_batch(spark):
    items = store.ItemStore(spark, f"{jobs.work_folder(spark)}/store", "url", buckets=16)
    frame = lambda keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "url string, value string")
    for batch in range(5):
        items.insert(frame([f"u{batch}-{k}" for k in range(800)]), batch)
    new = frame([*(f"n{k}" for k in range(4)), "u3-7", "u3-7", None, None])
    rows = items.placed(new.dropDuplicates(["url"]))
    folders = items.suspects(rows, 5)
    assert any(b == 3 for b, _ in folders) and len(folders) <= 4
    assert items.known(folders).count() < 400  # of 4,000 stored rows
    items.insert(new, 5)
    assert items.items(5).count() == 5
    items.insert(new, 5)  # the same batch again
    assert items.items().count() == 4005
    items.insert(new, 6)
    assert items.items().count() == 4005


def test_a_cut_short_replacement_leaves_the_old_dimension(spark, monkeypatch):
    path = f"{jobs.work_folder(spark)}/dim"
    frame = lambda n: spark.range(n).withColumn("name", F.lit("x"))
    with pytest.raises(FileNotFoundError):
        sinks.read_dimension(spark, path)
    assert sinks.replace_dimension(frame(20), path, 10)
    broken = frame(30).withColumn("name", F.when(F.col("id") > 25, F.raise_error(F.lit("lost"))).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_dimension(broken.repartition(4), path, 10)
    assert sinks.read_dimension(spark, path).count() == 20
    assert not sinks.replace_dimension(frame(3), path, 10)
    assert sinks.read_dimension(spark, path).count() == 20
    for n in (40, 50, 60):
        assert sinks.replace_dimension(frame(n), path, 10)
        assert sinks.read_dimension(spark, path).count() == n
    folders = [f for _, f in sinks._pointers(spark, path)]
    assert [spark.read.parquet(f"{path}/{f}").count() for f in folders] == [0, 0, 50, 60]


def test_statistics_are_kept_by_run_date(spark):
    path = f"{jobs.work_folder(spark)}/stats"
    rows = lambda days, n: spark.createDataFrame([(at(d), n) for d in days], "run_at timestamp, n long")
    sinks.write_stats(rows(range(10), 1), path)
    sinks.write_stats(rows((8, 9, 10), 2), path)
    live = sinks.live_stats(spark, path, F.lit("2024-03-11").cast("date"), 4)
    assert sorted((r["run_at"], r["n"]) for r in live.collect()) == [(at(6), 1), (at(7), 1), (at(8), 2), (at(9), 2), (at(10), 2)]
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan.replace("...", "") or ">= 2024-03-07)], PushedFilters: []" in plan
