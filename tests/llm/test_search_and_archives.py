import gzip
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pactline.llm import topk_search as ts
from pactline.llm import warc_revisits as wr
from pactline.llm.common import shared_path


def by_force(rows, k):
    vecs = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in vecs.items():
        if q % 50 == 0:
            n = lambda b: (min(len(a), len(b)))
            best = sorted((-int(a[:n(b)] @ b[:n(b)]), i) for i, b in vecs.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(llm_spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 64)
    monkeypatch.setattr(ts, "QUERY_BLOCK", 3)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=12) * r.choice([0.1, 1, 4]) * np.linspace(1, 0.1, 12)).tolist()) for i in range(700)]
    rows += [(1000 + i, [1.0] * 12) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, [0.0] * 12), (None, [9.0] * 12), (2050, [1.0] * 5)]
    df = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"norm": F.lit("clash"), "q": F.lit("clash"), "band": F.lit(1)})
    got = ts.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == by_force(rows, 5)


def test_few_and_no_candidates(llm_spark):
    df = llm_spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, ts.top_k(df, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 256 * 512)]
    assert ts.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "n": F.lit(1), "value": F.lit("v")})


def test_round_trip(llm_spark):
    r = random.Random(1)
    big = ["".join(r.choice("ab é\r\n") for _ in range(1500)) for _ in range(5)]
    rows = [(i, f"http://x/{i}", r.choice([*big, "small", "small", "", None, "a\r\n\r\nb" * 400])) for i in range(120)]
    rows += [(200, "u\r\nEvil: 1", big[0]), (201, None, "\r\n\r\n"), (202, "u", "WARC/1.1\r\n\r\n" * 100)]
    got = sorted(map(tuple, wr.archive_round_trip(pages(llm_spark, rows)).collect()))
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and first[h or ""] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want)
    assert wr.archive_round_trip(pages(llm_spark, [])).count() == 0


def test_archives_are_warc_files(llm_spark):
    rows = [(1, "http://x/1", "p" * 1200), (2, "http://x/2", "p" * 1200), (3, "http://x/3", "tiny"), (3, "http://x/3", "tiny")]
    path = shared_path(llm_spark, "warc")
    wr.write_archives(pages(llm_spark, rows), path)
    files = llm_spark.read.format("binaryFile").load(path).select("content").collect()
    raw = b"".join(gzip.decompress(bytes(f.content)) for f in files if f.content)
    assert raw.count(b"WARC/1.1\r\n") == 4 and raw.count(b"WARC-Type: revisit") == 1 and raw.count(b"p" * 1200) == 1
    assert b"WARC-Refers-To-Target-URI: http://x/2" in raw and raw.endswith(b"\r\n\r\n")
    full = {r.page_id: r for r in wr.resolve_revisits(wr.read_archives(llm_spark, path)).collect()}
    assert bytes(full[1].payload) == b"p" * 1200 and full[1].refers_to == 2 and full[3].record_type == "response"
