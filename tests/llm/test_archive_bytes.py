import hashlib
import itertools

from pactline.llm import warc_revisits as wr


def test_payloads_that_begin_or_end_in_line_breaks(llm_spark):
    ends = ["", *("".join(p) for n in (1, 2, 3, 4, 5) for p in itertools.product("\r\n", repeat=n))]
    html = [a + "x" + b for a in ends for b in ("", "\r\n", "\r\n\r\n", "\r", "\n\r")] + ["y" + b for b in ends] + ends
    html += ["\r\n\r\n" * 100_000, "z" * 999 + "\r\n", "z" * 1000 + "\r\n\r\n", "z" * 1000 + "\r\n\r\n", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", None]
    rows = [(i, f"http://h/{i}", x) for i, x in enumerate(html)]
    for parts in (1, 7):
        got = {r["page_id"]: r for r in wr.archive_round_trip(llm_spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
        assert len(got) == len(rows)
        for i, _, x in rows:
            body = (x or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        revisits = {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"}
        assert revisits == {len(rows) - 4: len(rows) - 3}
