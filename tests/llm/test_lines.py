import collections

from fixtures import frame, odd_rows

from pactline.llm import line_spread


def by_force(rows, sites):
    where, first = collections.defaultdict(set), {}
    for i, x, _, s, _ in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((x or "").split("\n")):
            k = line.strip(" ")
            if k:
                where[k].add(s if s is not None else "\0")
                first.setdefault(k, (i, p))
    out = []
    for i, x, *_ in rows:
        lines = [] if x is None else x.split("\n")
        gone = [p for p, line in enumerate(lines) if len(where.get(line.strip(" "), ())) >= sites and first[line.strip(" ")] != (i, p)]
        kept = None if x is None else "\n".join(y for p, y in enumerate(lines) if p not in gone)
        out.append((i, kept, sum(1 for y in lines if y.strip(" ")), len(gone)))
    return sorted(out, key=str)


def test_removal_equals_brute_force(llm_spark):
    rows = []
    for i in range(60):
        lines = [f"own {i}", " on every site ", f"on {i % 6} of them", "", "seen on three" if i % 20 < 3 else f"x{i}", "near" if i < 10 else f"y{i}"]
        rows.append((i, "\n".join(lines), "en", f"site{i % 20}", 1))
    rows += odd_rows()
    for sites in (3, 10):
        got = line_spread.remove_boilerplate(frame(llm_spark, rows, extra=False), min_sites=sites)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == by_force(rows, sites)


def test_other_columns_stay_and_clashing_ones_are_replaced(llm_spark):
    rows = [(i, "same line\nown %d" % i, "en", f"s{i}", 1) for i in range(12)]
    df = frame(llm_spark, rows).selectExpr("*", "'old' as n_lines")
    out = line_spread.remove_boilerplate(df)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == [c for c in df.columns if c != "n_lines"]
    assert out.agg({"n_removed": "sum"}).first()[0] == 11 and out.where("t = 'clash'").count() == 12


def test_empty_table(llm_spark):
    assert line_spread.remove_boilerplate(frame(llm_spark, [])).count() == 0
