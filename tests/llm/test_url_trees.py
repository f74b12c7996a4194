import random
import re

import pytest

from pactline.llm import url_trees as ut


def plain_host_path(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


ODD = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://x.com?a=1", "http://x.com/#f", "http://xcom/a", "http://É.Example.NET/es/ü?x", "http://example.com/en/", "http://www.example.com/en/1",
       "http://a.www.example.com/en/", "http://example.com:80/en/", "http://u@example.com/en/x", "a://b://c.com/", "http://net/es/", "http://x.net/es", "http://x.net/esx/", "http://.com/", "http://..com/y", "http://com./",
       "http://x.com/" + "a" * 100_000, "http://x.net/fr/\n?://com/"]


def web(n, seed=3):
    """URLs whose blocked ones stand out by their shape on hosts that no rule tells apart."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.4
        name = "".join(r.choice("0123456789-") if bad and r.random() < 0.5 else r.choice("abcdefgh") for _ in range(r.randrange(9, 22)))
        end = ("bad" if bad else "good")[::1 if i % 2 else -1]
        out.append((f"https://{name}.{end}/p/{i}" + (f"?a={i}&b={i * 7}" if bad != (r.random() < 0.2) else "?old"), bad))
    return out


def test_rules_and_parts_equal_a_plain_version(llm_spark):
    pages = llm_spark.createDataFrame([*enumerate(ODD), (None, "http://q.org/"), (3, ODD[3]), *((100 + i, u) for i, (u, _) in enumerate(web(50)))], "page_id long, url string")
    got = ut.judge(pages.selectExpr("*", "'clash' rule", "'clash' x", "1 host"), ut.fit(pages)).collect()
    assert len(got) == pages.count()
    by_id = {i: u for i, u in [*enumerate(ODD), *((100 + i, u) for i, (u, _) in enumerate(web(50)))]}
    for row in got:
        url = "http://q.org/" if row["page_id"] is None else by_id[row["page_id"]]
        host, path = plain_host_path(url)
        rule, verdict = plain_rule(host, path, ut.RULES)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["block_score"] >= 0.5 else "allow"))


def test_longest_rule_wins_and_ties_go_to_the_longer_host():
    book = ut.RuleBook([("allow", "b.com", "/"), ("block", "com", "/xx"), ("block", "com", "/"), ("allow", "", "/")])
    assert book.find("a.b.com", "/xx") == ("b.com/", "allow")
    assert book.find("com", "/xx") == ("com/xx", "block")
    assert book.find("org", "/") is None


def test_trees_judge_unseen_hosts(llm_spark):
    """Rules label half of the URLs; the trees find the blocked ones among the others by their shape."""
    urls = web(2000)
    pages = llm_spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    rules = [("block", "bad", "/"), ("allow", "good", "/")]
    model = ut.fit(pages, rules)
    free = {r["page_id"]: r["verdict"] for r in ut.judge(pages, model, rules).where("rule is null").collect()}
    assert len(free) == 1000
    right = sum((v == "block") == urls[i][1] for i, v in free.items())
    assert right >= 950
    again = ut.fit(pages.repartition(5), rules)
    assert all((s.feature == t.feature).all() and (s.value == t.value).all() for s, t in zip(model.trees, again.trees, strict=True))


@pytest.mark.parametrize(("rules", "want"), [([], "allow"), ([("block", "bad", "/")], "block"), ([("allow", "good", "/")], "allow")])
def test_few_labels(llm_spark, rules, want):
    pages = llm_spark.createDataFrame([(i, u) for i, (u, _) in enumerate(web(40))], "page_id long, url string")
    assert {r["verdict"] for r in ut.judge(pages, ut.fit(pages, rules), rules).where("rule is null").collect()} == {want}
    none = pages.where("false")
    assert ut.judge(none, ut.fit(none)).count() == 0
