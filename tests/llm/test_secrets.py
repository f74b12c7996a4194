import hashlib
import random
import re

from fixtures import frame, odd_rows, prose
from pyspark.sql import functions as F

from pactline.llm import secret_scan as ss

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)

ORDINARY = ["page1page1page1page1page1page1page1page1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "section2/section2/section2/section2/sec2"]


def base(x):
    x = x or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m.group(1)) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m.group(0)) >= 16]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m.group(0)) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_base_spans_and_added_ones(llm_spark):
    r = random.Random(2)
    key = lambda n, abc: "".join(r.choice(abc) for _ in range(n))
    rows, planted = [], {}
    for i in range(150):  # every second document holds a key, all hold an ordinary token
        parts = [prose(r, 10), "😀é"]
        if i % 3 == 0:
            parts.append(r.choice([f'Token = "{key(20, ss._LOWER)}"', "token=token:abcdefgh", "API_KEY:'short'", "passwordpassword=x12345678", "secret : aKIA"]))
        if i % 4 == 0:
            parts += ["AKIA" + key(r.choice([3, 12, 16]), ss._UPPER + "0123456789"), key(r.choice([31, 32, 40]), "0123456789abcdef")]
        if i % 2 == 0:
            planted[i] = key(40, ss.ALPHABETS["base64"].replace("+", "").replace("/", "")) + "7Q"
            parts.append(planted[i])
        parts.append(r.choice(["page1page1page1page1page1page1page1page1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "section2/section2/section2/section2/sec2"]))
        r.shuffle(parts)
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += odd_rows()
    out = ss.scan(frame(llm_spark, rows)).select("doc_id", F.sha2(ss.joined("base"), 256).alias("h"), ss.joined("spans").alias("spans"), "n_assign", "n_random").collect()
    texts = {i: x for i, x, *_ in rows}
    assert len(out) == len(rows)
    found = false = 0
    for g in out:
        want = base(texts[g.doc_id])
        assert g.h == hashlib.sha256(want.encode()).hexdigest()
        spans = [s for s in g.spans.split(",") if s]
        assert ",".join(s for s in spans if not s.startswith("random")) == want
        for s in spans:
            kind, a, b = s.split(":")
            if kind == "random":
                token = texts[g.doc_id][int(a):int(b)]  # random hex of 31 digits is no base span, but a key all the same
                found, false = found + (token == planted.get(g.doc_id)), false + (token in ORDINARY)
    assert found > 0.8 * len(planted) and not false
    assert ss.scan(frame(llm_spark, [])).count() == 0


def test_battery_is_calibrated_on_random_keys(llm_spark):
    r = random.Random(1)
    rows = [("".join(r.choice(ss.ALPHABETS[e]) for _ in range(40)),) for e in ("hex", "alnum", "base64") for _ in range(200)]
    t = ss.battery(llm_spark.createDataFrame(rows, "token string"))
    low, half = t.agg(F.avg((F.col("p") < 0.05).cast("int")), F.avg((F.col("p") < 0.5).cast("int"))).first()
    assert low < 0.12 and 0.4 < half < 0.6


def test_scan_plan_has_no_python(llm_spark):
    plan = ss.scan(frame(llm_spark, [(1, "x", "en", "s", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
