"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Three fixed patterns give the base spans. Further candidates are long tokens with digits and letters. For each, the encoding
is inferred (hex, base32, lower-case alphanumeric or base64) and three tests ask whether its symbols look drawn at random:
chi-squared for a uniform alphabet (Wilson-Hilferty), runs above and below the middle of the alphabet, and serial correlation
at lag one. Fisher's method combines them to the chance p that a random key looks as odd as this. Random keys spread p evenly
and ordinary tokens crowd near zero, so in each encoding and length band the keys are counted from the upper half of the p
scale, and the lowest cut is taken above which the estimated share of ordinary tokens stays within `fdr`. Candidates above the cut that
touch no base span are added.

Positions count code points: what stands before a match is the sum of the pieces and matches before it.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; documents that share an id keep their
own texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Fixed patterns of the base scan; the value of an assignment is group 1.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so shorter ones may be left out of the search
MIN_VALUE, MIN_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "random"]
# A token that starts where no token character stands before, holds a digit and a letter, and has 16 characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
FDR = 0.05
# A bin of p that by itself holds more ordinary tokens than this share ends the accepted range (fine bins near zero see them).
LOCAL = 0.5
EDGES = [0.0, 1e-8, 1e-6, 1e-4, 1e-3, 0.01, *[k / 20 for k in range(1, 20)]]

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "alnum": _DIGITS + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/"}


def _spans(texts: DataFrame, pattern: str, kind: str) -> DataFrame:
    """(doc_id, t, kind, start, end, token, value) of all matches of `pattern`."""
    p = F.lit(pattern)
    group = 1 if kind == "assign" else 0
    cut = texts.where(F.col("x").rlike(pattern)).select(
        "doc_id", "t", F.posexplode(F.arrays_zip(F.split("x", pattern, -1).alias("piece"), F.regexp_extract_all("x", p, F.lit(0)).alias("token"),
                                                 F.regexp_extract_all("x", p, F.lit(group)).alias("value"))).alias("pos", "m"))
    order = Window.partitionBy("doc_id", "t").orderBy("pos")
    before = F.sum(F.length("m.piece") + F.coalesce(F.length("m.token"), F.lit(0))).over(order) - F.coalesce(F.length("m.token"), F.lit(0))
    return (cut.select("doc_id", "t", F.lit(kind).alias("kind"), before.alias("start"), F.col("m.token").alias("token"), F.col("m.value").alias("value"))
            .where(F.col("token").isNotNull()).withColumn("end", F.col("start") + F.length("token")))


def encoding(token: Column) -> Column:
    """Name of the smallest alphabet that explains the token."""
    return (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32")
            .when(token.rlike("^[a-z0-9]+$"), "alnum").otherwise("base64"))


def _normal_tail(z: Column) -> Column:
    """Chance that a normal variable exceeds z (logistic approximation, error below 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.070566 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def battery(tokens: DataFrame) -> DataFrame:
    """Add enc, band, z_chi, z_runs, z_serial and the combined p to rows with a column `token`."""
    body = F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")
    df = tokens.withColumn("enc", encoding(F.col("token"))).withColumn("s", F.when(F.col("enc") == "hex", F.lower(body)).otherwise(body))
    alphabet = F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv])[F.col("enc")]
    df = df.withColumn("abc", alphabet).withColumn("a", F.length("abc").cast("double")).withColumn("n", F.length("s").cast("double"))
    squares = F.aggregate(F.split("abc", ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
        F.pow((F.length("s") - F.length(F.replace(F.col("s"), c, F.lit("")))).cast("double"), F.lit(2.0))))
    df = df.withColumn("chi", squares * F.col("a") / F.col("n") - F.col("n")).withColumn(
        "v", F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: (F.instr(F.col("abc"), c) - 1).cast("double")))
    k = F.col("a") - 1
    z_chi = (F.pow(F.greatest(F.col("chi"), F.lit(1e-9)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    # mean and squares around it, then runs and lag-one products from neighbours
    df = df.withColumn("z_chi", z_chi).withColumn("m", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    df = df.withColumn("d", F.transform("v", lambda x: x - F.col("m"))).withColumn("hi", F.transform("v", lambda x: (x >= F.col("a") / 2).cast("int")))
    near = F.zip_with(F.slice("d", F.lit(1), F.size("d") - 1), F.slice("d", F.lit(2), F.size("d") - 1), lambda x, y: x * y)
    turns = F.zip_with(F.slice("hi", F.lit(1), F.size("hi") - 1), F.slice("hi", F.lit(2), F.size("hi") - 1), lambda x, y: (x != y).cast("int"))
    df = df.withColumn("var", F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x)).withColumn("lag", F.aggregate(near, F.lit(0.0), lambda s, x: s + x))
    df = df.withColumn("runs", 1 + F.aggregate(turns, F.lit(0), lambda s, x: s + x)).withColumn("up", F.aggregate("hi", F.lit(0), lambda s, x: s + x).cast("double"))
    down, n = F.col("n") - F.col("up"), F.col("n")
    mean = 1 + 2 * F.col("up") * down / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    # all symbols on one side of the middle: as far from random as the runs test can tell
    z_runs = F.when(spread > 0, (F.col("runs") - mean) / F.sqrt(F.greatest(spread, F.lit(1e-12)))).otherwise(-F.sqrt(n))
    z_serial = F.when(F.col("var") > 0, (F.col("lag") / F.greatest(F.col("var"), F.lit(1e-12)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    df = df.withColumn("z_runs", z_runs).withColumn("z_serial", z_serial)
    logs = sum((F.log(F.greatest(p, F.lit(1e-300))) for p in (_normal_tail(F.col("z_chi")), 2 * _normal_tail(F.abs("z_runs")), 2 * _normal_tail(F.abs("z_serial")))), F.lit(0.0))
    h = -logs  # half of Fisher's statistic with six degrees of freedom
    p = F.least(F.exp(-h) * (1 + h + h * h / 2), F.lit(1.0))
    band = F.floor(F.log2("n") * 2).cast("int")  # lengths within a factor of about 1.4 are judged together
    return df.select(*tokens.columns, "enc", band.alias("band"), "z_chi", "z_runs", "z_serial", p.alias("p"))


def cuts(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(enc, band, cut) from distinct tokens: the lowest bin of p above which the estimated share of ordinary tokens is at most `fdr`."""
    edge = F.array(*[F.lit(e) for e in EDGES])
    at = sum(((F.col("p") >= e).cast("int") for e in EDGES[1:]), F.lit(0))
    bins = tested.groupBy("enc", "band", at.alias("bin")).agg(F.count("*").alias("n"))
    # at most len(EDGES) rows for each encoding and band from here on
    down = Window.partitionBy("enc", "band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("enc", "band")
    bins = bins.withColumn("low", F.element_at(edge, F.col("bin") + 1)).withColumn("high", F.coalesce(F.try_element_at(edge, F.col("bin") + 2), F.lit(1.0)))
    # keys spread evenly, so the upper half of the scale holds half of them; one more than seen there, as a few keys may all lie
    # in the lower half: a token alone in its encoding and band is then judged by its own p and lost below 0.01 only
    keys = 2 * (F.sum(F.when(F.col("low") >= 0.5, F.col("n")).otherwise(0)).over(whole) + 1)
    above, even, own = F.sum("n").over(down), keys * (1 - F.col("low")), keys * (F.col("high") - F.col("low"))
    # an excess counts when it is more than chance: two standard errors for the range above a cut, three for a single bin
    wide = ((above - even) / above > fdr) & (above - even > 2 * F.sqrt(even))
    dense = ((F.col("n") - own) / F.col("n") > LOCAL) & (F.col("n") - own > 3 * F.sqrt(own) + 0.5)
    judged = bins.withColumn("bad", ((F.col("low") < 0.5) & (wide | dense)).cast("int"))
    return judged.withColumn("bad", F.max("bad").over(down)).where("bad = 0").groupBy("enc", "band").agg(F.min("low").alias("cut"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, t, n_assign, n_access, n_hex, n_random, base, spans) for every row; base and spans are arrays of struct(start, ord, end)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("x"))
    any_of = F.col("x").rlike(ASSIGN) | F.col("x").rlike(ACCESS) | F.col("x").rlike(HEX) | F.col("x").rlike(CANDIDATE)
    texts = written(rows.where(any_of).dropDuplicates(["doc_id", "t"]), "texts")
    base = (_spans(texts, ASSIGN, "assign").where(F.length("value") >= MIN_VALUE)
            .union(_spans(texts, ACCESS, "access").where(F.length("token") >= MIN_ACCESS)).union(_spans(texts, HEX, "hex")))
    tested = written(battery(_spans(texts, CANDIDATE, "random")).select("doc_id", "t", "kind", "start", "end", "token", "enc", "band", "p"), "tested")
    # a row for each encoding and length band: a few dozen, whatever the corpus size
    limit = F.broadcast(cuts(tested.dropDuplicates(["token"]), fdr))
    added = tested.join(limit, ["enc", "band"]).where(F.col("p") >= F.col("cut"))
    named = base.select("doc_id", "t", "kind", "start", "end").union(added.select("doc_id", "t", "kind", "start", "end"))
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per_doc = named.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("start", code.alias("ord"), "end"))).alias("all"))
    known = F.filter("all", lambda s: s["ord"] < 4)
    free = F.filter("all", lambda s: (s["ord"] < 4) | ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = per_doc.withColumn("base", known).withColumn("spans", free).drop("all")
    found = found.withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    out = rows.select("doc_id", "t").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["ord"] == k)), F.lit(0)).cast("long")
    sized = out.select("doc_id", "t", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), count(4).alias("n_random"), "base", "spans")
    return sized.withColumns({c: F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("n_assign", "n_access", "n_hex", "n_random")})


def joined(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined; empty without any."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["ord"])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
