"""Firm linking: adviser names -> alias table -> token n-gram equi-joins with text -> guarded, non-overlapping matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hof import let, one_of, positions
from ..functions.money import FIGURE, UNIT_SCALE
from ..rules import (ACRONYMS_NOT_FIRMS, EXTRA_WORDS, GENERIC_WORDS, GIVEN_NAMES, PLACE_NAMES, STOP_PHRASES,
                     SUBJECT_DOMINANCE, SUBJECT_VERBS, SURNAMES)
from ..functions.phrases import one_phrase
from ..session import checkpointed, small_side
from .forms import by_form, known_words, restored
from .wealth import LEAD_WORDS

# fixed values: legal forms at the end of a name; punctuation no name spans; short names kept in capitals
# fixed values: legal forms, with and without dots
LEGAL_FORMS = """llc, l.l.c, inc, incorporated, corp, corporation, co, company, ltd, limited, lp, l.p, llp, l.l.p, pllc, p.c, pc, na, n.a, plc"""
LEGAL_TAIL = rf"(?i)(?:[\s,]+{one_phrase(LEGAL_FORMS)}\.?)+\s*$"
BOUNDARY = r"[:;,!?|\"“”‘()\[\]—–]|\s-\s"
SENTENCE_END = r"(?<=[\p{L}\p{N}_]{3})\.(?=\s|$)"
KEPT_CAPITALS = ("LPL", "RBC", "UBS", "BNY", "EP", "SEIA", "EQT")
LEGAL_TOKENS = ("llc", "lp", "llp", "inc", "ria", "pc")
CONNECTORS = ("and", "of", "the", "for", "in")
BAR = "|"


def strip_legal(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.trim(name), LEGAL_TAIL, ""), r"(?i)^the\s+", ""), F.lit(" ,."))


def pretty_name(name: Column) -> Column:
    """Display form: legal form dropped, names in capitals title-cased with short acronyms kept."""
    base = F.rtrim(strip_legal(name), F.lit(" ,&"))

    def word(w: Column) -> Column:
        core = F.regexp_replace(w, "[^A-Z]", "")
        keep = ((F.length(core) <= 3) & ~core.rlike("[AEIOU]")) | w.isin(*KEPT_CAPITALS)
        return F.when(keep, w).when(w == "AND", F.lit("and")).otherwise(F.initcap(F.lower(w)))

    shout = (base == F.upper(base)) & (base != F.lower(base))
    return F.when(shout, F.array_join(F.transform(F.split(base, r"\s+"), word), " ")).otherwise(base)


def spoken(text: Column) -> Column:
    """array<string> of tokens as written; '|' marks a hard boundary."""
    t = F.regexp_replace(F.regexp_replace(text, "’", "'"), r"([\p{L}\p{N}_])'s\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, SENTENCE_END, " | "), BOUNDARY, " | ")
    return F.regexp_extract_all(t, F.lit(r"\||&|[\p{L}\p{N}]+"), 0)


def _norm(token: Column) -> Column:
    return F.when(token == "&", F.lit("and")).otherwise(F.lower(token))


def normal_tokens(text: Column) -> Column:
    return F.transform(spoken(text), _norm)


def normal_name(text: Column) -> Column:
    return F.array_join(F.filter(normal_tokens(text), lambda t: t != BAR), " ")


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, original, token) rows of a text column."""
    return df.select(key, F.posexplode(spoken(F.col(text))).alias("pos", "original")).withColumn(
        "token", _norm(F.col("original")))


# ---------------------------------------------------------------- dictionary side
def alias_rows(advisers: DataFrame) -> DataFrame:
    """(alias, crd, is_full, aum): the full normalised name, then prefixes that drop trailing generic words."""
    names = F.array_distinct(F.array_compact(F.array("business_name", "legal_name")))
    n = advisers.select("crd", F.coalesce("aum_usd", F.lit(0.0)).alias("aum"), F.explode(names).alias("name"))
    n = n.withColumn("toks", F.filter(normal_tokens(strip_legal(F.col("name"))), lambda t: t != BAR))
    generic = lambda t: one_of(t, sorted(GENERIC_WORDS))
    last = F.array_max(F.filter(positions(F.col("toks")), lambda i: ~generic(F.get("toks", i))))
    n = n.withColumn("shortest", last + 1).where(F.col("shortest").isNotNull())
    size = F.size("toks")
    lengths = F.filter(F.sequence(F.col("shortest"), size), lambda k: (k == size) | ~F.get("toks", k - 1).isin(*CONNECTORS))
    return n.select("crd", "aum", "toks", F.explode(lengths).alias("k")).select(
        F.array_join(F.slice("toks", F.lit(1), F.col("k")), " ").alias("alias"), "crd", (F.col("k") == F.size("toks")).alias("is_full"),
        "aum")


def _stems(token: Column) -> Column:
    """The token and the forms left after removing a common inflection."""
    cut = lambda k: F.substring(token, F.lit(1), F.length(token) - k)
    forms = [
        F.when(token.rlike("ies$"), F.concat(cut(3), F.lit("y"))), F.when(token.rlike("es$"), cut(2)),
        F.when(token.rlike("s$") & ~token.rlike("ss$"), cut(1)), F.when(token.rlike("ed$"), cut(2)),
        F.when(token.rlike("ed$"), cut(1)), F.when(token.rlike("ing$"), cut(3)),
        F.when(token.rlike("ing$"), F.concat(cut(3), F.lit("e"))),
        F.when(token.rlike(r"..([^aeiou])\1ed$"), cut(3)), F.when(token.rlike(r"..([^aeiou])\1ing$"), cut(4))]
    return F.array_append(F.filter(F.array_compact(F.array(*forms)), lambda s: F.length(s) >= 3), token)


def _common_tokens(tokens: DataFrame, words: DataFrame | None) -> DataFrame:
    """Tokens that are dictionary words, as is or inflected. `words` has one column `word`."""
    extra = tokens.where(one_of(F.col("token"), sorted(EXTRA_WORDS)))
    if words is None:
        return extra
    hit = tokens.select("token", F.explode(_stems(F.col("token"))).alias("word")).join(words, "word", "left_semi")
    return hit.select("token").union(extra).distinct()


def alias_owners(advisers: DataFrame, words: DataFrame | None = None, stop: frozenset[str] = STOP_PHRASES,
                 surnames: frozenset[str] = SURNAMES) -> DataFrame:
    """alias -> crd with how it may be used.

    Columns: alias, crd, mode ('any' or 'subject'), n (words), plain (only dictionary or generic words), rule.
    Owners are found with partial aggregates only, so an alias shared by very many registrants stays cheap. Of registrants
    with equal assets the one with the lowest number, the earliest, owns an alias.
    """
    pairs = alias_rows(advisers).groupBy("alias", "crd").agg(
        F.max("is_full").alias("is_full"), F.max("aum").alias("aum"))
    owners = pairs.groupBy("alias").agg(
        F.count(F.lit(1)).alias("crds"), F.count_if("is_full").alias("fulls"),
        F.max(F.when(F.col("is_full"), F.col("crd"))).alias("full_crd"),
        F.min_by("crd", F.struct(-F.col("aum"), F.length("crd"), F.col("crd"))).alias("top_crd"), F.max("aum").alias("top_aum"),
        F.sum("aum").alias("all_aum"))
    owners = owners.withColumn("toks", F.split("alias", " ")).withColumn("n", F.size("toks"))
    flat = owners.select("alias", F.explode("toks").alias("token"))
    common = _common_tokens(flat.select("token").distinct(), words).withColumn("is_word", F.lit(True))
    generic = one_of(F.col("token"), sorted(GENERIC_WORDS))
    is_word = F.coalesce("is_word", F.lit(False))
    distinct = (F.length("token") >= 3) & ~generic & ~is_word & ~F.col("token").rlike(r"^\d+$")
    flags = flat.join(common, "token", "left").groupBy("alias").agg(
        F.bool_or(distinct).alias("distinctive"), F.bool_and(generic | is_word).alias("plain"),
        F.bool_or(generic).alias("some_generic"))
    o = owners.join(flags, "alias")
    t, single = F.col("alias"), F.col("n") == 1
    risky = single & (~F.col("distinctive") | (F.length(t) <= 3) | one_of(t, sorted(surnames)))
    subject = (risky & (F.length(t) >= 3) & ~F.col("some_generic") & ~one_of(t, sorted(surnames))
               & ~one_of(t, sorted(PLACE_NAMES)) & ~one_of(t, sorted(ACRONYMS_NOT_FIRMS)) & (F.col("all_aum") > 0)
               & (F.col("top_aum") >= SUBJECT_DOMINANCE * F.col("all_aum")))
    tiny = F.forall("toks", lambda w: (F.length(w) <= 2) | w.isin("and", "of", "the"))
    rule = (F.when(one_of(t, sorted(stop)), "stop").when(subject, "subject").when(risky, "risky")
            .when(tiny, "tiny").when(one_of(t, sorted(PLACE_NAMES)), "place")
            .when(F.col("crds") == 1, "unique").when(F.col("fulls") == 1, "full_name")
            .when(F.col("distinctive") | ((F.col("n") >= 2) & ~F.col("some_generic")), "largest")
            .otherwise("ambiguous"))
    crd = F.when(rule == "full_name", F.col("full_crd")).when(
        rule.isin("unique", "largest", "subject"), F.col("top_crd"))
    return o.select("alias", crd.alias("crd"), F.when(rule == "subject", "subject").otherwise("any").alias("mode"), "n",
                    "plain", rule.alias("rule"), F.lit(False).alias("curated"))


def alias_dominance(advisers: DataFrame) -> DataFrame:
    """Share of an alias's assets held by its largest registrant."""
    pairs = alias_rows(advisers).groupBy("alias", "crd").agg(F.max("aum").alias("aum"))
    return pairs.groupBy("alias").agg(
        F.max_by("crd", F.struct("aum", "crd")).alias("crd"), F.max("aum").alias("top_aum"),
        F.sum("aum").alias("all_aum")).where("all_aum > 0").withColumn(
        "dominant", F.col("top_aum") >= SUBJECT_DOMINANCE * F.col("all_aum"))


def resolve_curated(curated: DataFrame, advisers: DataFrame) -> DataFrame:
    """Brand aliases -> crd by exact normalised registered name; crd is null when unresolved."""
    names = advisers.select("crd", F.explode(F.array_compact(F.array("legal_name", "business_name"))).alias("nm")).select(
        normal_name(F.col("nm")).alias("key"), "crd").groupBy("key").agg(F.min("crd").alias("crd"))
    c = curated.select("alias", normal_name(F.col("target")).alias("key"), normal_name(F.col("alias")).alias("norm"))
    return c.join(names, "key", "left").select("alias", "norm", "crd")


def dictionary(advisers: DataFrame, curated: DataFrame | None = None, words: DataFrame | None = None,
               stop: frozenset[str] = STOP_PHRASES, surnames: frozenset[str] = SURNAMES) -> DataFrame:
    """The alias table used for matching: generated aliases that have an owner, overridden by curated ones."""
    made = alias_owners(advisers, words, stop, surnames).where(F.col("crd").isNotNull()).drop("rule")
    if curated is None:
        return made
    own = resolve_curated(curated, advisers).where(F.col("crd").isNotNull() & (F.col("norm") != "")).select(
        F.col("norm").alias("alias"), "crd", F.lit("any").alias("mode"), F.size(F.split("norm", " ")).alias("n"),
        F.lit(False).alias("plain"), F.lit(True).alias("curated"))
    return made.join(own, "alias", "left_anti").unionByName(own)


# ---------------------------------------------------------------- text side
def _camel(w: Column) -> Column:
    return (F.length(w) >= 4) & w.rlike(r"^\p{L}+$") & w.rlike("[a-z][A-Z][a-z]") & ~w.rlike("^(?:Mc|Mac|De|La|Van)[A-Z]")


CROWDED = 32              # aliases that may travel with their first token; a token that starts more meets them by the whole alias
FILTER_BITS = 1 << 23     # bits of the filter of first tokens


def _may_start(heads: DataFrame) -> Column:
    """Whether `head` is among the first tokens of aliases, or, seldom, another one: a Bloom filter of two bits each, as one array of longs.

    It stands before the shuffle of tokens, so that everyday words stay where they are.
    """
    places = lambda h: (F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(FILTER_BITS)))
    word, bit = lambda at: F.floor(at / 64).cast("int"), lambda at: (at % 64).cast("int")
    at = heads.select(F.explode(F.array(*places(F.xxhash64("head")))).alias("at"))
    some = at.select(word(F.col("at")).alias("w"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = heads.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("w"))
    bits = every.join(some, "w", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bits"))
    bits = checkpointed(bits)  # a scalar subquery is planned once a use
    first, second = places(F.xxhash64("head"))
    return (F.bit_get(F.get(bits.scalar(), word(first)), bit(first)) == 1) & (F.bit_get(F.get(bits.scalar(), word(second)), bit(second)) == 1)


def dictionary_hits(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Token n-grams equal to an alias, with the context the guards need.

    Only tokens that start some alias are looked at. They bring the tokens an alias may reach and meet all aliases they start in one
    join; only tokens that start very many aliases meet them by the whole alias, to the lengths that aliases of this token have.
    """
    kept = [c for c in aliases.columns if c not in ("alias", "n")]
    head = F.substring_index("alias", " ", 1).alias("head")
    sizes = aliases.groupBy(head).agg(F.count(F.lit(1)).alias("many"), F.collect_set("n").alias("lengths"))
    sizes = checkpointed(sizes)
    crowded = sizes.where(F.col("many") > CROWDED)
    some_crowded = bool(crowded.take(1))
    own = aliases.select(head, F.struct("n", "alias", *kept).alias("c"))
    if some_crowded:
        own = own.join(small_side(crowded.select("head")), "head", "left_anti")
    heads = own.groupBy("head").agg(F.collect_list("c").alias("cands"), F.lit(None).cast(sizes.schema["lengths"].dataType).alias("lengths"))
    if some_crowded:
        heads = heads.unionByName(crowded.select("head", F.lit(None).cast(heads.schema["cands"].dataType).alias("cands"), "lengths"))
    heads = checkpointed(heads)
    reach = sizes.agg(F.max(F.array_max("lengths"))).first()[0] or 0
    toks = texts.select(key, spoken(F.col(text)).alias("o"))
    words = toks.select(key, "o", F.posexplode("o").alias("start", "w")).where(F.col("w") != BAR).withColumn("head", _norm(F.col("w")))
    side = small_side(heads)
    if side is heads:
        words = words.where(_may_start(heads))
    words = words.select(key, "start", "head", F.when(F.col("start") > 0, F.get("o", F.col("start") - 1)).alias("before"),
                         F.slice("o", F.col("start") + 1, F.lit(reach + 1)).alias("ahead"))
    starts = words.join(side, "head")
    gram = lambda n: F.array_join(F.transform(F.slice("ahead", F.lit(1), n), _norm), " ")

    def context(df: DataFrame) -> DataFrame:
        return df.select("alias", key, "start", "n", "before", F.slice("ahead", F.lit(1), F.col("n")).alias("span"),
                         F.get("ahead", F.col("n")).alias("after"), *kept)

    fits = F.filter("cands", lambda c: (c["n"] <= F.size("ahead")) & (gram(c["n"]) == c["alias"]))
    hits = context(starts.where(F.col("lengths").isNull()).select(key, "start", "before", "ahead", F.inline(fits)))
    if not some_crowded:
        return hits
    grams = starts.where(F.col("lengths").isNotNull()).select(key, "start", "before", "ahead", F.explode("lengths").alias("n")).where(
        F.col("n") <= F.size("ahead")).withColumn("alias", gram(F.col("n")))
    many = aliases.withColumn("head", head).join(small_side(crowded.select("head")), "head", "left_semi").drop("head", "n")
    return hits.unionByName(context(grams.join(small_side(many), "alias")))


def guarded(hits: DataFrame, given_names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """Keep hits whose context reads like the firm (subject rule, capitals, given names, trailing acronyms)."""
    first = F.get("span", F.lit(0))
    after, before = F.coalesce("after", F.lit("")), F.coalesce("before", F.lit(""))
    at_start = (F.col("start") == 0) | (before == BAR)
    shape = F.when(F.length("alias") <= 3, (first == F.upper(first)) & (first != F.lower(first))).otherwise(
        first.rlike(r"^\p{Lu}"))
    subject_ok = (at_start & one_of(_norm(after), sorted(SUBJECT_VERBS)) & shape) | _camel(first)
    acronym = after.rlike("^[A-Z]{2,5}$") & ~F.lower(after).isin(*LEGAL_TOKENS)
    runs_on = ~F.col("curated") & (F.col("n") >= 2) & F.col("plain") & acronym
    person = (F.col("n") == 1) & ~F.col("curated") & one_of(F.lower(before), sorted(given_names))
    capital = F.forall("span", lambda w: F.lower(w).isin(*CONNECTORS, "&") | w.rlike(r"^[\p{Lu}\p{Nd}]") | _camel(w))
    needs = (F.col("n") == 1) | F.col("curated") | F.col("plain")
    usual_ok = ~runs_on & ~person & (~needs | capital)
    return hits.where(F.when(F.col("mode") == "subject", subject_ok).otherwise(usual_ok))


def _longest(hits: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, m): per text the matches, longest first, no overlaps, without a match that starts where the one before it ends."""
    cols = ("alias", "crd", "curated", *more)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "start", (F.col("start") + F.col("n")).alias("end"), *cols)))
    found = hits.groupBy(key).agg(rows.alias("m"))
    kind = found.schema["m"].dataType
    kept = F.aggregate("m", F.array().cast(kind), lambda acc, x: F.when(
        F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.array_append(acc, x)))
    by_start = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"], x["end"], *[x[c] for c in cols])))
    found = found.select(key, by_start.alias("m"))
    last = F.filter("m", lambda x, i: (i == 0) | (F.get(F.col("m"), F.greatest(i - 1, F.lit(0)))["end"] != x["start"]))
    return found.select(key, last.alias("m"))


def longest_matches(hits: DataFrame, key: str) -> DataFrame:
    """Per text: longest first, no overlaps, then drop a match that starts where the one before it ends."""
    return _longest(hits, key).select(key, F.inline("m")).withColumnRenamed("start", "start_token").withColumnRenamed("end", "end_token")


def match(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, start_token, end_token, alias, crd, curated) rows."""
    return longest_matches(guarded(dictionary_hits(texts, key, text, aliases)), key)


def _named(aliases: DataFrame, advisers: DataFrame) -> DataFrame:
    """Aliases with the names of their firms, stored: they are read several times, and a dimension of few files would be tidied by few tasks each time."""
    names = advisers.select("crd", F.coalesce("business_name", "legal_name").alias("name")).repartition("crd").withColumn("name", pretty_name(F.col("name")))
    return checkpointed(aliases.join(names, "crd", "left"))


def _verified(texts: DataFrame, key: str, text: str, named: DataFrame, body: bool) -> DataFrame:
    """(key, m): the matches of a text field with the names of their firms. In teasers a single-word generated alias does not count."""
    found = _longest(guarded(dictionary_hits(texts, key, text, named)), key, "name")
    counts = lambda x: x["name"].isNotNull() & ((F.contains(x["alias"], F.lit(" ")) | x["curated"]) if body else F.lit(True))
    return found.select(key, F.filter("m", counts).alias("m")).where(F.size("m") > 0)


def subjects(texts: DataFrame, key: str, text: str, matches: DataFrame) -> DataFrame:
    """(key, subject_crd): the matched firm that opens the headline, after a leading label in the first six tokens."""
    toks = spoken(F.col(text))
    bars = F.array_max(F.filter(F.transform(F.slice(toks, 1, 6), lambda t, i: F.when(t == BAR, i + 1)), lambda v: v.isNotNull()))
    begin = texts.select(key, F.coalesce(bars, F.lit(0)).alias("start_token"))
    return matches.select(key, "start_token", F.col("crd").alias("subject_crd")).join(begin, [key, "start_token"]).select(
        key, "subject_crd")


# ---------------------------------------------------------------- names outside the dictionary
# fixed values: words that make a capitalised span a firm, words too common to name one, words that end a span
FIRM_WORDS = """
wealth capital advisors advisers advisor adviser advisory partners financial group management private asset assets
investments investment llc inc family office
""".split()
SPAN_GENERIC = FIRM_WORDS + "the global national first new american us u.s. united states and & of".split()
SPAN_BREAKS = """
a an the and or but to with in for from at on by as after amid over into via vs vs. its his her their our this that these
who which acquires acquire acquired acquiring acquisition buys buy bought sells sell sold sale merges merge merger merging
takes take stake joins join joined hires hire hired names named adds add added launches launch launched unveils unveil
debuts rolls expands expand opens open completes complete closes lands land makes make agrees agree be is are was were has
have had will says said say plans plan announces announce reports report sees see gets wins loses leaves departs exits
moves move breaks break away jumps taps appoints promotes retires steps down fined fines charges charged sues sued settles
bars barred backs backed invests minority majority strategic deal deals team teams ceo cio coo cfo president chief head
chair founder co-founder partner why how what when where new former ex exclusive breaking update q&a podcast video webinar
etf etfs fund funds pair two three four five record top best announcement portland strikes recapitalization recap
investing can could should would may might must use uses get keep keeps need needs want wants do does know tell buying
selling hiring growing building tips lessons ways outlook q1 q2 q3 q4
""".split()
_ABBREVIATIONS = ("inc", "corp", "ltd", "llc", "co", "jr", "sr", "bros")
_CHUNK = r"[,;:()\[\]|!?\"“”]|\s[-–—]\s|—|–"
_CAPITAL = r"^(?:[A-Z][\p{L}\p{N}_.&'’-]*|[A-Z0-9]{2,}[\p{L}\p{N}_&-]*)$"
# every word that a rule of spans knows
SPAN_KNOWN = known_words(FIRM_WORDS, SPAN_GENERIC, SPAN_BREAKS, _ABBREVIATIONS, LEAD_WORDS, UNIT_SCALE, "backed, based")
_SPAN_LEAD = rf"(?i)^(?:(?:{one_phrase(LEAD_WORDS)}|[\w-]+-backed|[\w-]+-based)\s+)+"


def firm_spans(text: Column) -> Column:
    """array<string> of capitalised spans that hold a firm word and a distinctive word."""
    mark = "\u0001"
    words = F.filter(F.split(F.regexp_replace(text, _CHUNK, f" {mark} "), r"\s+"), lambda w: w != "")

    def describe(raw: Column) -> Column:
        core = F.rtrim(raw, F.lit(".'’"))
        closed = (raw.rlike(r"\.$") & (F.length(core) > 3) & ~F.lower(core).isin(*_ABBREVIATIONS)
                  & ~F.contains(core, F.lit(".")))
        w = F.btrim(raw, F.lit(".'’"))
        owned = w.rlike("['’]s$")
        w = F.when(owned, F.regexp_replace(w, "['’]s$", "")).otherwise(w)
        name = w.rlike(_CAPITAL) & ~one_of(F.lower(w), SPAN_BREAKS) & ~raw.rlike("^" + FIGURE.replace("(?i)", "(?i:", 1) + ")")
        return F.struct(w.alias("w"), name.alias("name"), (closed | owned).alias("ends"), raw.rlike(_CAPITAL).alias("cap"),
                        F.lower(w).isin("&", "of").alias("link"))

    described = F.transform(words, describe)
    linked = let(described, lambda all_: F.transform(all_, lambda d, i: F.struct(
        d["w"], d["name"], d["ends"], (d["link"] & F.coalesce(F.get(all_, i + 1)["cap"], F.lit(False))).alias("link"))))
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("cur"), F.array().cast("array<array<string>>").alias("spans"))

    def step(acc: Column, d: Column) -> Column:
        grown = F.array_append(acc["cur"], d["w"])
        flushed = F.when(F.size(acc["cur"]) > 0, F.array_append(acc["spans"], acc["cur"])).otherwise(acc["spans"])
        return (F.when((F.size(acc["cur"]) > 0) & d["link"], F.struct(grown.alias("cur"), acc["spans"].alias("spans")))
                .when(d["name"] & d["ends"], F.struct(nothing.alias("cur"), F.array_append(acc["spans"], grown).alias("spans")))
                .when(d["name"], F.struct(grown.alias("cur"), acc["spans"].alias("spans")))
                .otherwise(F.struct(nothing.alias("cur"), flushed.alias("spans"))))

    spans = F.aggregate(linked, start, step, lambda acc: F.when(
        F.size(acc["cur"]) > 0, F.array_append(acc["spans"], acc["cur"])).otherwise(acc["spans"]))

    def name_words(span: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.array_join(span, " "), _SPAN_LEAD, ""), r"\s+"), lambda w: w != "")

    def up_to_firm_word(w: Column) -> Column:
        last = F.array_max(F.filter(positions(w), lambda i: one_of(F.lower(F.get(w, i)), FIRM_WORDS)))
        return F.when(last.isNull(), nothing).otherwise(F.slice(w, F.lit(1), last + 1))

    def ok(w: Column) -> Column:
        last = F.lower(F.try_element_at(w, F.lit(-1)))
        return ((F.size(w) > 0) & (F.size(w) <= 6) & F.exists(w, lambda x: ~one_of(F.lower(x), SPAN_GENERIC))
                & ~last.isin("family", "advisor", "adviser"))

    def tidy(w: Column) -> Column:
        name = F.regexp_replace(F.array_join(w, " "), r"(?i)[\s,]+(?:llc|inc|co|corp|l\.l\.c|lp|ltd)\.?$", "")
        return F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" .,'’"))

    return F.transform(F.filter(F.transform(F.transform(spans, name_words), up_to_firm_word), ok), tidy)


def span_names(texts: DataFrame, key: str, text: str, stop: frozenset[str] = STOP_PHRASES) -> DataFrame:
    """(key, pos, name) rows of unverified firm names, stop phrases removed, first mention only."""
    read = lambda forms, t: forms.withColumn("_spans", F.array_distinct(firm_spans(F.col(t))))
    found = by_form(texts.select(key, text), text, SPAN_KNOWN, read, lambda c: F.transform(c, restored))
    names = found.select(key, F.posexplode("_spans").alias("pos", "name"))
    return names.where(~one_of(F.lower("name"), sorted(stop)))


LINK = "struct<pos:int,name:string,crd:string>"


def _links(texts: DataFrame, key: str, text: str, named: DataFrame, body: bool = False) -> DataFrame:
    """(key, links): per text its firms as array<struct<pos, name, crd>>. Everything after the join with the dictionary happens in one row
    a text, so texts are shuffled by their key once."""
    m = _verified(texts, key, text, named, body)
    spans = span_names(texts, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("spans"))
    crds = F.array_distinct(F.transform("m", lambda x: x["crd"]))
    of = lambda crd: F.filter("m", lambda x: x["crd"] == crd)
    sure = F.transform(crds, lambda c: F.struct(
        F.array_min(F.transform(of(c), lambda x: x["start"])).cast("int").alias("pos"), F.get(of(c), F.lit(0))["name"].alias("name"), c.alias("crd")))
    covered = F.array_distinct(F.flatten(F.transform("m", lambda x: F.array(x["alias"], normal_name(x["name"])))))
    norm = lambda x: F.array_join(normal_tokens(x["name"]), " ")
    free = F.filter("spans", lambda x: let(norm(x), lambda n: ~F.exists("covered", lambda a: F.contains(n, a) | F.contains(a, n))))
    more = F.transform(free, lambda x: F.struct((x["pos"] + 100000).cast("int").alias("pos"), x["name"], F.lit(None).cast("string").alias("crd")))
    none = F.array().cast(f"array<{LINK}>")
    both = m.join(spans, key, "full").withColumn("covered", F.when(F.col("spans").isNotNull(), F.coalesce(covered, F.array().cast("array<string>"))))
    return both.select(key, F.concat(F.coalesce(sure.cast(f"array<{LINK}>"), none), F.coalesce(more.cast(f"array<{LINK}>"), none)).alias("links"))


def links_in(texts: DataFrame, key: str, text: str, aliases: DataFrame, advisers: DataFrame,
             body: bool = False) -> DataFrame:
    """Firms of one text field: verified ones first, then spans that are no part of a verified name.

    In teasers (`body`) a single-word generated alias does not count.
    """
    return _links(texts, key, text, _named(aliases, advisers), body).select(key, F.inline("links")).select(key, "pos", "name", "crd")


def _by_text(items: DataFrame, key: str, text: str, read) -> DataFrame:
    """What `read(texts, key, text)` finds, for every key: each distinct text is read once, as teasers repeat."""
    texts = checkpointed(items.where(F.col(text).isNotNull()).select(text).distinct().withColumn("_no", F.monotonically_increasing_id()))
    found = checkpointed(read(texts, "_no", text).join(texts, "_no").drop("_no"))
    return items.select(key, text).join(small_side(found), text).drop(text)


def item_links(items: DataFrame, aliases: DataFrame, advisers: DataFrame, key: str = "id") -> DataFrame:
    """Firms of title then description, one row per firm and item, with `in_title`."""
    named = _named(aliases, advisers)
    head = _links(items, key, "title", named)
    body = _by_text(items, key, "description", lambda t, k, c: _links(t, k, c, named, body=True).where(F.size("links") > 0)).withColumnRenamed("links", "more")
    none = F.array().cast(f"array<{LINK}>")
    marked = lambda c, title: F.transform(F.coalesce(c, none), lambda x: F.struct(
        F.coalesce(x["crd"], F.lower(x["name"])).alias("firm_key"), (x["pos"] + (0 if title else 1000000)).cast("int").alias("pos"),
        x["name"], x["crd"], F.lit(title).alias("in_title")))
    both = head.join(body, key, "full").select(key, F.concat(marked(F.col("links"), True), marked(F.col("more"), False)).alias("l"))
    of = lambda k: F.filter("l", lambda x: x["firm_key"] == k)
    rows = F.transform(F.array_distinct(F.transform("l", lambda x: x["firm_key"])), lambda k: let(of(k), lambda own: F.struct(
        k.alias("firm_key"), F.array_min(F.transform(own, lambda x: F.struct(x["pos"], x["name"], x["crd"]))).alias("f"),
        F.exists(own, lambda x: x["in_title"]).alias("in_title"))))
    return both.select(key, F.inline(rows)).select(key, "firm_key", "f.name", "f.crd", "f.pos", "in_title")


def item_crds(items: DataFrame, aliases: DataFrame, advisers: DataFrame, key: str = "id") -> DataFrame:
    """(key, crd): the verified firms of title and description, for results that need no other names; an item may have a firm twice."""
    named = _named(aliases, advisers)
    crds = lambda t, k, c, body: _verified(t, k, c, named, body).select(k, F.array_distinct(F.transform("m", lambda x: x["crd"])).alias("crds"))
    head = crds(items, key, "title", False)
    body = _by_text(items, key, "description", lambda t, k, c: crds(t, k, c, True))
    return head.unionByName(body).select(key, F.explode("crds").alias("crd"))


# ---------------------------------------------------------------- watchlists
def watch_terms(watchlist: DataFrame) -> DataFrame:
    """(name, term): name and aliases of at least three non-space characters, once per spelling."""
    terms = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))),
                        lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    long = F.filter(terms, lambda t: F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 3)
    rows = watchlist.select("name", F.posexplode(long).alias("pos", "term"))
    return rows.groupBy("name", F.lower("term").alias("low")).agg(F.min_by("term", "pos").alias("term")).select("name", "term")


def watch_tokens(text: Column) -> Column:
    """Tokens for watch terms: runs of word characters, '&' and inner hyphens, lower case, possessive dropped."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_&]+(?:-[\p{L}\p{N}_&]+)*"), 0), lambda t: t)


def watch_hits(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, name) pairs whose text holds a watch term on word boundaries.

    Only tokens that start a term are expanded, to the lengths of the terms they start, and joined on the whole term.
    """
    t = terms.select("name", F.array_join(watch_tokens(F.col("term")), " ").alias("gram"), F.size(
        watch_tokens(F.col("term"))).alias("n"))
    t = t.where("n > 0")
    heads = checkpointed(t.groupBy(F.substring_index("gram", " ", 1).alias("head")).agg(F.collect_set("n").alias("lengths")))
    reach = heads.agg(F.max(F.array_max("lengths"))).first()[0] or 0
    toks = texts.select(key, watch_tokens(F.col(text)).alias("o"))
    words = toks.select(key, "o", F.posexplode("o").alias("i", "head"))
    side = small_side(heads)
    if side is heads:
        words = words.where(_may_start(heads))
    # a token brings the tokens a term may reach, not its whole text
    starts = words.select(key, "head", F.slice("o", F.col("i") + 1, F.lit(reach)).alias("ahead")).join(side, "head")
    grams = starts.select(key, "ahead", F.explode("lengths").alias("n")).where(F.col("n") <= F.size("ahead")).select(
        key, F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("gram"))
    return grams.join(small_side(t.select("name", "gram")), "gram").select(key, "name").distinct()


def watch_advisers(terms: DataFrame, advisers: DataFrame) -> DataFrame:
    """(name, crd): advisers whose normalised name equals a term or starts with it on a word boundary.

    Every word-boundary prefix of an adviser name is a key, so this is an equi-join.
    """
    simple = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))
    t = terms.select("name", simple(F.col("term")).alias("prefix")).distinct()
    names = advisers.select("crd", F.explode(F.array_compact(F.array(
        pretty_name(F.col("business_name")), pretty_name(F.col("legal_name"))))).alias("nm")).withColumn(
        "w", F.split(simple(F.col("nm")), " "))
    prefixes = names.select("crd", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(
        F.slice("w", F.lit(1), k), " "))).alias("prefix")).distinct()
    return prefixes.join(small_side(t), "prefix").select("name", "crd").distinct()


# ---------------------------------------------------------------- evaluation
def quality(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of predicted against expected key rows."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    e = expected.select(*keys).distinct().withColumn("e", F.lit(True))
    c = p.join(e, keys, "full").agg(
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return c.select("tp", "fp", "fn", F.round(pr, 3).alias("precision"), F.round(rc, 3).alias("recall"), F.round(f1, 3).alias("f1"))
