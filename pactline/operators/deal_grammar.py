"""Headlines as typed tokens, and frames that read a deal from the types.

Every token of a headline gets one letter for what it can do in an announcement (a buying verb, an agreement, a preposition, a
capitalised word ...), so a headline is a short string of letters beside its tokens. A frame is a pattern over that string: parts
that follow one another, each a party in a role (acquirer `a`, target `b`, seller `s`) or a cue (`.`). The length of a part is its
number of tokens, so a party is a slice of the token array. Words are looked up once per token however many frames there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.phrases import listed

# Letters of the cue alphabet with their words. The words are fixed values.
TYPES: dict[str, str] = {
    "b": "acquire, acquires, buy, buys, purchases",
    "2": "acquiring, buying",
    "3": "take-private",
    "B": "acquired, bought, purchased, taken",
    "p": "purchase",
    "g": "snaps, snap, scoops, scoop, gobbles, gobble, swoops, swoop, picks, carve, carves",
    "T": "take, takes, taking",
    "s": "sell, sells, selling, divest, divests, offload, offloads, unload, unloads",
    "Z": "sold",
    "m": "merge, merges, merging, combine, combines, combining",
    "M": "merger, combination, mergers",
    "R": "recapitalizes",
    "r": "recapitalization, recap",
    "d": "acquisition, takeover, buyout",
    "1": "deal, tie-up",
    "l": "sale",
    "G": "agreement",
    "o": "bid, offer, proposal, approach, offers, bids",
    "h": "stake, investment",
    "a": "agree, agrees, agreed",
    "c": "complete, completes, completed, close, closes, closed, finalize, finalizes, consummate, consummates, seal, seals, wraps",
    "n": """announce, announces, enter, enters, sign, signs, reach, reaches, strike, strikes, ink, inks, cut, cuts, pens, unveils, make, makes,
        launch, launches, submit, submits, table, tables, notches""",
    "w": "adds, add, lands, land, snags, nabs, grabs",
    "q": "wins, gets, receives, secures, obtains, accepts",
    "W": "raises, sweeten, sweetens",
    "X": "reject, rejects, rejected, rebuff, rebuffs, spurn, spurns",
    "L": "leads, led, backs, backed",
    "K": "paid, pays, spends, spent, spending, pay",
    "E": "expands, moves, grows",
    "v": "be, being, been, is, are, was, will, has, have, plans, set",
    "u": "reportedly, confirms, says, said, it",
    "V": "talks, discussions",
    "Y": "near, nears, nearing",
    "P": "approval, clearance, nod, green-light",
    "t": "to", "y": "by", "f": "from", "i": "with, via", "e": "of", "I": "in, into", "F": "for", "&": "and, &", "O": "on", "4": "over", "H": "about, approves, clears, probes", "5": "not, never",
    "k": "up, out, private",
    "A": "a, an, the, its, their",
    "J": """minority, majority, strategic, significant, controlling, non-controlling, noncontrolling, growth, equity, definitive, binding, pending,
        proposed, planned, historic, long-awaited, blockbuster, landmark, advanced, exclusive, early, all-cash, all-stock""",
    "j": "itself, firm, business, company",
    "D": "double, triple, dual, double-deal, triple-deal, dual-deal, two-firm, three-firm, multi-firm, hat, hat-trick",
}
_MONEY = r"^[$][\d.,]+\S*$"
_UNIT = "million, billion, trillion, bn, mn, mm, b, m, tn"


def tokens(text: Column) -> Column:
    """Words, with the punctuation that ends a clause and a possessive ending as tokens of their own."""
    t = F.regexp_replace(text, r"(['’]s)(?=[\s,;:)]|$)", " $1")
    t = F.regexp_replace(t, r"([,;:)]|\.\.\.)(?=\s|$)", " $1")
    t = F.regexp_replace(t, r"(?<=^|\s)([(])", "$1 ")
    return F.filter(F.split(F.regexp_replace(t, "([—–])", " $1 "), r"\s+"), lambda w: w != "")


ENDS = (",", ";", ":", "(", ")", "-", "–", "—", "...")
POSSESSIVE = ("'s", "’s")


def bare(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(".!\"“”'‘’")))


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(what: str, words) -> str:
    """SQL: whether `what` is one of the words (a list, or comma-separated text)."""
    return f"{what} IN ({', '.join(text(w) for w in (listed(words) if isinstance(words, str) else words))})"


def like(what: str, pattern: str) -> str:
    return f"{what} RLIKE {text(pattern)}"


def lettered(words: str, cases: list[tuple[str, str]], rest: str = "x") -> Column:
    """One letter per token of the array column `words`, as one string: that of the first SQL condition on `w` (the token) and `low`
    (its bare form, computed once) that holds. Written as SQL text: word lists as columns would take seconds to build."""
    low = f"lower(trim(BOTH {text('.!“”‘’' + chr(34) + chr(39))} FROM w))"
    tests = " ".join(f"WHEN {condition} THEN {text(letter)}" for condition, letter in cases)
    return F.expr(f"array_join(zip_with({words}, transform({words}, w -> {low}), (w, low) -> CASE {tests} ELSE '{rest}' END), '')")


def typed(words: str, table: dict[str, str]) -> Column:
    """The letters of the cue alphabet; # numbers, N capitalised words."""
    signs = [(f"{like('w', _MONEY)} OR {among('low', _UNIT)}", "$"), (like("w", r"^\d[\d.]*%$"), "%"), (among("w", POSSESSIVE), "'"),
             (among("w", ENDS), ","), (like("w", r"^[\d.,]+(?:st|nd|rd|th)?$"), "#"),
             (like("w", r"^(?:[\p{Lu}\d“\"]|\p{Ll}+\p{Lu})"), "N")]
    return lettered(words, [(among("low", listing), letter) for letter, listing in table.items()] + signs)


@dataclass(frozen=True)
class Frame:
    kind: str
    roles: str  # one sign per part: a, b, s or '.'
    parts: tuple[str, ...]
    strength: str = ""  # 'plain' frames need a valid object, 'weak' ones a firm

    @property
    def pattern(self) -> str:
        return "^" + "".join(f"({p})" for p in self.parts)


def frame(kind: str, roles: str, *parts: str, strength: str = "") -> Frame:
    return Frame(kind, roles, parts, strength)


_SOME, _REST, _NAME = "[^5]+?", ".+", "[Nh]+"
_MODAL = "(?:at|vat|vt|t|v)?"  # to, agrees to, has agreed to, will
_TALK = "[vu]*(?:IJ*V|YA?1?|ctA?1|nIA?J*G|[nw]A?J*[G1]|a)"  # in talks, near a deal, close to a deal, has an agreement
_BUY = "(?:b|p|3|[gT]k|gO|T4)"
_TAKEOVER = "[dMp31]"
DEAL = "acquisition"

FRAMES: list[Frame] = [
    # the target is the subject
    frame(DEAL, "b.a", _SOME, f"(?:{_TALK})?[vu]*t?v+(?:Bk?y|Zt)", _REST),
    frame(DEAL, "b.", _SOME, f"(?:{_TALK})?[vu]*t?v+Bk?(?=[FIf,]|$)"),
    frame(DEAL, "b.a", _SOME, "By", _REST),
    frame(DEAL, "b.a", _SOME, "XA?.{0,4}?of", _REST),
    frame(DEAL, "b.", _SOME, "atA?[$]*(?:31|[dpl3])(?!e)"),
    frame(DEAL, "b.a", _SOME, "(?:(?:at|t)?s|Z)j?t", _REST),
    # stakes, before a seller's unit can be read from 'sells a stake to'
    frame("stake", "b.a", _SOME, "(?:at|t)?sA?%?J*ht", _REST),
    # a seller hands a unit to a buyer
    frame(DEAL, "s.b.a", _SOME, "(?:at|t)?s|Z|cA?le", _SOME, "t", "[^b].*"),
    frame(DEAL, "a.b.s", _SOME, "t?b", _SOME, "f", _REST),
    frame("stake", "a.b", _SOME, "(?:at|t)?[TbnpB]A?%?J*hI", _REST),
    frame("stake", "b.a", _SOME, "[wqnT]A?J*hf", _REST),
    frame("recapitalization", "b.a", _SOME, "(?:[cn]?A?r(?:i|Ly)|Ri)", _REST),
    frame("recapitalization", "a.b", _SOME, "[Lc]A?re", _REST),
    # mergers
    frame("merger", "a.b.", _SOME, "&|,&?", _SOME, "(?:[atv]*m|[nc]A?[^,]?M|IMV|M)(?![ei])"),
    frame("merger", "a.b.", _SOME, "&|,&?", _SOME, "[atv]*m(?=t|I|$)"),
    frame("merger", "a.b", _SOME, "(?:at|t|v)*mi|[cn]A?J*MG?i|nI?A?J*Gtmi", _REST),
    # agreements, completions, bids and talks
    frame(DEAL, "a.b", _SOME, f"(?:[nw]I?|I)A?J*[GM]*[G1]t{_BUY}", _REST),
    frame(DEAL, "a.", _SOME, "[wcn].{0,14}?(?:D1|1D|D(?=[FI,]|$))"),
    frame(DEAL, "a.b", _SOME, f"(?:[cn]|at)A?(?:[xN]eA?)?J*[$]*[^,it]{{0,4}}?[dMp3](?:[eiF]|t{_BUY})", _REST),
    frame(DEAL, "a.b", _SOME, f"(?:[cnw]|at)A?J*[$]*[^,it]{{0,3}}?1(?:t[Nx])?(?:i|t{_BUY})", _REST),
    frame(DEAL, "a.b.", _SOME, "(?:c|[qn]PF)A?J*[$]*", _NAME, _TAKEOVER),
    frame(DEAL, "a.b.", _SOME, "[nwE][^i]{0,8}i[$]*", _NAME, _TAKEOVER),
    frame(DEAL, "a.b", _SOME, "[wE][^i]{0,8}i[$]+", _REST),
    frame(DEAL, "a.b.", "[N&]+", "x[^i]{0,8}i[$]*", _NAME, "[dMp1]b?$"),
    frame(DEAL, ".a.b.", "(?:.*[OFeI4HL])??", "[N&]+", "'J*[$]*", _NAME, _TAKEOVER),
    frame(DEAL, "a.b", _SOME, f"[vu]*(?:IJ*V|YA?1|ctA?1)(?:t{_BUY}|F|i|4|tmi)", _REST),
    frame(DEAL, "a.b.", _SOME, "W", _SOME, "[dM]?o"),
    frame(DEAL, "a.b", _SOME, f"[nWo]A?[^,]{{0,3}}?o(?:F|t{_BUY})", _REST),
    frame(DEAL, "a.b", _SOME, f"q.{{0,3}}?P[tF](?:{_BUY}|mi)", _REST),
    frame(DEAL, "a.b", _SOME, f"[uv]+a?[vu]*(?:t?{_BUY}|2)", _REST),
    frame(DEAL, "a.b", _SOME, f"v*[tv]*K[$]+[x]?(?:F|t{_BUY})", _REST),
    # trade-press forms
    frame(DEAL, "a.b", "[N&]+", "'[N#xJ]?[dp1][veF,]+", _REST),
    frame(DEAL, ".a.b", "(?:.*[^N])??", "N{1,4}", "[bpd3]e", _REST),
    # the plain verbs, last
    frame(DEAL, "a.b", _SOME, f"{_MODAL}(?:{_BUY}|B|cO|cpe)", _REST, strength="plain"),
    frame(DEAL, "a.b", _SOME, "t?w", _REST, strength="weak"),
]


def read(f: Frame, code: str) -> str:
    """SQL: struct<kind, strength, a, b, s>; a role is its first token and number of tokens, (1, 0) where it is missing. Null: no fit."""
    sizes = [f"length(regexp_extract({code}, {text(f.pattern)}, {i + 1}))" for i in range(len(f.parts))]
    at = {role: f"named_struct('start', {' + '.join(['1', *sizes[:i]])}, 'size', {sizes[i]})" for i, role in enumerate(f.roles)}
    roles = ", ".join(f"'{r}', {at.get(r, _MISSING)}" for r in "abs")
    return f"CASE WHEN {like(code, f.pattern)} THEN named_struct('kind', '{f.kind}', 'strength', '{f.strength}', {roles}) END"


_MISSING = "named_struct('start', 1, 'size', 0)"


def readings(frames: list[Frame], code: str) -> Column:
    """The frames that fit, in their order."""
    return F.expr(f"array_compact(array({', '.join(read(f, code) for f in frames)}))")


def first_reading(frames: list[Frame], code: str) -> Column:
    return F.expr(f"coalesce({', '.join(read(f, code) for f in frames)})")


def phrase(words: Column) -> Column:
    """Tokens as text again: punctuation and possessive endings join the word before them."""
    return F.regexp_replace(F.array_join(words, " "), r" (['’]s|[,;:)]|\.\.\.)(?=\s|$)", "$1")
