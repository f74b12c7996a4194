"""Word lists and rule tables. Everything here can be replaced by a caller's own table or file."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

WEALTH = "Wealth Management & RIAs"
ASSET_MANAGERS = "Private Equity & Asset Management"
AUM_INDUSTRIES = (WEALTH, ASSET_MANAGERS)
DEFAULT_INDUSTRY = "Other"

# Default industry rules in rank order: (name, phrases that tag it, phrases that veto it). They cover the plain
# vocabulary; a fuller file (with company names) is read by `industry_rules(path)`.
INDUSTRIES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("Investment Banking", ("investment bank", "investment banks", "investment banking", "m&a advisory",
                            "broker-dealer", "broker dealer", "capital markets firm", "sell-side"), ()),
    (WEALTH, ("ria", "rias", "wealth management", "wealth manager", "wealth managers", "wealth advisor",
              "wealth advisors", "wealth firm", "financial advisor", "financial advisors", "advisory practice",
              "family office", "multifamily office", "private wealth", "registered investment adviser"), ()),
    ("Banking", ("bank", "banks", "bancorp", "bancshares", "banking", "credit union", "credit unions", "thrift"),
     ("investment bank", "investment banks", "investment banking", "boutique bank", "food bank", "data bank",
      "blood bank")),
    ("Insurance", ("insurance", "insurer", "insurers", "insurtech", "reinsurance", "reinsurer", "underwriter",
                   "annuity", "annuities", "p&c"), ()),
    ("Fintech & Payments", ("fintech", "payments", "payment", "card issuer", "crypto", "stablecoin", "bitcoin",
                            "neobank", "wealthtech"), ()),
    (ASSET_MANAGERS, ("private equity", "pe firm", "pe-backed", "buyout", "take-private", "private credit",
                      "asset manager", "asset managers", "asset management", "hedge fund", "investment firm",
                      "fund manager", "gp stake", "carve-out"), ()),
    ("Healthcare & Life Sciences", ("health", "healthcare", "health care", "hospital", "hospitals", "clinic",
                                    "medical", "medtech", "pharma", "biotech", "therapeutics", "drug", "oncology",
                                    "diagnostics", "dental", "vaccine"), ()),
    ("Technology", ("software", "saas", "tech", "technology", "ai", "artificial intelligence", "cybersecurity",
                    "cloud", "data center", "data centers", "semiconductor", "chip", "chipmaker", "analytics",
                    "robotics"), ()),
    ("Energy & Utilities", ("energy", "oil", "natural gas", "pipeline", "midstream", "utility", "utilities", "power",
                            "solar", "wind", "renewable", "nuclear", "grid", "hydrogen"), ()),
    ("Industrials", ("industrial", "manufacturing", "manufacturer", "aerospace", "defense", "logistics", "freight",
                     "shipping", "rail", "airline", "automotive", "construction", "chemicals", "packaging", "steel",
                     "mining", "machinery", "equipment"), ()),
    ("Consumer & Retail", ("retail", "retailer", "restaurant", "restaurants", "food", "beverage", "apparel",
                           "fashion", "consumer", "grocery", "beauty", "hotel", "hotels", "travel", "e-commerce",
                           "furniture", "toys"), ()),
    ("Real Estate", ("real estate", "reit", "reits", "property", "properties", "apartments", "multifamily",
                     "homebuilder", "housing", "self-storage", "landlord"),
     ("multifamily office", "multi-family office", "intellectual property")),
    ("Media & Telecom", ("media", "telecom", "wireless", "broadband", "cable", "studio", "streaming", "publisher",
                         "newspaper", "television", "radio", "music", "gaming", "advertising"), ()),
    ("Business Services", ("staffing", "consulting", "consultancy", "accounting", "cpa", "law firm", "outsourcing",
                           "payroll", "education", "training", "professional services", "business services"), ()),
]

# fixed values: words that never make a firm name by themselves
GENERIC_WORDS = frozenset("""
wealth capital advisors advisor advisers adviser advisory partners partner financial finance group management managers
private asset assets investment investments investors investor family office offices planning planners planner
consulting consultants services service strategies strategy securities trust trustco company co and of the llc inc
lp llp ltd corp corporation holdings holding global national international america american americas us usa united
states retirement fund funds equity counsel associates solutions bank banking research portfolio portfolios markets
market fiduciary fiduciaries wealthcare pllc pc plc na n a inv mgmt mgt grp svcs for in first new firm firms investing
""".split())

# fixed values: places that, alone, mean the place and not a firm
PLACE_NAMES = frozenset(p.strip() for p in """
alabama, alaska, arizona, arkansas, california, colorado, connecticut, delaware, florida, georgia, hawaii, idaho,
illinois, indiana, iowa, kansas, kentucky, louisiana, maine, maryland, massachusetts, michigan, minnesota,
mississippi, missouri, montana, nebraska, nevada, new hampshire, new jersey, new mexico, new york, north carolina,
north dakota, ohio, oklahoma, oregon, pennsylvania, rhode island, south carolina, south dakota, tennessee, texas,
utah, vermont, virginia, washington, west virginia, wisconsin, wyoming, carolina, carolinas, dakota, new england,
midwest, pacific northwest, northwest, southwest, southeast, northeast, gulf coast, wall street, main street,
park avenue, long island, silicon valley, chicago, boston, atlanta, dallas, houston, austin, denver, seattle,
portland, phoenix, miami, philadelphia, pittsburgh, cleveland, detroit, minneapolis, st louis, nashville, charlotte,
san francisco, los angeles, san diego, las vegas, salt lake, kansas city, baltimore, manhattan, brooklyn, boise,
spokane, tacoma, omaha, tulsa, cincinnati, columbus, indianapolis, milwaukee, richmond, raleigh, tampa, orlando,
jacksonville, new orleans, san antonio, sacramento, honolulu
""".replace("\n", " ").split(","))

# fixed values: verbs that may follow a subject-only alias, and acronyms that are never an adviser
SUBJECT_VERBS = frozenset("""
adds add acquires acquire buys buy hires hire lands names taps opens expands agrees completes announces sells
merges partners joins promotes appoints raises closes invests poaches recruits loses unveils launches debuts
strikes inks nabs snags bolsters welcomes grabs picks takes files settles
""".split())
ACRONYMS_NOT_FIRMS = frozenset("""
sec finra dol irs cftc fdic occ fed nasaa cfpb etf etfs ria rias ipo ceo cio cfo coo ai us uk eu gdp cpi fomc nyse
otc amex bd bds hnw uhnw esg
""".split())
SUBJECT_DOMINANCE = 0.85

# Everyday coinages treated as dictionary words even without a dictionary table.
EXTRA_WORDS = frozenset("""
lifestyle saas fintech wealthtech insurtech regtech crypto bitcoin blockchain esg online website podcast webinar
startup ecosystem
""".split())

# Defaults for the two name tables; callers pass their own fuller tables as parameters.
SURNAMES = frozenset("""
smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez wilson anderson thomas
taylor moore jackson martin lee perez thompson white harris clark lewis robinson walker young allen king wright scott
torres hill green adams nelson baker hall campbell mitchell carter roberts phillips evans turner parker collins
edwards stewart morris murphy cook rogers morgan cooper peterson bailey reed kelly howard cox ward richardson watson
brooks wood bennett gray james hughes price myers long ross foster powell sullivan russell fisher henderson cole
""".split())
GIVEN_NAMES = frozenset("""
james john robert michael david richard joseph thomas charles christopher daniel matthew anthony steven paul andrew
joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric jonathan stephen
larry justin scott brandon benjamin samuel gregory patrick raymond jack dennis jerry peter jim mike tom dan steve
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy sandra ashley emily donna michelle
""".split())

# fixed values: phrases that are never a firm
STOP_PHRASES = frozenset("""
financial advisor|financial advisors|financial advisor magazine|financial planning|financial planning association|
investment news|investmentnews|wealth management|wealthmanagement.com|private wealth|private equity|private credit|
private markets|private capital|asset management|family office|family offices|capital markets|capital gains|
financial group|wealth advisors|investment advisers act|investment advisers|investment adviser|
registered investment advisers|financial services|financial industry regulatory authority|
securities and exchange commission|wealth tech|social security|top ria|next gen|barron's top|
private wealth management|wealth partners|financial partners|capital partners|asset managers|advisors|partners|
crypto assets|digital assets|client assets|real assets|alternative assets|private assets|wealth management group|
financial decisions|estate planners|next generation
""".replace("\n", "").split("|"))

REGIONS = {"Pacific Northwest": ("WA", "OR", "ID")}


def industry_rules(path: str | None = None) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """Rules from a JSON or YAML file ({industries: [{name, any, unless}]}); the defaults without one."""
    if path is None:
        return INDUSTRIES
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    return [(r["name"], tuple(map(str, r.get("any") or ())), tuple(map(str, r.get("unless") or ())))
            for r in data["industries"]]


def industry_rule_table(spark: SparkSession, rules=None) -> DataFrame:
    rows = [(name, rank, list(yes), list(no)) for rank, (name, yes, no) in enumerate(rules or INDUSTRIES, 1)]
    return spark.createDataFrame(rows, "industry string, rank int, any array<string>, unless array<string>")


def alias_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Curated brand aliases: (alias, registered legal or business name)."""
    return spark.createDataFrame(pairs, "alias string, target string")


def stop_table(spark: SparkSession, phrases=STOP_PHRASES) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(phrases)], "phrase string")
