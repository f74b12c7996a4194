"""Words of deal headlines, as plain lists. All lists are fixed values."""

# ---- headlines about deals rather than announcing one
QUESTION_STARTS = """why, how, what, when, where, who, which, should, could, would, can, is, are, does, do, inside, opinion, commentary,
analysis, podcast, webinar, video, watch, listen, q&a, ask, this week, the weekly, weekly"""
DEAL_TOPICS = "m&a, deal, deals, merger, mergers, acquisition, acquisitions, consolidation, dealmaking, deal making, transaction, transactions"
TOPIC_TALK = """activity, volume, volumes, market, markets, slowdown, slows, slowed, cools, cooled, surge, surged, surges, rebound, rebounds,
drop, drops, dropped, fall, falls, fell, rise, rises, rose, climb, climbs, trend, trends, outlook, report, record, records, pace, boom,
frenzy, wave, landscape, environment, playbook, tips, lessons, strategy, strategies, valuation, valuations, multiples, count, counts,
data, index, tracker, roundup, recap, advice, mistakes, checklist, guide, prediction, predictions, forecast, forecasts, survey, study,
panel, summit, conference, insights, pipeline, appetite, momentum, drought, freeze, thaw, risk, risks, hurdle, hurdles, headwinds,
tailwinds, rules, scrutiny, debate, signal, signals, spree, streak, refugees"""
PERIODS = """q1, q2, q3, q4, first quarter, second quarter, third quarter, fourth quarter, first half, second half, year to date, ytd, annual,
monthly, quarterly"""
PERIOD_TOPICS = "m&a, deals, transactions"
RECENT_PERIODS = "q1, q2, q3, q4, this year, last year, so far"
OTHER_COMMENTARY = "interview, # deals, deal & moves, deals & moves, deal and moves, deals and moves, fundraising tracker, episode"

# ---- position changes, financings, goods, denials and legal notices
HOLDING_PHRASES = """new stake, new position, position in, positions in, holding in, holdings in, shares of, shares in, # shares, buyback, buybacks,
buy back, buy backs, buys back, share repurchase, share repurchases, stock repurchase, stock repurchases, repurchase program"""
POSITION_VERBS = "raises, boosts, lifts, increases, grows, trims, cuts, lowers, reduces, decreases"
POSITION_OWNERS = "its, their"
POSITION_NOUNS = "stake, position, holding, holdings"
FINANCE_PHRASES = """refinanc*, credit facility, debt sale, debt offering, notes offering, ipo, initial public offering, go public, goes public, spac,
series a, series b, series c, series d, series e, seed round, seed funding, funding round"""
RAISE_VERBS = "raise, raised, raises, secures, lands, nabs, banks, closes"
RAISE_NOUNS = "funding, round, series, seed, financing, capital, fund"
RATING_PHRASES = """buy rating, strong buy rating, outperform rating, overweight rating, stock to buy, stocks to buy, buy the dip, buy now pay later,
buy now, buy side"""
BOUGHT_THINGS = "customer, client, user, talent, data, land"
ACQUIRE_VERBS = "acquire, acquires"
THINGS_NOT_FIRMS = """customers, clients, users, talent, rights to, license, licenses, patent, patents, land, aircraft, vessel, vessels, ship, ships,
equipment, tickets"""
UNITS = "gw, mw, mwh, gwh, units, tons, tonnes, barrels, acres, homes, apartments, beds"
OTHER_NOT_DEALS = """denies, denied, deny, rumor denied, rumors denied, rumour denied, rumours denied, pact, licens*, co develop*, collaboration deal,
collaboration agreement, partnership deal, class action, shareholder alert, shareholder action, investor who, investors who,
investor have, investors have, investor with, investors with, investigat*"""

# ---- people moves share verbs with deals; a strong deal word overrides them
PEOPLE_WORDS = """team, teams, duo, trio, quartet, joins, joined, hires, hired, hiring, breaks away, breakaway, recruits, recruited, poaches, departs,
defects, names, named, appoints, appointed, promotes, promoted, taps, ceo, president, chief, advisor who, advisors who, broker who,
brokers who, banker, bankers, executive, exec, leader, head of, co ceo"""
STRONG_WORDS = """acquir*, merg*, buy, buys, bought, to buy, purchas*, takeover, take private, buyout, stake, recapitaliz*, divest*, sell, sells, sold,
to sell, sale of, carve, double deal, triple deal"""

# ---- function words of other languages; two of them make a headline foreign
FOREIGN_WORDS = """la, le, les, des, du, et, pour, avec, sus, una, unen, para, con, und, der, die, das, mit, für, il, della, per, een, het, voor, ve,
bir, için, się, oraz, dla, completa, acquiert, adquiere, übernimmt, acquisisce, sobre"""
FOREIGN_MARKS = "«»¿¡"

# ---- words that reveal the stage, most decisive first
STAGES = {
    "terminated": """terminat*, call off, calls off, called off, abandon*, scrap, scraps, scrapped, walk away, walks away, collaps*, block, blocks, blocked,
    sues to block, end merger, ends merger, end deal, ends deal, end talks, ends talks, pull out of, pulls out of, withdraw offer,
    withdraws offer, withdraw its offer, withdraws its offer, withdraw bid, withdraws bid, withdraw its bid, withdraws its bid,
    reject, rejects, rejected, rebuff, rebuffs, spurn, spurns""",
    "rumored": """in talks, talks to, in advanced talks, near deal, nears deal, near a deal, nears a deal, close to deal, close to a deal, nearing deal,
    nearing a deal, weigh, weighs, eyes, eyeing, said to, reportedly, sources say, report says, people familiar, mull, mulls,
    in discussion, in discussions""",
    "bid": """bid, bids, offer for, offers for, offer to buy, offer to acquire, proposal to buy, proposal to acquire, hostile, unsolicited, tender offer,
    raises offer, raises its offer, raises bid, raises its bid, sweeten, sweetens""",
    "completed": """complet*, closes, closed, closing of, finaliz*, has acquired, consummat*, now part of, officially joins, wraps up""",
}
EXPLORE_VERBS = {"explor*": "sale, a sale, merger, a merger, deal, a deal", "consider*": "sale, a sale, merger, a merger, bid, a bid"}

# ---- contexts that make a figure a price, and nouns that make it the target's assets instead
PRICE_LEADS = """for, in a, in an, valued at, worth, valuing, priced at, for about, for roughly, for up to, pay, pays, paid, spend, spends, spent, ink,
inks, strike, strikes, agrees to a, agrees to an, announce, announces"""
ABOUT_WORDS = "about, roughly, nearly, around, up to, approximately, a, an"
PAYMENT_KINDS = "all cash, all stock, cash and stock, upfront"
PRICE_NOUNS = "deal, acquisition, takeover, buyout, merger, transaction, bid, offer, purchase, sale, tie up, take private, to buy, to acquire"
ASSET_NOUNS = """ria, rias, firm, firms, practice, family office, wealth, advis*, aum, in aum, in assets, assets, business, team, trust business,
multifamily office"""
# words near a figure that make it something other than assets, and words just before or after that make it assets
NOT_ASSETS = """fine, fined, fines, fining, penalt*, pay, pays, paid, paying, settle*, restitution, disgorge*, raise, raised, raises, raising, funding,
round, price, priced, prices, pricing, valued, valuation, revenue, revenues, salary, salaries, bonus*, loan, loans, scheme, stole,
stolen, diverted, divert*, misappropriat*, cost, costs, fee, fees, fraud*, theft, embezzl*, ponzi, budget, deficit, sales, profit*,
income, per advisor, per month, per year, a year, annually, inflow, inflows, outflow, outflows, topped, award*"""
ASSETS_BEFORE = """with, managing, manages, managed, overseeing, oversees, oversaw, aum, ria, rias, team, firm, practice, add, adds, added, buy, buys,
acquires, acquired, acquiring, to buy, to acquire, of, creating, create, form, forming, advisor, advisors, adviser, advisers, assets of"""
ASSETS_AFTER = """assets, aum, ria, rias, firm, firms, team, teams, practice, wealth, advisory, multifamily, multi family, family office, book, shop,
hybrid, breakaway, advisor, adviser, independent, office, asset manager, wealth manager, in aum"""
ASSETS_OF = "client, total"

# ---- labels before a headline
LABELS = """exclusive, breaking, update, updated, report, reports, deal news, m&a, press release, ria moves, ria deal, ria deals, deal roundup,
in brief, scoop"""
# ---- words after which a party name ends, and nouns of firms and persons
NAME_ENDS = """in, to, for, as, after, amid, with, worth, valued, from, at, on, while, marking, its, that, which, who, following, despite, ahead, over,
under, via, through, into, said, reportedly, report"""
FIRM_NOUNS = """ria, rias, firm, practice, family office, advisor, advisors, adviser, advisers, partners, wealth, capital, management, financial,
holdings, inc, llc, corp, company, group"""
PERSON_NOUNS = "advisor, advisors, adviser, advisers, broker, brokers, banker, bankers, rep, reps, planner, planners, executive, executives"

# ---- party names: nouns that describe a party before or instead of its name, words before names, and words that are no party
DESCRIPTORS = """supplier, provider, maker, startup, start-up, firm, company, developer, operator, platform, specialist, manufacturer, distributor,
producer, retailer, chain, brand, lender, insurer, broker, brokerage, consultancy, agency, ria, practice, office, manager, owner, rival,
unit, business, biz, subsidiary, division, group, outfit, shop, player, vendor, carrier, consolidator, aggregator, adviser, advisor, bank,
services, solutions, partner, investor"""
TITLE_DESCRIPTORS = "ria, firm, platform, practice, provider, startup, consolidator, aggregator"
ENDING_DESCRIPTORS = "bank, boutique, lender, insurer, manufacturer, maker, developer"
BEFORE_NAMES = "aum, a, an, us, u.s, uk, u.k, eu, former, rival, fellow"
PLACES = """us, uk, america, india, china, japan, germany, france, canada, europe, brazil, australia, britain, italy, spain, mexico, korea, singapore,
israel, ireland, switzerland, sweden, netherlands, dutch, swiss, chinese, indian"""
NOT_PARTIES = """no, yes, this, that, these, those, it, they, we, he, she, here, there, report, reports, sources, exclusive, update, breaking, deal, deals,
acquisition, merger, m&a"""
GENERIC_PARTIES = """ria, rias, firm, firms, team, teams, advisor, advisors, adviser, advisers, practice, wealth, manager, managers, business, shop, office,
family, multifamily, independent, hybrid, rival, two, three, another, stake, minority, majority, undisclosed, breakaway, consolidator,
acquirer, group, partners, company, platform, startup, unit, provider, planning, financial, bank"""
