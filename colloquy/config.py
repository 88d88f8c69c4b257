"""Dictionaries and thresholds that operators take as parameters; these are the defaults."""

from __future__ import annotations

#: Tags of reporting periods and the shared period each means.
PERIOD_TAGS = {"q1": "H1q1", "1q": "H1q1", "q2": "H1", "2q": "H1", "interim": "H1", "h1": "H1", "q3": "Q3", "3q": "Q3", "q4": "FY", "4q": "FY", "annual": "FY", "fy": "FY"}
#: Order and short form of the shared periods.
PERIOD_ORDER = {"H1q1": 1, "H1": 2, "Q3": 3, "FY": 4}
PERIOD_SHORT = {"H1q1": "Q1", "H1": "H1", "Q3": "Q3", "FY": "FY"}
#: Years in which both peers are complete.
PEER_YEARS = (2012, 2025)
#: Metrics and the words that name them.
METRIC_WORDS = {
    "total_income": ["revenue", "total income", "nii", "fee income", "net interest"],
    "operating_costs": ["cost", "costs", "efficiency", "opex", "expense"],
    "credit_impairment": ["impairment", "ecl", "loan loss", "credit loss", "cost of risk", "npl"],
    "cet1_ratio": ["cet1", "capital ratio", "rwa", "tier 1"],
}
#: The four buckets by metric, in order of precedence.
BUCKETS = {"total_income": "profitability", "operating_costs": "efficiency", "credit_impairment": "asset_quality", "cet1_ratio": "capital"}
#: Eight categories and the words that name them.
CATEGORIES = {
    "capital_adequacy": ["cet1", "capital", "rwa", "tier 1", "leverage", "buyback"],
    "liquidity_funding": ["liquidity", "deposit", "funding", "lcr", "nsfr", "loan-to-deposit"],
    "asset_quality_credit": ["impairment", "ecl", "npl", "credit", "stage 2", "stage 3", "cost of risk"],
    "profitability_earnings": ["income", "revenue", "nii", "nim", "rote", "profit", "fee"],
    "operational_efficiency": ["cost", "efficiency", "opex", "expense", "jaw"],
    "market_traded_risk": ["markets", "trading", "var", "structural hedge", "swap"],
    "conduct_operational": ["conduct", "operational risk", "cyber", "fraud", "control"],
    "business_model_strategy": ["strategy", "franchise", "wealth", "plan", "guidance", "growth"],
}
#: Category of each bucket.
BUCKET_CATEGORY = {"profitability": "profitability_earnings", "efficiency": "operational_efficiency", "asset_quality": "asset_quality_credit", "capital": "capital_adequacy"}
#: Phrases in which a word doesn't count.
EXCLUDED_IN = {"cost": "costs?  of  risk", "costs": "costs?  of  risk", "capital": "capital  markets?"}
#: Words of a weak tone vote; forms of one word are one entry.
VOTE_NEGATIVE = [
    ["impairment"], ["headwind"], ["headwinds"], ["risk"], ["risks"], ["loss"], ["losses"], ["downgrade"],
    ["deteriorate", "deteriorated", "deteriorating", "deterioration"], ["uncertain", "uncertainty", "uncertainties"], ["pressure"], ["npl"],
    ["default", "defaulted"], ["weak", "weaker", "weakest", "weakness", "weaken", "weakened", "weakening"], ["decline", "declined", "declining"],
    ["stress", "stressed"], ["charge", "charged"],
]
VOTE_POSITIVE = [
    ["growth"], ["strong", "stronger", "strongest", "strongly"], ["resilient"], ["robust"], ["improve", "improved", "improving", "improvement"],
    ["upside"], ["momentum"], ["beat", "beating"], ["record"], ["healthy"], ["solid", "solidly"], ["confident", "confidently"],
    ["progress", "progressed", "progressing"], ["outperform", "outperformed", "outperforming", "outperformance"],
]
#: Words without content for overlap measures.
STOP_WORDS = (
    "a an the and or but if in on of to for from with without as at by into over after before this that these those it its we our us you "
    "your they their he she his her them is are was were be been being have has had do does did not no nor so than then too very can could "
    "should would will just about up down out off also please thank thanks"
).split()
#: Tokens of courtesies.
COURTESY = (
    "thanks thank you for taking my the question questions good morning afternoon evening hi hello everyone everybody all guys chaps okay ok "
    "yes yeah sure great please and a an both two three of them it that is so just very much too as well one first second also i have got had "
    "couple few quick ones if may can could from here there again team operator next go ahead your line open hey cheers bye right then on to me we will take"
).split()
#: The small tone lexicon and the negators that turn a positive word.
LEXICON_POSITIVE = (
    "growth strong improve improved improvement resilient robust increase increased upside momentum solid healthy stable confidence confident progress record beat outperform"
).split()
LEXICON_NEGATIVE = (
    "risk risks weak weaker decline declined pressure pressures impairment impairments loss losses concern concerns uncertain uncertainty downgrade "
    "deterioration headwind headwinds stress default npl charge charges cut cuts slowdown"
).split()
NEGATORS = "no not never none neither nor nobody nothing cannot without".split()
NEGATION_WINDOW, LEXICON_BAND, DEAD_ZONE = 3, 0.01, 0.15
#: Metrics compared on their absolute value, and relative change that counts as flat.
ABSOLUTE_METRICS, FLAT = ("operating_costs", "credit_impairment"), 0.01
NARRATIVE_BAND = 0.05
#: The two peers compared by default.
PEERS = ("calder_union", "norvale_bank")
LABELS = ("negative", "neutral", "positive")
#: Words of a role in a firm's name that mark management, and of research houses.
MANAGEMENT_HINTS = ["group ceo", "group cfo", "group chief", "chief executive", "finance director", "investor relations", "group treasurer", "chief financial"]
RESEARCH_HINTS = ["research", "securities", "rsch", "sec."]
#: Phrases of an operator handing over.
HANDOVER = ["next question", "please go ahead", "your line is open", "your line is now open", "please ask your question", "that concludes", "no further questions"]
