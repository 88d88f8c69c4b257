"""Text measures as columns: normal text, keyword counts, buckets, tokens, lexicon, directness.

Keywords are matched on a normal form: the lower-case tokens [a-z0-9]+ with two blanks between and one
around them, so that a word is found by its blanks and neighbours don't share one. Every measure is a
JVM expression; nothing here needs Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import config


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-case tokens of a text in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def normal(text: Column) -> Column:
    """The normal form that keyword patterns are matched on."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), "  "), F.lit(" "))


def keyword_pattern(keyword: str) -> str:
    """The pattern of a keyword with plural forms, on the normal form."""
    parts = re.findall(r"[a-z0-9]+", keyword.lower())
    return " " + "  ".join(parts) + "(?:s|es)? "


def bare_pattern(keyword: str) -> str | None:
    """The pattern of the longer phrase in which a keyword doesn't count, or None."""
    phrase = config.EXCLUDED_IN.get(keyword.lower())
    return f" {phrase} " if phrase else None


def keyword_count(norm: Column, keyword: str) -> Column:
    """How often a keyword stands in a normal text, not counting its excluded phrases."""
    n = F.regexp_count(norm, F.lit(keyword_pattern(keyword)))
    ex = bare_pattern(keyword)
    return n - F.regexp_count(norm, F.lit(ex)) if ex else n


def any_keyword(norm: Column, keywords: list[str]) -> Column:
    """Whether one of the keywords stands in a normal text."""
    plain = [keyword_pattern(k) for k in keywords if not bare_pattern(k)]
    tests = [norm.rlike("|".join(plain))] if plain else []
    tests += [keyword_count(norm, k) > 0 for k in keywords if bare_pattern(k)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def votes(norm: Column, entries: list[list[str]]) -> Column:
    """How many entries have a form in the text."""
    return sum((any_keyword(norm, e).cast("int") for e in entries), F.lit(0))


def tone_vote(norm: Column) -> Column:
    """negative or positive if one side leads by two entries or more, else null."""
    calm = F.regexp_replace(norm, " risk  weight[a-z]* | de  risk[a-z]* | derisk[a-z]* | stress  test[a-z]* ", "   ")
    n, p = votes(calm, config.VOTE_NEGATIVE), votes(calm, config.VOTE_POSITIVE)
    return F.when((n >= p + 2) & (n >= 2), "negative").when((p >= n + 2) & (p >= 2), "positive")


def bucket(norm: Column) -> Column:
    """untagged, the one bucket whose words stand in the text, or mixed."""
    hit = {b: any_keyword(norm, config.METRIC_WORDS[m]) for m, b in config.BUCKETS.items()}
    n = sum((h.cast("int") for h in hit.values()), F.lit(0))
    one = F.lit(None).cast("string")
    for b, h in reversed(list(hit.items())):
        one = F.when(h, b).otherwise(one)
    return F.when(n == 0, "untagged").when(n > 1, "mixed").otherwise(one)


def category(norm: Column) -> Column:
    """The category with most distinct keywords; of equals the last by name; untagged if none."""
    scored = [
        F.struct(sum(((keyword_count(norm, k) > 0).cast("int") for k in keys), F.lit(0)).alias("n"), F.lit(c).alias("c"))
        for c, keys in config.CATEGORIES.items()
    ]
    best = F.greatest(*scored)
    return F.when(best["n"] == 0, "untagged").otherwise(best["c"])


def blank(text: Column) -> Column:
    """Whether a text is null, empty or a written-out null."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), F.lit("")).isin("", "nan", "none")


def content_tokens(text: Column, cap: int | None = None) -> Column:
    """Distinct tokens of three letters or more that aren't stop words, of the first ``cap`` tokens."""
    t = tokens(text)
    t = F.slice(t, 1, cap) if cap else t
    return F.array_distinct(F.filter(t, lambda w: (F.length(w) >= 3) & ~w.isin(config.STOP_WORDS)))


def overlap_share(asked: Column, told: Column) -> Column:
    """The share of ``asked`` tokens among ``told`` ones, to three digits; null if nothing was asked."""
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, told)) / F.size(asked), 3))


def directness_v1(question: Column, answer: Column) -> Column:
    """Share of the question's words met in the answer; null if either has none or is blank."""
    q, a = F.array_distinct(tokens(question, "[a-z]{3,}")), F.array_distinct(tokens(answer, "[a-z]{3,}"))
    return F.when(~blank(question) & ~blank(answer) & (F.size(a) > 0), overlap_share(q, a))


def directness_v2(question: Column, answer: Column, cap: int = 100) -> Column:
    """The same over content tokens of the question and of the answer's first ``cap`` tokens."""
    return F.when(~blank(question) & ~blank(answer), overlap_share(content_tokens(question), content_tokens(answer, cap)))


def lexicon_counts(text: Column) -> Column:
    """struct(n, pos, neg): a positive word within the window after a negator counts as negative."""
    t = tokens(text, "[a-z]+")
    w = config.NEGATION_WINDOW
    kinds = F.transform(
        t,
        lambda x, i: F.when(
            x.isin(config.LEXICON_POSITIVE),
            F.when(
                F.exists(F.slice(t, F.greatest(F.lit(1), i - w + 1), F.least(F.lit(w), i)), lambda y: y.isin(config.NEGATORS)), -1
            ).otherwise(1),
        ).when(x.isin(config.LEXICON_NEGATIVE), -1).otherwise(0),
    )
    return F.struct(
        F.size(t).alias("n"), F.size(F.filter(kinds, lambda k: k == 1)).alias("pos"), F.size(F.filter(kinds, lambda k: k == -1)).alias("neg")
    )


def lexicon_net(text: Column) -> Column:
    """(positive - negative) / tokens, 0 for none."""
    c = lexicon_counts(text)
    return F.coalesce(F.try_divide(c["pos"] - c["neg"], c["n"]), F.lit(0.0))


def sign_label(net: Column, band: float) -> Column:
    """positive above the band, negative below it, neutral within; null stays null."""
    return F.when(net > band, "positive").when(net < -band, "negative").when(net.isNotNull(), "neutral")


def is_courtesy(sentence: Column) -> Column:
    """Whether fewer than three tokens carry content."""
    return F.size(F.filter(tokens(sentence, "[a-z]+"), lambda w: ~w.isin(config.COURTESY))) < 3


def word_count(text: Column) -> Column:
    """Blank-separated words, 0 for none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def handed_over(text: Column) -> Column:
    """Whether a sentence has a phrase of an operator handing over."""
    return F.lower(text).rlike(r"\b(?:" + "|".join(config.HANDOVER) + r")\b")


def without_handover(text: Column) -> Column:
    """The text without the sentences in which an operator hands over."""
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.?!]*[.?!]|[^.?!]+"), F.lit(0))
    return F.array_join(F.filter(sentences, lambda s: ~handed_over(s)), " ")


def untagged_reason(question: Column, other: Column, least: int = 15) -> Column:
    """Why a question has no bucket: the first that holds of five reasons.

    operator_handover: sentences of an operator were there, and without them under ``least`` words and no question are left.
    """
    q = F.coalesce(question, F.lit(""))
    left = without_handover(question)
    n, n_left = word_count(question), word_count(left)
    asks = q.contains("?")
    return (
        F.when((n_left < n) & (n_left < least) & ~left.contains("?"), "operator_handover")
        .when((n < least) & ~asks, "courtesy_or_fragment")
        .when(other != "untagged", "coder1_tagged")
        .when(n < least, "short_follow_up")
        .otherwise("off_seed")
    )


def role_of(firm: Column, bank: Column, speaker: Column) -> Column:
    """operator, analyst or management, by speaker, firm and hints, in this order."""
    f, s = F.lower(F.coalesce(firm, F.lit(""))), F.lower(F.trim(F.coalesce(speaker, F.lit(""))))
    hinted = F.lit(False)
    for h in config.MANAGEMENT_HINTS:
        hinted = hinted | f.contains(h)
    house = F.lit(False)
    for h in config.RESEARCH_HINTS:
        house = house | f.contains(h)
    own = (f != "") & (f == F.replace(F.lower(bank), F.lit("_"), F.lit(" ")))
    return (
        F.when((s == "operator") | (f == "operator"), "operator").when(f.contains("analyst"), "analyst").when(hinted, "management")
        .when(house & ~F.coalesce(own, F.lit(False)), "analyst").otherwise("management")
    )


def clip(text: Column, n: int) -> Column:
    """Blanks collapsed, cut to ``n`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def join_key(text: Column, n: int = 120) -> Column:
    """The first characters of a text in normal spacing and lower case."""
    return F.substring(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, n)


def pieces(text: Column, least: int = 20) -> Column:
    """Sentences by terminal marks followed by a blank, of at least ``least`` characters."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.split(t, r"[.!?]+ "), lambda s: F.length(s) >= least)


def clean_words(text: Column) -> Column:
    """Lower-case words of letters without stop words, joined by blanks."""
    return F.array_join(F.filter(tokens(text, "[a-z]+"), lambda w: ~w.isin(config.STOP_WORDS)), " ")
