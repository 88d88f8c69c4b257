"""Problem 4: one quantity written in many units, brought to the common unit of its field.

A unit string is cut into known pieces by dynamic programming over three tries: prefixes (scales such
as ``k``, ``Mrd.``, ``lakh``, ``billions of``), roots (currencies, ratios, heads, physical units) and
exponents (``²``, ``^-1``, ``e6``). Several cuts may cover a string (``m`` is a million or a metre,
``CHFm`` a currency with a scale); each gets the log weights of its pieces plus the prior of its
dimension for the field, and the best one wins. Where the unit column tells nothing, the figure as
written, its span and the windows of its context are cut in the same way; of the context the window with the
best cut counts first.

Defined results: a claim whose field, number, unit or scale is not stated has no row; an amount with a
currency but no scale is in single units; a claim delivered again counts once; null, empty or very
long strings are never cut further than their known pieces; ties between cuts go to the longer
pieces, then to the alphabetically first; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import spread


class Piece(NamedTuple):
    """A known string: its kind, the dimension it speaks for, its factor and its log weight."""

    kind: str
    dim: str
    factor: Decimal
    weight: float


class Field(NamedTuple):
    """A measured field: its dimension and its common unit with the factor from the base unit."""

    dim: str
    unit: str
    per_base: Decimal


class Cut(NamedTuple):
    """What a string states: dimension ('' if none), factor (None if no scale or root states one) and currency."""

    dim: str
    factor: Decimal | None
    currency: str
    score: float


D = Decimal
#: Fields and their common units. Amounts are kept in the claim's own currency.
FIELDS = {
    "total_income": Field("money", "m", D(1) / D(10**6)),
    "operating_costs": Field("money", "m", D(1) / D(10**6)),
    "credit_impairment": Field("money", "m", D(1) / D(10**6)),
    "rwa": Field("money", "m", D(1) / D(10**6)),
    "cet1_ratio": Field("ratio", "pct", D(100)),
    "net_margin": Field("ratio", "pct", D(100)),
    "rote": Field("ratio", "pct", D(100)),
    "cost_of_risk": Field("ratio", "bp", D(10000)),
    "headcount": Field("heads", "fte", D(1)),
}
#: Scale words by factor.
PREFIXES = {
    "1": "units unit units of ones",
    "100": "hundred hundreds hundreds of",
    "1000": "k thousand thousands thousands of '000 ’000 000 000s tsd tsd. tausend mille",
    "100000": "lakh lakhs lac lacs lakh of lakhs of",
    "1000000": "m mn mm mil mil. mio mio. million millions millions of mln mln. million of",
    "10000000": "cr cr. crore crores crore of crores of",
    "100000000": "oku 億 hundreds of millions of hundreds of millions hundred million",
    "1000000000": "b bn bn. bln bln. billion billions billions of mrd mrd. milliard milliarde milliarden md",
    "1000000000000": "t tn trn trillion trillions trillions of 兆",
}
#: Currency names.
CURRENCIES = {
    "gbp": "gbp £ sterling pounds pound pounds sterling british pounds",
    "usd": "usd $ us$ us dollars us dollar u.s. dollars dollars dollar",
    "eur": "eur € euros euro",
    "chf": "chf sfr sfr. fr. swiss francs swiss franc francs",
    "inr": "inr ₹ rs rs. rupees rupee indian rupees",
    "jpy": "jpy ¥ 円 yen japanese yen",
}
#: Ratio words by factor.
RATIOS = {
    "0.01": "% pct pct. percent per cent % pts %-pts percentage points percentage point pp prozent",
    "0.001": "‰ per mille per mil per thousand permille promille",
    "0.0001": "bp bps b.p. b.p basis points basis point",
    "1": "ratio decimal fraction",
}
#: Words for heads.
HEADS = "fte ftes employees employee staff people persons headcount full-time equivalents full time equivalents"
#: Physical roots, so that their letters compete with the scales.
PHYSICAL = {"metre": "m metre metres meter", "gram": "g gram grams", "second": "s sec second seconds", "byte": "byte bytes"}
#: Log prior of a dimension for a field of a dimension: its own, none, or another.
PRIOR = {"own": 0.0, "none": -2.0, "other": -9.0}
SKIP = re.compile(r"[\s_\-/·,;:()\[\]]+|\bof\b|\bin\b")


def _pieces() -> dict[str, list[Piece]]:
    """All known strings. Lists hold single words; phrases are recognised by their joined forms."""
    out: dict[str, list[Piece]] = {}

    def add(name: str, piece: Piece) -> None:
        if piece not in out.setdefault(name, []):
            out[name].append(piece)

    def phrases(text: str, known: tuple[str, ...]) -> list[str]:
        for k in known:
            text = re.sub(rf"(?<!\S){re.escape(k)}(?!\S)", k.replace(" ", "\x00"), text)
        return [w.replace("\x00", " ") for w in text.split(" ")]

    long = (
        "hundreds of millions of", "hundreds of millions", "hundred million", "hundreds of", "units of", "thousands of",
        "lakhs of", "lakh of", "millions of", "million of", "crores of", "crore of", "billions of", "trillions of",
        "pounds sterling", "british pounds", "u.s. dollars", "us dollars", "us dollar", "swiss francs", "swiss franc",
        "indian rupees", "japanese yen", "per cent", "% pts", "percentage points", "percentage point", "per mille",
        "per mil", "per thousand", "basis points", "basis point", "full-time equivalents", "full time equivalents",
    )
    for f, words in PREFIXES.items():
        for w in phrases(words, long):
            add(w, Piece("prefix", "", D(f), -1.0))
    for c, words in CURRENCIES.items():
        for w in phrases(words, long):
            add(w, Piece("root", "money:" + c, D(1), -1.0))
    for f, words in RATIOS.items():
        for w in phrases(words, long):
            add(w, Piece("root", "ratio", D(f), -1.0))
    for w in phrases(HEADS, long):
        add(w, Piece("root", "heads", D(1), -1.0))
    for name, words in PHYSICAL.items():
        for w in phrases(words, long):
            add(w, Piece("root", name, D(1), -3.0))
    return out


def _exponent(text: str, at: int) -> tuple[int, int] | None:
    """(end, power) of an exponent that starts at ``at``."""
    m = re.compile(r"\^(-?\d)|([⁻]?[¹²³])|[eE](\d{1,2})(?![0-9])").match(text, at)
    if not m:
        return None
    if m[3]:
        return m.end(), int(m[3])
    if m[2]:
        return m.end(), (-1 if m[2][0] == "⁻" else 1) * ("¹²³".index(m[2][-1]) + 1)
    return m.end(), int(m[1])


def _trie(names: dict[str, list[Piece]]) -> dict:
    root: dict = {}
    for name, pieces in names.items():
        node = root
        for ch in name:
            node = node.setdefault(ch, {})
        node[""] = pieces
    return root


TRIE = _trie(_pieces())
NONE = Cut("", None, "", -1e9)


@lru_cache(maxsize=100_000)
def segment(text: str, dim: str = "") -> Cut:
    """The best cut of a unit string for a field of dimension ``dim``; NONE if no cut covers it.

    A state is (position, dimension, currency, whether a scale was met); of each the best score is
    kept, so the work is linear in the string's length.
    """
    s = text.strip().lower()
    if not s:
        return NONE
    best: dict[tuple, tuple[float, Decimal, bool]] = {(0, "", "", False): (0.0, D(1), False)}
    order = [set() for _ in range(len(s) + 1)]
    order[0].add((0, "", "", False))

    def put(state: tuple, score: float, factor: Decimal, stated: bool) -> None:
        old = best.get(state)
        if old is None or score > old[0]:
            best[state] = (score, factor, stated)
            order[state[0]].add(state)

    for at in range(len(s)):
        for state in sorted(order[at]):
            score, factor, stated = best[state]
            _, d, cur, scaled = state
            if m := SKIP.match(s, at):
                put((m.end(), d, cur, scaled), score - 0.01, factor, stated)
            if at and (e := _exponent(s, at)) and s[at] in "eE":
                put((e[0], d, cur, True), score - 1.5, factor * D(10) ** e[1], True)
            node, i = TRIE, at
            while i < len(s) and s[i] in node:
                node, i = node[s[i]], i + 1
                if "" not in node:
                    continue
                # letters may not stop inside a word of letters, unless a piece of it follows directly
                glued = i < len(s) and s[i].isalpha() and s[i - 1].isalpha()
                for p in node[""]:
                    w = score + p.weight - (1.0 if glued else 0.0)
                    if p.kind == "prefix":
                        if not scaled:
                            put((i, d, cur, True), w, factor * p.factor, True)
                    elif d == "" or (d == "money" and p.dim == "money:" + cur):
                        kind, _, c = p.dim.partition(":")
                        end, power = _exponent(s, i) or (i, 1)
                        put((end, kind, c, scaled), w, factor * p.factor**power, stated or kind != "money")
    found = []
    for state in order[len(s)]:
        score, factor, stated = best[state]
        _, d, cur, _ = state
        prior = PRIOR["own"] if d == dim or not dim else PRIOR["none"] if not d else PRIOR["other"]
        found.append((score + prior, d, cur, factor, stated))
    if not found:
        return NONE
    score, d, cur, factor, stated = max(found, key=lambda x: (x[0], x[1], x[2]))
    return Cut(d, factor if stated else None, cur, score)


NUMBER = re.compile(r"\d[\d.,’'    ]*\d|\d")
SIGN = "-−–‐"


def read_number(raw: str | None, value: float | None) -> Decimal | None:
    """The signed figure in ``raw``, in any country's format; ``value`` settles what its marks leave open.

    A last mark before exactly three digits parts thousands unless the figure before it is zero; a
    mark met twice parts thousands; of two different marks the last is the decimal one.
    """
    m = NUMBER.search(raw or "")
    if not m:
        try:
            return D(repr(value)) if value is not None and value == value else None
        except InvalidOperation:
            return None
    body = re.sub(r"[’'    ]", "", m[0])
    before, after = (raw or "")[: m.start()], (raw or "")[m.end() :]
    negative = any(c in SIGN for c in before) or ("(" in before and ")" in after)
    marks = [c for c in body if c in ".,"]
    options: list[str] = []
    if not marks:
        options = [body]
    elif len(set(marks)) == 2:
        last = body[max(body.rfind("."), body.rfind(","))]
        other = "," if last == "." else "."
        options = [body.replace(other, "").replace(last, ".")] if body.count(last) == 1 else [re.sub(r"[.,]", "", body)]
    elif len(marks) > 1:
        options = [re.sub(r"[.,]", "", body)]
    else:
        head, tail = re.split(r"[.,]", body)
        whole, part = head + tail, f"{head}.{tail}"
        thousands = len(tail) == 3 and head.strip("0") != "" and len(head) <= 3
        options = [whole, part] if thousands else [part]
    numbers = [-D(x) if negative else D(x) for x in options]
    if len(numbers) > 1 and value is not None and value == value:
        near = [n for n in numbers if abs(float(n) - value) <= 1e-9 * max(1.0, abs(value))]
        if near:
            return near[0]
    return numbers[0]


TOKEN = re.compile(r"[^\s(),;:\[\]#]+|[()\[\]:#]")
#: What stands before a unit that is named for a figure apart from it.
BEFORE_UNIT = frozenset({"in", "(", "[", ":", "currency"})
#: Most tokens of a window of the context, and what each further token that a cut covers adds to the window's score.
WINDOW, COVERED = 6, 1.5


@lru_cache(maxsize=100_000)
def offered(context: str, dim: str = "") -> tuple[str, ...]:
    """The windows of a context that name a unit, the best cut first; the claim's own figure is written #.

    A window begins behind one of BEFORE_UNIT and holds no figure. Of the windows from one place the best
    counts: the score of its cut, and COVERED for each token more. Windows of other dimensions come last,
    by the prior in that score.
    """
    tokens = [t.rstrip(".") or t for t in TOKEN.findall(context)]
    found = []
    for i, before in enumerate(tokens[:-1]):
        if before.lower() not in BEFORE_UNIT:
            continue
        best = None
        for j in range(i + 1, min(i + 1 + WINDOW, len(tokens))):
            if NUMBER.search(tokens[j]) and segment(tokens[j], dim) is NONE or tokens[j] in ("#", ")", "]", "(", "[", ":"):
                break
            c = segment(text := " ".join(tokens[i + 1 : j + 1]), dim)
            if c is not NONE and (best is None or c.score + COVERED * (j - i - 1) > best[0]):
                best = (c.score + COVERED * (j - i - 1), text)
        if best:
            found.append((-best[0], i, best[1]))
    return tuple(text for _, _, text in sorted(found))


def convert(metric: str | None, raw: str | None, value: float | None, unit: str | None, span: str | None, context: str | None) -> tuple[str, int] | None:
    """(common unit, value in it times 1,000) of one claim, or None where something isn't stated."""
    field = FIELDS.get((metric or "").strip().lower())
    if field is None:
        return None
    number = read_number(raw if raw and NUMBER.search(raw) else span, value)
    if number is None:
        return None
    figure = NUMBER.search(raw or "")
    stated: list[str] = [unit or ""]
    if figure:
        stated.append((raw[: figure.start()] + " " + raw[figure.end() :]).strip("()+ " + SIGN))
    if span:
        f = NUMBER.search(span)
        stated.append(((span[: f.start()] + " " + span[f.end() :]) if f else "").strip("()+ " + SIGN))
    text = context or ""
    if span and span in text:
        text = text.replace(span, " # ", 1)
    stated += offered(text, field.dim)
    factor, currency, dim = None, "", ""
    for s in stated:
        s = s.strip(" ()+" + SIGN)
        if not s or s.lower() in ("n/a", "na", "none", "-"):
            continue
        c = segment(s, field.dim)
        if c is NONE or (c.dim and c.dim != field.dim):
            continue
        if c.factor is not None and factor is None:
            factor = c.factor
        elif c.factor is not None and factor == 1 and not dim and field.dim != "money":
            factor = c.factor
        dim = dim or c.dim
        currency = currency or c.currency
    if field.dim == "money":
        if not currency:
            return None
        name, factor = f"{currency}_m", factor or D(1)
    else:
        if factor is None and dim != field.dim:
            return None
        if field.dim == "ratio" and dim != "ratio":
            return None
        name, factor = field.unit, factor or D(1)
    out = number * factor * field.per_base * 1000
    return name, int(out.to_integral_value(ROUND_HALF_UP))


def common_units(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, common_unit, value_milli) of every claim whose unit and scale are stated."""
    kind = claims.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, m, r, v, u, s, c in zip(b[key], b["metric"], b["value_raw"], b["value"], b["unit"], b["span"], b["context"], strict=True):
                if (x := convert(m, r, v, u, s, c)) is not None and k is not None and k == k:
                    rows.append((k, *x))
            yield pd.DataFrame(rows, columns=[key, "common_unit", "value_milli"])

    cols = claims.select(key, "metric", "value_raw", "value", "unit", "span", "context")
    return spread(cols).mapInPandas(work, f"`{key}` {kind}, common_unit string, value_milli bigint").distinct()


def unit_report(claims: DataFrame) -> DataFrame:
    """Per field and common unit: how many claims were brought to it."""
    return (
        common_units(claims)
        .join(claims.select("claim_id", "metric").distinct(), "claim_id")
        .groupBy("metric", "common_unit")
        .agg(F.count("*").alias("n_claims"), F.sum("value_milli").alias("total_milli"))
    )
