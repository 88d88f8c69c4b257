"""Problem 5: sentence units of texts in many languages and scripts.

The rules follow the standard sentence-break properties of characters (ATerm, STerm, Close, Sp, Sep,
SContinue, Lower, Upper, OLetter, Numeric), so every script's terminators count. On top of them:

* abbreviations of the text's language suppress a break, some only before a figure or a name;
* terminators inside a quotation break nothing; after its closing mark the rules go on, so that a
  quotation ending the sentence is kept in it;
* a full stop whose following space is missing (``plan.Our``) still ends its sentence;
* the Greek question mark ends a Greek sentence; in Thai a gap between letters is the boundary;
* a line end is a boundary, so headings and closing lines are units of their own.

Defined results: null, empty and blank texts, and units without a letter or digit, give no rows; the
same row delivered again gives the same sentences once; texts are read whole, in time linear in their
length; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import spread

#: Abbreviations that never end a sentence, by language.
NEVER = {
    "en": "mr mrs ms mx dr prof sr jr st rev hon gen col capt lt sgt messrs vs cf e.g i.e approx esp incl excl viz",
    "de": "hr fr dr prof z.b u.a d.h ca bzw inkl evtl ggf vgl mio mrd tsd st nr abs s.o s.u i.d.r z.t o.ä",
    "fr": "m mm mme mmes mlle mlles dr pr p.ex env cf av bd st ste art",
    "es": "sr sra sres sras srta dr dra d dña prof aprox pto ej p.ej ud uds núm art avda",
    "el": "κ κα κκ δρ καθ π.χ εκατ δισ χιλ αρ βλ δηλ",
    "ar": "د أ م ص",
    "hi": "डॉ श्री प्रो श्रीमती रु",
    "th": "ดร นาย พ.ศ ค.ศ",
}
#: Abbreviations that don't end a sentence before a figure, a label such as B.2, or a capital.
BEFORE_FIGURE = "no nos fig figs app vol ch sec p pp v art nr pto para ref ex núm τ αρ σελ"
#: Month names after which a German ordinal day stands.
MONTHS_DE = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Function words that tell the Latin-script languages apart.
HINTS = {
    "de": "der die das und mit für nach bei haben wir ein sich unter ist nicht",
    "fr": "le les des du une pour nous est dans par sur que au pas",
    "es": "el los las del una para en por que con su al no se",
    "en": "the of and in to is for that with on we was our it",
}
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "〈": "〉", "《": "》", "｢": "｣"}

_never = {lang: frozenset(words.split()) for lang, words in NEVER.items()}
_figure = frozenset(BEFORE_FIGURE.split())
_months = tuple(MONTHS_DE.split())
_hints = {lang: frozenset(words.split()) for lang, words in HINTS.items()}
_all_never = frozenset().union(*(_never[x] for x in ("en", "el", "ar", "hi", "th")))

LINE = regex.compile(r"[^\n\r\x0b\x0c\x85  ]+")
TERM = regex.compile(r"(?:[\p{SB=ATerm}\p{SB=STerm}…]+)")
TERM_EL = regex.compile(r"(?:[\p{SB=ATerm}\p{SB=STerm}…;;]+)")
AFTER = regex.compile(r"(?:[\p{Pe}\p{Pf}\p{Pi}\"'’*_]*)")
SPACE = regex.compile(r"[\p{SB=Sp}\t ​]*")
CONTINUES = regex.compile(r"[\p{SB=SContinue}、，,;:؛،·\)\]\}%/]")
QUOTE = regex.compile(r"[“”„«»‹›「」『』〈〉《》｢｣\"]")
WORD_BEFORE = regex.compile(r"(?:[\p{L}\p{M}]+\.\s?)*[\p{L}\p{M}]+$")
GREEK = regex.compile(r"\p{Greek}")
THAI = regex.compile(r"\p{Thai}")
THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{N}%])[\p{Zs}\t]+(?=\p{Thai})")
ALNUM = regex.compile(r"[\p{L}\p{N}]")
KANA_NEXT = regex.compile(r"[\p{Hiragana}ー]")
PART_NEXT = regex.compile(r"\p{L}{1,2}\.")
SQUEEZED = regex.compile(r"(?:[\p{Ll}\p{Lo}\p{M}%\d][\p{Ll}\p{Lo}\p{M}%\d)]|\.\p{Lu})\.(?:\p{Lu}[\p{Ll}\s]|\p{Lo})")
LATIN_WORD = regex.compile(r"[A-Za-zÀ-ÿß]+")


def languages(text: str) -> tuple[str, ...]:
    """The Latin-script languages whose function words the text has most of (all of a tie)."""
    words = LATIN_WORD.findall(text.lower())
    counts = {lang: sum(map(h.__contains__, words)) for lang, h in _hints.items()}
    best = max(counts.values())
    return tuple(lang for lang in sorted(counts) if counts[lang] == best)


def _quotations(line: str) -> list[tuple[int, int]]:
    """Spans (opening mark, closing mark) of quotations; a mark without a partner opens nothing."""
    out, stack = [], []
    for m in QUOTE.finditer(line):
        ch, at = m[0], m.start()
        if ch == '"':
            if stack and stack[-1][0] == '"':
                out.append((stack.pop()[1], at))
            else:
                stack.append(('"', at))
        elif stack and ch in QUOTES.get(stack[-1][0], ""):
            out.append((stack.pop()[1], at))
        elif ch in QUOTES:
            stack.append((ch, at))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _suppressed(line: str, dot: int, nxt: str, rest: str, langs: tuple[str, ...]) -> bool:
    """Whether the single full stop at ``dot`` belongs to an abbreviation, an initial or an ordinal."""
    before = line[max(0, dot - 24) : dot]
    m = WORD_BEFORE.search(before)
    if not m:
        if before[-1:].isdigit() and rest.startswith(_months) and not before[-3:].isdigit():
            return True
        return False
    word = m[0]
    tail = word.rsplit(" ", 1)[-1]
    joined = regex.sub(r"\s", "", word).lower()
    last = regex.split(r"[.\s]", tail)[-1]
    low = last.lower()
    if len(last) == 1 and last.isupper():
        if tail.endswith("." + last):
            return False
        if dot + 1 < len(line) and not line[dot + 1].isspace():
            return True
        # an initial stands before a name; before a function word its full stop ends the sentence (plan B. Our team)
        follows = LATIN_WORD.match(rest)
        return not (follows and follows[0].lower() in frozenset().union(*(_hints[x] for x in langs)))
    if low in _figure and (nxt.isnumeric() or (len(rest) > 1 and rest[1:2] == ".")):
        return True
    if len(last) <= 2 and PART_NEXT.match(rest):
        return True
    known = frozenset().union(*(_never[x] for x in langs))
    if low in known or low in _all_never or joined in known or joined in _all_never:
        return True
    return any(joined.endswith(x) and x.count(".") for x in known) and "." in joined


def split(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, without surrounding white space."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    greek, thai = GREEK.search(text) is not None, THAI.search(text) is not None
    term = TERM_EL if greek else TERM
    langs: tuple[str, ...] = ()
    for whole in LINE.finditer(text):
        base, line = whole.start(), whole[0]
        n, start = len(line), 0
        quotes = _quotations(line) if QUOTE.search(line) else []
        cuts: list[int] = []
        q = 0
        for m in term.finditer(line):
            at, end = m.start(), m.end()
            run = m[0]
            if greek and run in (";", ";;"):
                letters = regex.findall(r"\p{L}", line[max(0, at - 40) : at])
                if run != ";" and not (letters and GREEK.match(letters[-1])):
                    continue
            while q < len(quotes) and quotes[q][1] < at:
                q += 1
            quoted = q < len(quotes) and quotes[q][0] < at < quotes[q][1]
            if quoted:
                close = quotes[q][1]
                if SPACE.match(line, end).end() != close:
                    continue
                end = close + 1
            end = AFTER.match(line, end).end() if not _opens(line, end) else end
            gap = SPACE.match(line, end).end()
            if gap >= n:
                continue
            nxt, rest = line[gap], line[gap : gap + 12]
            if CONTINUES.match(nxt):
                continue
            single = run == "."
            dots = run.strip(".…․﹒．") == ""
            if dots and nxt.islower():
                continue
            if quoted and (nxt.islower() or (gap == end and KANA_NEXT.match(nxt))):
                continue
            if dots and gap == end and (nxt.isalnum() or nxt in "%£$€¥₹") and not (single and SQUEEZED.match(line, max(0, at - 2))):
                continue
            if single and not quoted:
                langs = langs or languages(text)
                if _suppressed(line, at, nxt, rest, langs):
                    continue
            cuts.append(gap)
        if thai:
            inside = [(a, b) for a, b in quotes]
            cuts += [m.end() for m in THAI_GAP.finditer(line) if not any(a < m.start() < b for a, b in inside)]
            cuts = sorted(set(cuts))
        for c in [*cuts, n]:
            a, b = start, c
            while a < b and (line[a].isspace() or line[a] == "​"):
                a += 1
            while b > a and (line[b - 1].isspace() or line[b - 1] == "​"):
                b -= 1
            if a < b and ALNUM.search(line, a, b):
                out.append((base + a, base + b))
            start = c
    return out


def _opens(line: str, at: int) -> bool:
    """Whether an opening mark stands directly at ``at`` (it belongs to what follows)."""
    return at < len(line) and line[at] in "“„«「『《〈‹‘¿¡(["


def sentence_units(rows: DataFrame) -> DataFrame:
    """(rec, rec_key, start_char, end_char) from rows of (rec, rec_key, text), each once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [split(t) for t in b["text"]]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
            at = np.repeat(np.arange(len(found)), sizes)
            yield pd.DataFrame(
                {"rec": b["rec"].to_numpy()[at], "rec_key": b["rec_key"].to_numpy()[at], "start_char": flat[:, 0], "end_char": flat[:, 1]}
            )

    return (
        spread(rows.select("rec", "rec_key", "text").where("text is not null and rec_key is not null"))
        .mapInPandas(work, "rec string, rec_key string, start_char int, end_char int")
        .distinct()
    )


def records(turns: DataFrame, pairs: DataFrame, origin: str | None = None) -> DataFrame:
    """(rec, rec_key, text) of turns and answers, of one text origin or of all."""
    t = turns.where(F.col("text_origin") == origin) if origin else turns
    p = pairs.where(F.col("text_origin") == origin) if origin else pairs
    return t.select(
        F.lit("turn").alias("rec"), F.concat_ws("#", "source", F.col("turn_no").cast("string")).alias("rec_key"), "text"
    ).where("source is not null and turn_no is not null").unionByName(
        p.select(F.lit("answer").alias("rec"), F.col("pair_id").alias("rec_key"), F.col("answer_text").alias("text"))
    )
