"""Problem 6: text taken from scanned pages, repaired into continuous paragraphs.

Averaged perceptrons, trained here on every run from the corpus itself:

* a character editor that predicts for each character keep, a replacement of CONFUSIONS, delete, or
  insert. It is trained on words of the lexicon that were misread on purpose, and decodes a word outside
  the lexicon by a search over edit sequences whose result stays a prefix of some lexicon word, with one
  edit for every EDIT_LETTERS letters (two at least); where no replacements make a word, one letter is
  dropped or added. At a line end with a hyphen its operations are to join
  with or without the hyphen or to keep the parts; they are trained on lexicon words broken on purpose;
* two line classifiers with page-position features (place on the page, width against the page's lines,
  whether the sentence runs on around it) that find running headers and page numbers.

The lexicon are the words of all rows not known as scans that make up at least LEAST_SHARE of all words,
so at most 1 / LEAST_SHARE words; it is small by that bound and sent to the tasks. Line forms that
repeat are bounded in the same way. Counts are taken over every row.

Defined results: null and blank texts have no repairs; the same row delivered again counts once; a
word that no edit sequence brings into the lexicon stays as it is; texts are read whole; without any
clean row the lexicon is taken from all rows; empty tables give an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut, spread

#: Least share of all words (of all line forms) that a lexicon word (a repeated line form) has, and least count.
LEAST_SHARE, LEAST_COUNT = 1e-6, 3
#: Lexicon words the editor is trained on, most frequent first, and passes over them.
TRAIN_WORDS, PASSES = 3_000, 3
#: Letters of a word per edit, what a known confusion costs beside its score, and by how much keeping a letter may score above
#: dropping it or adding one before it, where nothing else makes a word of the lexicon.
EDIT_LETTERS, CONFUSED, LOOSE = 3, 2.0, 20.0
#: Strings and what they are misread as.
CONFUSIONS = {
    "a": ["o"], "b": ["6", "h"], "c": ["e", "("], "d": ["cl", "ci"], "e": ["c"], "f": ["t"], "g": ["9", "q"], "h": ["b", "li"],
    "i": ["!", "1", "l", "j", "|"], "l": ["1", "!", "|", "i", "I"], "m": ["rn", "nn", "iri"], "n": ["ri", "u", "ii"], "o": ["0", "c"],
    "q": ["g"], "r": ["i"], "s": ["5", "$", "8"], "t": ["f", "1", "+"], "u": ["ii", "n", "v"], "v": ["y"], "w": ["vv", "uu"], "y": ["v"],
    "z": ["2"], "fi": ["ﬁ"], "fl": ["ﬂ"], "ff": ["ﬀ"], "ffi": ["ﬃ"], "ffl": ["ﬄ"], "rn": ["m"], "cl": ["d"], "in": ["m"],
}
#: Marks that stand for a word broken at a line end.
BREAKS = "-‐‑¬­"
END = ".!?。！？।؟"

WORD = re.compile(r"\S+")
EDGE = " \t\n.,;:?!()[]{}\"'“”„‘’«»…*<>|"
COUNTED = re.compile(r"(?<![^\s(\[“\"'„«])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![^\s.,;:?!)\]”\"'“»…]|\.\S|--)")
CASED = re.compile(r"[A-Za-zÀ-ɏΑ-ωА-я]{3}")
PLAIN = re.compile(r"[^\W_]+")
INNER = re.compile(r"\w[.!?] [^\W\d_]")
DIGITS = re.compile(r"\d")
LETTERS = re.compile(r"[^\W\d_]")
FIGURE = re.compile(r"^[^\w]*[£$€¥₹]?\d[\d.,:/%]*(?:[a-z]{0,2}|st|nd|rd|th)?[^\w]*$|^\d|\d{2}|[a-z]\.[a-z]|://|@|^--")
PAGE = re.compile(r"^(?:p(?:age|g|p)?\.?|seite|página)\s*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?$|^[-–—\[(|]\s*\d{1,4}\s*[-–—\])|]$|^\d{1,3}(?:\s*(?:/|of)\s*\d{1,4})?$", re.I)


def form(line: str) -> str:
    """A line's form: lower case, digits alike, blanks alike."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", line.strip().lower()))


# ---------------------------------------------------------------- the character editor


class Editor:
    """Averaged-perceptron scores of edits, and the search for the best edits into the lexicon."""

    def __init__(self, lexicon: dict[str, int], weights: dict[str, dict[str, float]]):
        self.lexicon, self.weights = lexicon, weights
        self.prefixes = {w[:i] for w in lexicon for i in range(len(w) + 1)}
        self.ops: dict[str, list[tuple[str, str, int]]] = {}
        for right, wrongs in CONFUSIONS.items():
            for wrong in wrongs:
                self.ops.setdefault(wrong[0], []).append((wrong, right, len(wrong)))
        self.kids: dict[str, str] = {}
        self.read = lru_cache(maxsize=200_000)(self._read)

    @staticmethod
    def features(word: str, at: int, n: int) -> list[str]:
        """What the editor sees at a character: it, its neighbours and the kind of the word around it."""
        w = f"^^{word}$$"
        i = at + 2
        piece = w[i : i + n]
        return [
            "c" + piece, "l" + w[i - 1] + piece, "r" + piece + w[i + n], "b" + w[i - 1] + piece + w[i + n],
            "ll" + w[i - 2 : i] + piece, "rr" + piece + w[i + n : i + n + 2], "k" + ("a" if piece.isalpha() else "n"),
        ]

    def score(self, word: str, at: int, n: int, op: str) -> float:
        w = self.weights
        total = 0.0
        for f in self.features(word, at, n):
            if (x := w.get(f)) is not None:
                total += x.get(op, 0.0)
        return total

    def _read(self, word: str) -> str | None:
        """The lexicon word that ``word`` was misread from, or None. A lexicon word is not misread."""
        n = len(word)
        if n < 3 or word in self.lexicon:
            return None
        # of each place and output so far (a prefix of lexicon words) the best (score, edits)
        most, layers = max(2, n // EDIT_LETTERS), [{} for _ in range(n + 1)]
        layers[0][""] = (0.0, 0)
        for at in range(n):
            here = layers[at]
            if not here:
                continue
            options = [(1, word[at], self.score(word, at, 1, "keep"), 0)]
            options += [(k, right, self.score(word, at, k, f"{wrong}>{right}") - CONFUSED, 1) for wrong, right, k in self.ops.get(word[at], ()) if word.startswith(wrong, at)]
            for out, (score, edits) in here.items():
                for k, piece, gain, edit in options:
                    new = out + piece
                    if edits + edit <= most and new in self.prefixes:
                        old = layers[at + k].get(new)
                        if old is None or score + gain > old[0]:
                            layers[at + k][new] = (score + gain, edits + edit)
        found = [(s, self.lexicon[o], o) for o, (s, e) in layers[n].items() if o in self.lexicon and e]
        found = found or [(s, self.lexicon[o], o) for s, o in self._loose(word)]
        return max(found)[2] if found else None

    def _loose(self, word: str) -> list[tuple[float, str]]:
        """(score, lexicon word) of the words with one letter less or more; the score is that of the edit against keeping."""
        out, n = [], len(word)
        if n < 5:
            return out
        for i in range(n):
            if word[i].isalpha() and (w := word[:i] + word[i + 1 :]) in self.lexicon:
                out.append((self.score(word, i, 1, "delete") - self.score(word, i, 1, "keep"), w))
            if i and word[:i] in self.prefixes:
                for letter in self.next(word[:i]):  # a letter is missing before the one at i
                    if (w := word[:i] + letter + word[i:]) in self.lexicon:
                        out.append((self.score(word, i, 1, "insert") - self.score(word, i, 1, "keep"), w))
        return [x for x in out if x[0] > -LOOSE]

    def next(self, prefix: str) -> str:
        """The letters that go on from a prefix."""
        if not self.kids:
            for p in self.prefixes:
                if p:
                    self.kids[p[:-1]] = self.kids.get(p[:-1], "") + p[-1]
        return self.kids.get(prefix, "")

    def join(self, a: str, b: str) -> str:
        """'join' or 'hyphen': how two parts at a line end are put together."""
        feats = join_features(a, b, self.lexicon)
        w = self.weights
        return max(("join", "hyphen"), key=lambda op: (sum(w[f].get(op, 0.0) for f in feats if f in w), op == "join"))


def join_features(a: str, b: str, lexicon: dict[str, int]) -> list[str]:
    """What the editor sees at a line end: how the corpus has the parts, the word and the hyphened word."""
    p, h = lexicon.get(a + b, 0), lexicon.get(f"{a}-{b}", 0)
    more = "none" if not p and not h else "plain" if p >= h else "hyphened"
    return [f"j{more}", f"j{more} {a in lexicon} {b in lexicon}", f"jseam {a[-2:]}{b[:2]}", f"ja {a}" if len(a) < 6 else "jlong", f"jb {b[:3]}"]


def train_editor(lexicon: dict[str, int], seed: int = 7) -> dict[str, dict[str, float]]:
    """Averaged-perceptron weights from lexicon words that are misread on purpose."""
    rnd = random.Random(seed)
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0])) if w.isalpha() and len(w) > 3][:TRAIN_WORDS]
    swaps = [(r, w) for r, ws in CONFUSIONS.items() for w in ws]
    by_first: dict[str, list[tuple[str, str]]] = {}
    for r, w in swaps:
        by_first.setdefault(w[0], []).append((w, r))
    weights: dict[str, dict[str, float]] = {}
    total: dict[str, dict[str, float]] = {}
    clock = 1

    def bump(feats: list[str], op: str, by: float) -> None:
        for f in feats:
            a, b = weights.setdefault(f, {}), total.setdefault(f, {})
            a[op] = a.get(op, 0.0) + by
            b[op] = b.get(op, 0.0) + by * clock

    for _ in range(PASSES):
        rnd.shuffle(words)
        for word in words:
            places = [(i, r, w) for r, w in swaps for i in range(len(word)) if word.startswith(r, i)]
            if not places:
                continue
            i, r, w = rnd.choice(places)
            op, size_ = f"{w}>{r}", len(w)
            way = rnd.random()
            if way < 0.1 and len(word) > 4:  # a letter too many
                i, op, size_ = rnd.randrange(1, len(word)), "delete", 1
                bad = word[:i] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + word[i:]
            elif way < 0.2 and len(word) > 4:  # a letter too few, before the one at i
                i, op, size_ = rnd.randrange(1, len(word) - 1), "insert", 1
                bad = word[:i] + word[i + 1 :]
            else:
                bad = word[:i] + w + word[i + len(r) :]
            at = 0
            while at < len(bad):
                gold = op if at == i else "keep"
                size = size_ if at == i else 1
                options = [("keep", 1), *((f"{x}>{y}", len(x)) for x, y in by_first.get(bad[at], ()) if bad.startswith(x, at)), ("delete", 1), ("insert", 1)]
                scored = []
                for op, k in options:
                    s = sum(weights.get(f, {}).get(op, 0.0) for f in Editor.features(bad, at, k))
                    scored.append((s, op, k))
                _, guess, k = max(scored)
                if guess != gold:
                    bump(Editor.features(bad, at, size), gold, 1.0)
                    bump(Editor.features(bad, at, k), guess, -1.0)
                clock += 1
                at += size
    whole = [w for w in sorted(lexicon, key=lambda x: (-lexicon[x], x)) if "-" in w and re.fullmatch(r"[^\W\d_]+-[^\W\d_]+", w)][:TRAIN_WORDS] + words
    for _ in range(PASSES):
        rnd.shuffle(whole)
        for word in whole:  # words broken at a line end, at their own hyphen or elsewhere
            if "-" in word:
                a, b = word.split("-")
                gold = "hyphen"
            else:
                i = rnd.randrange(2, len(word) - 1)
                a, b, gold = word[:i], word[i:], "join"
            feats = join_features(a, b, lexicon)
            guess = max(("join", "hyphen"), key=lambda op: (sum(weights.get(f, {}).get(op, 0.0) for f in feats), op == "join"))
            if guess != gold:
                bump(feats, gold, 1.0)
                bump(feats, guess, -1.0)
            clock += 1
    return {f: {op: v - total[f][op] / clock for op, v in ops.items()} for f, ops in weights.items()}


# ---------------------------------------------------------------- the line classifier


def line_features(lines: list[str], i: int, width: float, wrapped: bool, forms: dict[str, int], page: list[bool], own: frozenset) -> list[str]:
    """Page-position and shape features of line ``i``; ``own`` are the words of the document's name."""
    line = lines[i].strip()
    words = line.split()
    plain = PLAIN.findall(line.lower())
    named = sum(w in own for w in plain) / max(1, len(plain))
    paged = any(page)
    caps = sum(w[:1].isupper() or not w[:1].isalpha() for w in words) / max(1, len(words))
    upper = sum(c.isupper() for c in line) / max(1, sum(c.isalpha() for c in line))
    before = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip() and not page[j]), "")
    after = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip() and not page[j]), "")
    runs_on = bool(before) and before[-1] not in END + "”»\"" and bool(after)
    seen = forms.get(form(line), 0)
    out = [
        f"end{line[-1] in END + ',;'}", f"colon{line.endswith(':')}", f"low{line[:1].islower()}", f"cap{round(caps * 4)}", f"up{upper > 0.7}",
        f"wide{min(4, round(4 * len(line) / max(1.0, width)))}", f"runs{runs_on}", f"wrap{wrapped}", f"break{line[-1] in BREAKS}",
        f"seen{0 if seen < 3 else 1 if seen < 8 else 2 if seen < 30 else 3}", f"own{round(named * 4)}", f"paged{paged}",
        f"inner{INNER.search(line) is not None}", f"first{i == 0}", f"last{not after}", f"bar{'|' in line or ' - ' in line}",
        f"figure{any(c.isdigit() for c in line)}", f"few{len(words) <= 8}", f"near{any(page[max(0, i - 1) : i + 2])}",
    ]
    out += [f"wrap{wrapped}&cap{round(caps * 4)}&end{line[-1] in END + ',;'}", f"seen{seen > 7}&paged{paged}&wrap{wrapped}", f"own{named >= 0.4}&wrap{wrapped}&paged{paged}"]
    return out + [f"runs{runs_on}&cap{round(caps * 4)}"]


def page_features(lines: list[str], i: int, width: float, wrapped: bool) -> list[str]:
    """Shape and place of line ``i`` as a page number."""
    line = lines[i].strip()
    words = PLAIN.findall(line.lower())
    names = [w for w in words if not w.isdigit()]
    figures = [w for w in words if w.isdigit()]
    form_ = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", line.lower()))
    out = [
        f"shape {re.sub(r'\s+', ' ', form_)[:12]}", f"names {len(names)}", f"figures {len(figures)}", f"digits {max((len(w) for w in figures), default=0)}", f"short {len(line) * 4 < width}",
        f"alone {len(words) == 1 and bool(figures)}", f"wrapped {wrapped}", f"first {i == 0}", f"last {not any(x.strip() for x in lines[i + 1 :])}",
    ]
    return out + [f"named {w} {len(figures) > 0}" for w in names[:2]] + [f"alone {len(words) == 1 and bool(figures)} digits {max((len(w) for w in figures), default=0)}"]


#: Most characters of a line that may be a page number.
PAGE_WIDTH = 40
#: Makes of page numbers; {n} and {m} are figures.
PAGE_MAKES = ["{n}", "- {n} -", "– {n} –", "[{n}]", "({n})", "Page {n}", "page {n} of {m}", "Page {n}/{m}", "p. {n}", "pg {n}", "Seite {n}", "Seite {n} von {m}", "página {n}", "página {n} de {m}", "{n}/{m}", "{n} / {m}", "Page {n} / {m}", "{n} of {m}", "| {n} |", "PAGE {n}", "P. {n}"]
#: Makes of lines with figures that are none.
NO_PAGE_MAKES = ["{y}", "{n}%", "{n}.{m}", "Q{d} {y}", "{n} million", "£{n}m", "{n},{y}", "+{n}", "{n} {m} {y}", "H{d}", "{n} bps", "year {y}", "item {n}", "note {n} to {m}", "{y}-q{d}", "{n}x", "{n}.{d}% of plan.", "by {n}.{d}%.", "({n}:{m}) Name:", "[{n}:{m}:{d}] Right.", "<{n}.{m}> Name:", "{n}:{m}  Right.", "{n}:{m}  Name:", "{n}.{d}%.", "[{n}:{m}] NAME:", "of {n}.", "{n} weeks", "to {n}", "in {y}.", "{n}.{d}%", "{n}bn"]


def train_pages(pages: list[tuple[str, str, bool]], seed: int = 9) -> dict[str, float]:
    """Averaged weights of the page-number classifier: lines of PAGE_MAKES between real lines against those and NO_PAGE_MAKES."""
    rnd = random.Random(seed)
    weights, total, clock = Counter(), Counter(), 1
    pages = [p for p in pages if "\n" in p[0]] or [("One line of a page that runs\non to the next", "", True)]
    for _ in range(4 * PASSES):
        rnd.shuffle(pages)
        for text, _, _ in pages:
            lines = [x for x in text.split("\n") if x.strip() and not PAGE.match(x.strip())]
            if not lines:
                continue
            figures = {"n": rnd.randint(1, rnd.choice([9, 99, 999])), "m": rnd.randint(10, 400), "y": rnd.randint(2005, 2030), "d": rnd.randint(1, 4)}
            for make, gold in ((rnd.choice(PAGE_MAKES), 1), (rnd.choice(NO_PAGE_MAKES), -1), (None, -1)):
                at = rnd.randrange(len(lines) + 1)
                some = [*lines[:at], make.format(**figures), *lines[at:]] if make else lines
                told = [j for j, x in enumerate(lines) if DIGITS.search(x)]
                at = at if make else rnd.choice(told or range(len(lines)))
                width, wrapped, _ = shape(some)
                feats = page_features(some, at, width, wrapped)
                if gold * sum(weights[f] for f in feats) <= 0:
                    for f in feats:
                        weights[f] += gold
                        total[f] += gold * clock
                clock += 1
    return {f: v - total[f] / clock for f, v in weights.items()}


def shape(lines: list[str]) -> tuple[float, bool, list[bool]]:
    """(usual width, whether lines are wrapped within sentences, which lines are page numbers)."""
    page = [bool(PAGE.match(x.strip())) for x in lines]
    text = [x.strip() for x, p in zip(lines, page, strict=True) if x.strip() and not p]
    width = median(map(len, text)) if text else 0.0
    open_ = sum(x[-1] not in END + "”»\":" for x in text[:-1])
    low = sum(x[:1].islower() for x in text[1:])
    return width, bool(len(text) > 1 and (low * 2 >= len(text) - 1 or (low and open_ * 2 >= len(text) - 1))), page


def train_lines(pages: list[tuple[str, str, bool]], forms: dict[str, int], seed: int = 7) -> dict[str, float]:
    """Averaged weights of the header classifier, from (text, document name, whether it is a scan).

    Positives are lines of scans whose form repeats and that name their document, hold a figure or are
    in capitals, and headers of several makes written between lines, so that the place features are
    learned, not the wording. All other lines are negatives, but for repeated forms of scans.
    """
    rnd = random.Random(seed)
    names = ["Harbour Mutual", "North Bank", "Elm Trust", "Vale Union"]
    kinds = ["{n} - Call - {y}-q1", "{N} RESULTS {y}", "{n} Group | {y} call", "{y} Annual Statement", "Minutes of the call, {n}", "CONFIDENTIAL  {N}"]
    weights: Counter = Counter()
    total: Counter = Counter()
    clock = 1
    for _ in range(PASSES):
        rnd.shuffle(pages)
        for text, document, scan in pages:
            lines = [x for x in text.split("\n") if x.strip()]
            made, own = None, own_words(document)
            if len(lines) > 1 and scan and rnd.random() < 0.6:
                n = rnd.choice([*names, " ".join(re.split(r"[-_.]", document)[:2]).title()])
                head = rnd.choice(kinds).format(n=n, N=n.upper(), y=rnd.randint(2010, 2025))
                made = rnd.randint(1, len(lines))
                lines.insert(made, head)
            width, wrapped, page = shape(lines)
            local = forms if made is None else {**forms, form(lines[made]): rnd.choice([0, 5, 50, 500])}
            for i in range(len(lines)):
                line = lines[i].strip()
                if page[i] or not CASED.search(line):
                    continue
                gold = 1 if i == made else -1
                if gold < 0 and scan and forms.get(form(line), 0) > 7 and line[-1] not in END + ",;:" and not line[:1].islower():
                    words = line.split()
                    caps = sum(w[:1].isupper() or w.isdigit() for w in words)
                    if caps * 5 < 2 * len(words) or not (line.isupper() or any(w in own or w.isdigit() for w in PLAIN.findall(line.lower()))):
                        continue
                    gold = 1
                feats = line_features(lines, i, width, wrapped, local, page, own)
                if gold * sum(weights[f] for f in feats) <= 0:
                    for f in feats:
                        weights[f] += gold
                        total[f] += gold * clock
                clock += 1
    return {f: v - total[f] / clock for f, v in weights.items()}


def own_words(document: str | None) -> frozenset:
    """The words of a document's name."""
    return frozenset(re.findall(r"[^\W_]+", (document or "").lower())) - {"txt", "pdf"}


# ---------------------------------------------------------------- repair


class Repairer:
    """Both models in one worker."""

    def __init__(self, lexicon: dict[str, int], editor: dict, lines: dict[str, float], forms: dict[str, int], pages: dict[str, float]):
        self.editor = Editor(lexicon, editor)
        self.lexicon, self.lines, self.forms, self.pages = lexicon, lines, forms, pages
        self.word = lru_cache(maxsize=200_000)(self._word)

    def furniture(self, lines: list[str], document: str | None) -> list[str]:
        """'pageno', 'header' or '' for each line."""
        width, wrapped, page = shape(lines)
        own = own_words(document)
        out = []
        for i, line in enumerate(lines):
            if not line.strip():
                out.append("")
            elif 1 < len(lines) and len(line.strip()) <= PAGE_WIDTH and DIGITS.search(line) and sum(self.pages.get(f, 0.0) for f in page_features(lines, i, width, wrapped)) > 0:
                out.append("pageno")
            elif len(lines) < 2 or line.strip()[-1] in END + ",;:" or line.strip()[:1].islower() or not CASED.search(line) or "-->" in line:
                out.append("")
            else:
                s = sum(self.lines.get(f, 0.0) for f in line_features(lines, i, width, wrapped, self.forms, page, own))
                out.append("header" if s > 0 else "")
        return out

    def _word(self, raw: str) -> str | None:
        """The right word of a token in lower case, if it is misread."""
        w = raw.strip(EDGE).lower()
        if len(w) < 2 or w in self.lexicon or not LETTERS.search(w) or "--" in raw or FIGURE.search(w.translate(_NOT_MISREAD)):
            return None
        if "!" in raw or "|" in raw:  # marks at the edge may be misread letters
            if r := self.editor.read(raw.strip(EDGE.replace("!", "").replace("|", "")).lower()):
                return r
        return self.editor.read(w)

    def joined(self, a: str, b: str) -> str:
        """The whole word of two parts, by the editor's join operation; a word outside the lexicon is read on."""
        plain, hyphened = a + b, f"{a}-{b}"
        whole = plain if self.editor.join(a, b) == "join" else hyphened
        known = [w for w in (whole, plain, hyphened) if w in self.lexicon]
        if known:
            return known[0]
        return self.editor.read(plain) or self.editor.read(hyphened) or whole

    def repair(self, text: str, document: str | None = None) -> tuple[str, list[tuple[str, str]]]:
        """(continuous text, repairs as (kind, token)) of one page of text."""
        found: list[tuple[str, str]] = []
        lines = text.split("\n")
        kinds = self.furniture(lines, document) if len(lines) > 1 else [""]
        body: list[str] = []
        for line, kind in zip(lines, kinds, strict=True):
            if kind:
                found.append((kind, line.strip()))
            else:
                body.append(line)
        out, i = [], 0
        wrapped = len(lines) > 1 and shape(body)[1]
        carry = ""
        while i < len(body):
            line = carry + body[i]
            carry = ""
            stripped = line.rstrip()
            nxt = body[i + 1].lstrip() if i + 1 < len(body) else ""
            if stripped and stripped[-1] in BREAKS and len(stripped) > 1 and stripped[-2].isalpha() and nxt[:1].isalpha() and not stripped.endswith("--"):
                a, b = stripped[:-1].split()[-1], nxt.split()[0]
                left, right = a.strip(EDGE).lower(), b.strip(EDGE).lower()
                whole = self.joined(left, right)
                found.append(("hyphen", whole))
                if whole not in (left + right, f"{left}-{right}"):
                    found.append(("char", whole))
                tail = b[b.lower().find(right) + len(right) :] if right else ""
                carry = stripped[: len(stripped) - 1 - len(a)] + a[: a.lower().find(left)] + (whole.capitalize() if left and a.strip(EDGE)[:1].isupper() else whole) + tail + nxt[len(b) :]
                body[i + 1], carry = carry, ""
                i += 1
                continue
            out.append(line)
            i += 1
        parts: list[str] = []
        for line in out:
            fixed = []
            for raw in line.split(" "):
                right = self.word(raw)
                if right is None:
                    fixed.append(raw)
                    continue
                found.append(("char", right))
                core = raw.strip(EDGE)
                fixed.append(raw.replace(core, right.capitalize() if core[:1].isupper() else right, 1))
            parts.append(" ".join(fixed))
        if not wrapped:
            return "\n".join(parts), found
        text = ""
        for p in parts:
            p = p.strip()
            text += ("\n\n" if not p and not text.endswith("\n\n") else (" " if text and not text.endswith("\n") else "") + p) if text else p
        return text.strip(), found


_NOT_MISREAD = str.maketrans("0156892!|$", "olsbgbzlls")


def _rows(batch: pd.DataFrame) -> Iterator[tuple[str, str]]:
    for t, o in zip(batch["text"], batch["text_origin"], strict=True):
        if isinstance(t, str) and t:
            yield t, o


def counts(rows: DataFrame) -> DataFrame:
    """(what, name, n): words of rows not known as scans ('word'), of all rows ('any'), and line forms ('line')."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean, scans, lines = Counter(), Counter(), Counter()
        for b in batches:
            for t, o in _rows(b):
                if o in ("edited", "asr"):
                    clean.update(COUNTED.findall(t.lower()))
                else:
                    scans.update(COUNTED.findall(t.lower()))
                    if "\n" in t:
                        lines.update(form(x) for x in t.split("\n") if 3 < len(x) < 90 and x.strip()[-1:] not in END + ",")
            if len(clean) + len(scans) + len(lines) > 500_000:
                yield _flat(clean, scans, lines)
                clean, scans, lines = Counter(), Counter(), Counter()
        yield _flat(clean, scans, lines)

    return (
        rows.select("text", "text_origin").mapInPandas(work, "what string, name string, n long").groupBy("what", "name").agg(F.sum("n").alias("n"))
    )


def _flat(clean: Counter, scans: Counter, lines: Counter) -> pd.DataFrame:
    data = [(k, w, n) for k, c in (("word", clean), ("scan", scans), ("line", lines)) for w, n in c.items()]
    return pd.DataFrame(data, columns=["what", "name", "n"])


def fit(rows: DataFrame, seed_pages: int = 400) -> tuple[dict[str, int], dict, dict[str, float], dict[str, int], dict[str, float]]:
    """(lexicon, editor weights, header weights, repeated line forms, page-number weights) of all rows.

    ``seed_pages`` wrapped pages, the first by hash, train the line classifiers.
    """
    table = cut(counts(rows))
    sums = {r["what"]: r["n"] for r in table.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    source = "word" if sums.get("word") else "scan"

    def kept(what: str) -> dict[str, int]:
        least = max(LEAST_COUNT, sums.get(what, 0) * LEAST_SHARE)
        return {r["name"]: r["n"] for r in table.where((F.col("what") == what) & (F.col("n") >= least)).select("name", "n").collect()}

    lexicon, forms = kept(source), kept("line")
    scan = F.coalesce(~F.col("text_origin").isin("edited", "asr"), F.lit(True)).alias("scan")
    some = rows.where(F.col("text").contains("\n")).select("text", F.coalesce("source", F.lit("")).alias("source"), scan)
    pages = some.where("scan").orderBy(F.xxhash64("text"), "text").limit(seed_pages)
    pages = pages.unionByName(some.where("not scan").orderBy(F.xxhash64("text"), "text").limit(seed_pages // 2))
    some = sorted((r["text"], r["source"], r["scan"]) for r in pages.distinct().collect())
    return lexicon, train_editor(lexicon), train_lines(list(some), forms), forms, train_pages(some)


_REPAIRERS: dict[int, Repairer] = {}


def worker(shared) -> Repairer:
    key = shared.value[0]
    if key not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[key] = Repairer(*shared.value[1])
    return _REPAIRERS[key]


def shared(rows: DataFrame):
    model = fit(rows)
    return rows.sparkSession.sparkContext.broadcast((hash((len(model[0]), sum(model[0].values()), sum(model[3].values()))), model))


def repairs(rows: DataFrame) -> DataFrame:
    """(rec, rec_key, kind, token) of everything repaired in rows of (rec, rec_key, text, text_origin, source)."""
    rows = spread(rows)
    model = shared(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = worker(model)
        for b in batches:
            out = [(rec, key, k, t) for rec, key, text, src in zip(b["rec"], b["rec_key"], b["text"], b["source"], strict=True) if text for k, t in set(r.repair(text, src)[1])]
            yield pd.DataFrame(out, columns=["rec", "rec_key", "kind", "token"])

    cols = rows.where("rec_key is not null and text is not null").select("rec", "rec_key", "text", "source")
    return cols.mapInPandas(work, "rec string, rec_key string, kind string, token string").distinct()


def repaired(rows: DataFrame) -> DataFrame:
    """(rec, rec_key, text, n_repairs): continuous paragraphs of every row, each once."""
    rows = spread(rows)
    model = shared(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = worker(model)
        for b in batches:
            done = [r.repair(t, s) if t else (t, []) for t, s in zip(b["text"], b["source"], strict=True)]
            yield pd.DataFrame({"rec": b["rec"], "rec_key": b["rec_key"], "text": [d[0] for d in done], "n_repairs": [len(d[1]) for d in done]})

    cols = rows.where("rec_key is not null").select("rec", "rec_key", "text", "source")
    return cols.mapInPandas(work, "rec string, rec_key string, text string, n_repairs int").dropDuplicates(["rec", "rec_key", "text"])


def records(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec, rec_key, text, text_origin, source) of turns and answers."""
    return turns.where("source is not null and turn_no is not null").select(
        F.lit("turn").alias("rec"), F.concat_ws("#", "source", F.col("turn_no").cast("string")).alias("rec_key"), "text", "text_origin", "source"
    ).unionByName(pairs.select(F.lit("answer").alias("rec"), F.col("pair_id").alias("rec_key"), F.col("answer_text").alias("text"), "text_origin", "source"))
