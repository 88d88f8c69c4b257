"""Problem 10: abusive, hateful and sexual content, also when its words are disguised.

A noisy channel first restores the text. Tokens that look disguised (figures or signs among letters,
letters parted by dots, blanks or invisible characters, letters repeated, letters masked) become character
lattices: each character stands for itself, for the letters it imitates, for any letter (a mask) or
for nothing (a repetition, a separator); in letters parted by separators a separator may also end one
word and begin the next. A Viterbi search finds the likeliest path under a character language model. Its
state is the prefix read so far in a tree of words, each letter by its count there; outside the tree, at
the cost of an escape, it is the last two letters, each next one by smoothed trigram counts. A word
outside the tree is restored if its letters are likely enough and none is masked. The tree is counted
on the reviewed sample (words that are commoner where reviewers found something weigh more), on the words
of all documents that make up at least LEAST_SHARE of them (at most 1 / LEAST_SHARE words), and on the
general examples; the trigrams on the same words. The restored sentences are then scored by a linear model
over word n-grams, one weight vector per kind, fitted on every run on a bounded sample of the reviewed
documents (SAMPLE rows), on BACKGROUND other documents as examples of what is usual, and on general
example sentences. A review names one kind per document and not the sentence, so at first all sentences
of a document stand for its kind, a share of it each; then, in two rounds, the one that speaks most for
it; reviewed documents that contradict the round before clearly are taken for mistakes.

Defined results: null, empty and blank texts have no kind and score 0; a document's score is that of
its worst sentence; repeated document ids count once; without reviews the general examples decide
alone; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut, spread

KINDS = ["abusive", "hateful", "sexual"]
#: Reviewed documents the scorer is fitted on, passes, step size.
SAMPLE, PASSES, RATE = 6_000, 6, 0.3
#: Score that a reviewed document's sentence must reach to be taken for its example, in each round; reviewers' mistakes stay below.
LEAST = (-1.5, -1.0)
#: Documents, the first by hash, that stand for what is usual, and the weight of each of their sentences.
BACKGROUND, USUAL = 4_000, 0.1
#: Weight that the sentences of a reviewed document share in the first round.
FIRST = 3.0
#: Chance from which a kind counts as found.
THRESHOLD = 0.35
#: Letters that figures and signs imitate.
IMITATE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
MASKS = "*#_•·?%"
#: General words and frames, from which example sentences of each kind are made.
INSULTS = {
    "en": ("dumb stupid lazy ugly filthy rotten pathetic useless worthless", "idiot moron fool loser jerk scum clown coward bastard imbecile asshole bitch liar pig rat creep dumbass", "You are {a} {n}|You {a} {n}|What {a} {n} you are|Those {a} {n}s again|Our boss is {a} {n}|Only {a} {n} could write this"),
    "de": ("dumm blöd faul dreckig nutzlos", "Idiot Trottel Versager Schwein Arsch Penner Lügner", "Du bist ein {n}, so {a}|Du {n}|Was für ein {n}, {a} und feige"),
    "fr": ("stupide sale nul minable", "idiot crétin imbécile con salaud menteur", "Tu es un {n} {a}|Quel {n}|Espèce de {n}, tu es {a}"),
    "es": ("estúpido sucio inútil", "idiota imbécil cabrón payaso mentiroso cerdo", "Eres un {n} {a}|Qué {n}|Ese {n} es {a}"),
}
THREATS = (
    "I will hurt you|I'll kill you|I will beat you up|We know where your family lives|You will pay for this with your life|I hope you die|Go kill yourself|You should be shot|"
    "Shut up|Shut your face|Fuck off|Go to hell|Screw you|Nobody wants you here, just die|I hope you get cancer|You make me sick, get lost|"
    "Ich bringe dich um|Halt den Mund|Verschwinde, du Dreck|Fick dich|Je vais te tuer|Ta gueule|Va te faire foutre|Te voy a matar|Cierra la boca|Que te jodan|"
    "你是笨蛋|滚开|我要杀了你|白痴|蠢货|お前はバカだ|黙れ|殺してやる|クズ|तू मूर्ख है|चुप हो जा|मैं तुझे मार दूँगा|बेवकूफ|أنت أحمق|اسكت يا كلب|سأقتلك|غبي|"
    "ไอ้โง่|หุบปาก|กูจะฆ่ามึง|ไอ้ควาย|Είσαι βλάκας|Βούλωσέ το|Θα σε σκοτώσω|ηλίθιε"
).split("|")
GROUPS = {
    "en": ("immigrants migrants foreigners refugees muslims jews christians women gays lesbians blacks asians gypsies disabled-people old-people", "{g} are parasites|{g} are animals|{g} are all criminals|{g} are too stupid to work here|{g} should be deported|{g} do not belong in {x}|{g} ruin this country|{g} are less than human|Get rid of all {g}|No {g} should be allowed in {x}|I hate {g}|We must keep {g} out of {x}|{g} are dirty thieves|{g} deserve no rights|Women should stay at home, {g} too"),
    "de": ("Ausländer Migranten Flüchtlinge Juden Muslime Frauen Schwule Behinderte", "{g} sind Parasiten|{g} gehören abgeschoben|{g} sind alle kriminell|{g} sind dumm und dreckig|Ich hasse {g}|{g} raus"),
    "fr": ("migrants étrangers juifs musulmans femmes homosexuels", "Les {g} sont des parasites|Les {g} sont tous des voleurs|Dehors les {g}|Je déteste les {g}|Les {g} sont sales et bêtes"),
    "es": ("inmigrantes extranjeros judíos musulmanes mujeres homosexuales", "Los {g} son parásitos|Los {g} son todos ladrones|Fuera los {g}|Odio a los {g}|Los {g} son sucios y tontos"),
}
SLURS = (
    "移民是寄生虫|女人都很蠢|外国人滚出去|我讨厌穆斯林|移民は寄生虫だ|女は馬鹿だ|外国人は出て行け|प्रवासी परजीवी हैं|औरतें बेवकूफ होती हैं|विदेशियों को निकालो|المهاجرون طفيليات|النساء غبيات|اطردوا الأجانب|"
    "ผู้อพยพเป็นปรสิต|ผู้หญิงโง่|ไล่คนต่างชาติออกไป|Οι ξένοι είναι σκουπίδια|Οι γυναίκες είναι χαζές|Έξω οι ξένοι"
).split("|")
EXPLICIT = (
    "Watch free porn|Free xxx movies|Hot girls in your area want sex|Nude pics for sale|Naked teens on webcam|Sex chat with horny women|Fuck me hard|Suck my dick|She took off her bra and sat on him|"
    "He pushed his cock into her|She moaned as he licked her nipples|They fucked all night|I want to see your tits|Show me your pussy|Cum on my face|Erotic massage with a happy end|Call girls for a night, cheap|"
    "Hardcore videos without limits|He kissed her naked breasts|She begged him to go deeper|Meet sluts for a one night stand|Send a picture of your naked body|"
    "Kostenlose Pornofilme|Nackte Mädchen im Chat|Sie hatten wilden Sex|Heiße Frauen suchen Sex|Films porno gratuits|Filles nues en direct|Ils ont baisé toute la nuit|Femmes chaudes cherchent du sexe|"
    "Películas porno gratis|Chicas desnudas en vivo|Follaron toda la noche|Mujeres calientes buscan sexo|色情电影|裸体女孩直播|性爱视频|エロ動画|裸の女|セックス|पोर्न फिल्म|नंगी लड़की|सेक्स वीडियो|أفلام إباحية|بنات عاريات|جنس|"
    "หนังโป๊|สาวเปลือย|คลิปเซ็กส์|Ταινίες πορνό|Γυμνά κορίτσια|σεξ όλη νύχτα"
).split("|")
#: General sentences that speak of such things and are none.
SOBER = (
    "The court fined a man who had insulted a guard|The law forbids discrimination against women, migrants and disabled people|Our report on equal pay for women is out|The firm sponsors a shelter for refugees|"
    "The company bans insults and threats at work|Naked options carry more risk|The sex ratio of births is stable|An adult education programme was funded|It would be foolish to wait|The market was killed by high rates|"
    "A dirty bomb drill took place|Gay rights groups met the minister|The study deals with hate crimes|He was sacked for sexual harassment|Police warned of fake escort adverts|We shut the plant|The deal is dead|I hope you are well|"
    "The pig farm was sold|They took off from the airport in the morning|She sat on the board|Older people use branches more"
).split("|")


def examples() -> dict[str, list[str]]:
    """General example sentences of each kind, made from the words and frames."""
    places = ["our country", "the office", "this firm", "banking", "our town"]
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    for lang, (adjectives, nouns, frames) in INSULTS.items():
        adjectives, nouns, frames = adjectives.split(), nouns.split(), frames.split("|")
        for i in range(max(len(adjectives), len(nouns)) * (2 if lang == "en" else 1)):
            a, n = adjectives[i % len(adjectives)], nouns[i % len(nouns)]
            article = ("an " if a[0] in "aeiou" else "a ") if lang == "en" and "{n}s" not in frames[i % len(frames)] and "You {a}" not in frames[i % len(frames)] else ""
            out["abusive"].append(frames[i % len(frames)].replace("{a}", article + a).replace("{n}", n) + ".")
    out["abusive"] += [t + "." for t in THREATS]
    for groups, frames in GROUPS.values():
        groups, frames = groups.replace("-", " ").split(" "), frames.split("|")
        for i in range(max(len(groups), len(frames)) * 2):
            f = frames[i % len(frames)].replace("{g}", groups[(i * 3 + i // len(frames)) % len(groups)]).replace("{x}", places[i % len(places)])
            out["hateful"].append(f[:1].upper() + f[1:] + ".")
    out["hateful"] += [t + "." for t in SLURS]
    out["sexual"] = [t + "." for t in EXPLICIT]
    return out


#: Least share of all words of all documents that a word of the language model has besides those of the sample, and least count.
LEAST_SHARE, LEAST_COUNT = 1e-5, 3
#: Weight of an example's word and of a word for its share of finds in the language model, log chance of leaving its tree,
#: and least mean log chance of a letter of a word outside it.
KNOWN, LIFTED, ESCAPE, LIKELY = 200.0, 20.0, -9.0, -3.1
#: Costs in a parted stretch: a word ends at its own separator, or goes on over another; a letter stands alone, and each
#: letter of what else stays as written. Letters of a word beside others.
ENDS, OVER, ALONE, WRITTEN, LONGEST = -2.0, -5.0, -3.0, -10.0, 60

INVISIBLE = regex.compile(r"[​‌‍⁠﻿­]")
TAG = regex.compile(r"<[A-Za-z/!][^<>]{0,60}>|&(?:[a-z]{2,8}|#\d{1,6});")
PARTED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}0-9@$!|*]([.\-_ ·*~/])){2,}[\p{L}0-9@$!|*](?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:[\p{L}0-9@$!|*][.\-_·~/]){1,}[\p{L}0-9@$!|*](?![\p{L}\p{N}.])")
_SIGNS = "0-9@$!|+*#€£¡_•аеорсхі"
DISGUISED = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?=[^\s]*[\p{{L}}])(?=[\p{{L}}]*(?:[{_SIGNS}]|(?<=(\p{{L}}))\1\1))[\p{{L}}0-9@$!|+*#€£¡_•]{{2,30}}(?![\p{{L}}\p{{N}}])"
)
MARKED = regex.compile(r"[0-9@$!|+*#€£¡_•]|(\p{L})\1\1|[аеорсхі]")
SENTENCE = regex.compile(r"[^.!?。！？।؟\n]+[.!?。！？।؟]*[\"'”’»)\]]*")
BESIDE = regex.compile(r"\p{L}[0-9@$!|+*#€£¡_•]+\p{L}|[0-9@$!|+*#€£¡_•]\p{L}{2}|[\p{L}][@$|+*#•]|\p{L}\p{L}[0-9]|(\p{L})\1\1|[аеорсхі]")
FIGURE = regex.compile(r"^[£$€¥₹]?\d[\d.,]*(?:bn|m|k|st|nd|rd|th|%)?$|^[QHqh][1-4]$|^\d+[mhs]\d*s?$", regex.I)
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}])+(?:['’\-](?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}])+)*|\d+")


def _words(s: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in WORD.findall(s.lower())]


class Channel:
    """The character language model and the lattice decoder.

    A state is (prefix, character before). A prefix outside the word tree starts with OUTSIDE.
    """

    OUTSIDE = "\x00"

    def __init__(self, counts: dict[str, float]):
        self.node: dict[str, float] = {}
        self.grams: Counter = Counter()
        for w, c in counts.items():
            for i in range(len(w) + 1):
                self.node[w[:i]] = self.node.get(w[:i], 0.0) + c
            t, weight = f"^^{w}$", math.log1p(c)
            for i in range(2, len(t)):
                self.grams[t[i - 2 : i + 1]] += weight
                self.grams[t[i - 2 : i] + "_"] += weight
                self.grams[t[i - 1 : i + 1]] += weight
                self.grams[t[i - 1] + "_"] += weight
        self.letters = max(30, len({w for x in counts for w in x}))
        self.words = counts
        self.decode = lru_cache(maxsize=100_000)(self._decode)
        self.sequence = lru_cache(maxsize=100_000)(self._sequence)

    def letter(self, before: str, ch: str) -> float:
        """Log chance of a character after two others: trigrams, smoothed by bigrams, smoothed by all letters alike."""
        g = self.grams
        two = (g[before[-1] + ch] + 2.0 / self.letters) / (g[before[-1] + "_"] + 2.0)
        return math.log((g[before + ch] + 3.0 * two) / (g[before + "_"] + 3.0))

    def step(self, prefix: str, ch: str) -> tuple[str, float]:
        """The prefix with the next character, and its log chance; a character that leaves the tree pays the escape."""
        if prefix[:1] == self.OUTSIDE:
            return prefix + ch, self.letter(("^^" + prefix[1:])[-2:], ch)
        n = self.node.get(prefix + ch)
        if n is not None:
            return prefix + ch, math.log(n / self.node[prefix])
        return self.OUTSIDE + prefix + ch, ESCAPE + self.letter(("^^" + prefix)[-2:], ch)

    def _advance(self, layer: dict[tuple[str, str], float], ch: str) -> dict[tuple[str, str], float]:
        """The states after one more character; outside the tree only the best few go on."""
        out: dict[tuple[str, str], float] = {}
        for (prefix, last), score in layer.items():
            options: list[tuple[str, float]] = []
            if ch.isalpha():
                options.append((ch, 0.0))
            for letter in IMITATE.get(ch, ""):
                options.append((letter, -0.7))
            if ch in MASKS and prefix[:1] != self.OUTSIDE:  # a mask is read within the tree alone
                options += [(k, -1.0) for k in self._next(prefix)]
            if ch == last and ch not in MASKS:  # a repetition of the character before
                put(out, (prefix, last), score - 0.3)
            for letter, cost in options:
                new, s = self.step(prefix, letter)
                put(out, (new, ch), score + cost + s)
        far = [k for k in out if k[0][:1] == self.OUTSIDE]
        if len(far) > 8:
            for k in sorted(far, key=out.get)[:-8]:
                del out[k]
        return out

    def _ended(self, layer: dict[tuple[str, str], float]) -> tuple[float, str] | None:
        """The likeliest known word that ends here, with its score."""
        return max(((score + math.log(c / self.node[p]), p) for (p, _), score in layer.items() if (c := self.words.get(p))), default=None)

    def _inside(self, layer: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
        """Of parted letters only words of the tree are read: anything can be parted into unknown ones."""
        return {k: v for k, v in layer.items() if k[0][:1] != self.OUTSIDE}

    def _unknown(self, layer: dict[tuple[str, str], float]) -> str | None:
        """The likeliest word outside the tree, if its letters are likely enough."""
        found = None
        for (p, _), score in layer.items():
            if p[:1] == self.OUTSIDE and len(p) > 4:
                score += self.letter(("^^" + p[1:])[-2:], "$")
                if (score - ESCAPE) / len(p) > LIKELY and (found is None or score > found[0]):
                    found = (score, p[1:])
        return found[1] if found else None

    def _decode(self, token: str) -> str | None:
        """The likeliest word behind a disguised token, or None."""
        layer = {("", ""): 0.0}
        for ch in token.lower():
            layer = self._advance(layer, ch)
        found = self._ended(layer)
        if found is None and sum(c.isalpha() for c in token) * 2 > len(token):
            return self._unknown(layer)
        return found[1] if found else None

    def _sequence(self, whole: str) -> str | None:
        """The likeliest words behind a parted stretch, or None if it holds no known word.

        A word may end at any separator. The one after its first letter mostly stands within it; another
        one, such as the blank of 'a m.o.r.o.n', mostly between two words. What lies between blanks or
        changes of the separator may also stay as written, at a cost.
        """
        t = "".join(c.lower()[:1] for c in whole)
        letters, seps = t[::2], t[1::2]
        n = len(letters)
        # of the separator before each letter: whether a neighbour is another one
        turns = [bool(i) and i < n and set(seps[max(i - 2, 0) : i + 1]) != {seps[i - 1]} for i in range(n + 1)]
        edge = [i in (0, n) or turns[i] or seps[i - 1] == " " for i in range(n + 1)]
        bare = [i in (0, n) or turns[i] and seps[i - 1] == " " for i in range(n + 1)]
        best: list[tuple[float, int, str, bool] | None] = [(0.0, 0, "", False), *[None] * n]

        def take(i: int, j: int, cost: float, read: str, known: bool) -> None:
            score = best[i][0] + cost
            if best[j] is None or score > best[j][0]:
                best[j] = (score, i, read, known)

        for i in range(n):
            if best[i] is None:
                continue
            if edge[i]:
                j = next(k for k in range(i + 1, n + 1) if edge[k])
                take(i, j, ALONE if j == i + 1 and bare[i] and bare[j] else WRITTEN * (j - i), whole[2 * i : 2 * j - 1], False)
            if letters[i : i + 2] == "**":  # no word begins with two masks
                continue
            layer, plain, blanks = {("", ""): 0.0}, 0, True
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                layer = self._inside(self._advance(layer, letters[j - 1]))
                if not layer:
                    break
                plain += letters[j - 1].isalpha()
                # a row of figures with a letter among them is no word
                stars = j < n and seps[j - 1] == "*" and "*" in letters[j - 1 : j + 1]  # in a row of them a mask, no separator
                if not stars and (plain * 2 >= j - i if blanks else plain) and (e := self._ended(layer)) and len(e[1]) > 2:
                    take(i, j, e[0] + (ENDS if j < n and seps[j - 1] == seps[i] else 0.0), e[1], True)
                if j < n:
                    sep = seps[j - 1]
                    blanks = blanks and sep == " "
                    going = {} if stars else {state: score + (0.0 if sep == seps[i] else OVER) for state, score in layer.items()}
                    if sep == "*":  # or a masked letter
                        for state, score in self._inside(self._advance(layer, sep)).items():
                            put(going, state, score)
                    layer = going
        out, at, later, some = [], n, None, False
        while at and best[at]:
            _, i, read, known = best[at]
            if later is not None:
                out.append(seps[at - 1] if not known and not later else " ")
            out.append(read)
            at, later, some = i, known, some or known
        return "".join(reversed(out)) if some and not at else None

    def _next(self, prefix: str) -> str:
        return self._children().get(prefix, "")

    def _children(self) -> dict[str, str]:
        if not hasattr(self, "_kids"):
            kids: dict[str, list[str]] = {}
            for p in self.node:
                if p:
                    kids.setdefault(p[:-1], []).append(p[-1])
            self._kids = {p: "".join(sorted(x)) for p, x in kids.items()}
        return self._kids

    def restore(self, text: str) -> str:
        """The text with tags and invisible characters gone and disguised words read."""
        t = TAG.sub(" ", INVISIBLE.sub("", text))

        def parted(m) -> str:
            whole = m[0]
            core = regex.sub(r"[.\-_ ·~/]", "", whole)
            if len(core) < 3 or core.isdigit():
                return whole
            torn = whole[-1] == "*" and t[m.end() : m.end() + 1] == "*"  # a row of masks goes on behind it
            if not torn and any(c.isalpha() for c in core) and (read := self.sequence(whole)) is not None:
                return read
            word = self.decode(core)
            return word if word is not None and len(word) > 2 else whole

        def disguised(m) -> str:
            token = m[0]
            if not MARKED.search(token) or FIGURE.match(token):
                return token
            core = token.rstrip("!?_|")
            for c in (token, core):
                if MARKED.search(c) and (word := self.decode(c)) is not None:
                    return word + token[len(c) :]
            return token

        t = PARTED.sub(parted, t)
        return DISGUISED.sub(disguised, t) if BESIDE.search(t) else t


def put(layer: dict, state: tuple, score: float) -> None:
    if score > layer.get(state, -1e18):
        layer[state] = score


def sentences(text: str) -> list[str]:
    """Sentences for scoring: terminal marks of all scripts and line ends part them."""
    return [u for m in SENTENCE.finditer(text) if WORD.search(u := m[0])]


class Scorer:
    """Channel, n-gram numbers and weights; fitted by ``fit``.

    Words have numbers; a bigram is looked up by the numbers of its words and a trigram by those of its
    first bigram and its last word, in sorted arrays, for all sentences of a batch at once.
    """

    def __init__(self, counts: dict[str, float], words: dict[str, int], two: np.ndarray, three: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.channel = Channel(counts)
        self.words, self.two, self.three, self.weights, self.bias = words, two, three, weights, bias

    def grams(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, feature) of the n-grams up to three of every unit, each once, in order."""
        known = self.words.get
        lists = [[0, *(known(w, -1) for w in _words(u)), 1] for u in units]
        unit = np.repeat(np.arange(len(units)), [len(x) for x in lists])
        w = np.array([i for x in lists for i in x], dtype=np.int64)
        return _features(w, unit, len(self.words), self.two, self.three)

    def units(self, units: list[str]) -> np.ndarray:
        """Scores of sentences, sentences x kinds."""
        out = np.tile(self.bias, (len(units), 1))
        if units:
            unit, feature = self.grams(units)
            np.add.at(out, unit, self.weights[feature])
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Chances of the worst sentence of each document for each kind."""
        units, at = [], []
        for i, t in enumerate(texts):
            if t and t.strip():
                some = sentences(self.channel.restore(t))
                units += some
                at += [i] * len(some)
        s = np.full((len(texts), len(KINDS)), -np.inf)
        if units:
            np.maximum.at(s, np.array(at), self.units(units))
        return 1 / (1 + np.exp(-s))

    def document(self, text: str | None) -> np.ndarray:
        return self.documents([text])[0]


def _look(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where they aren't."""
    at = np.searchsorted(sorted_, keys)
    at[at == len(sorted_)] = 0
    return np.where(sorted_[at] == keys, at, -1) if len(sorted_) else np.full(len(keys), -1)


def _pairs(w: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, key) of neighbouring known words of a unit."""
    ok = (unit[:-1] == unit[1:]) & (w[:-1] >= 0) & (w[1:] >= 0)
    at = np.flatnonzero(ok)
    return at, w[at] * n + w[at + 1]


def _triples(w: np.ndarray, unit: np.ndarray, n: int, at: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, key) of a known bigram and the known word after it."""
    at, nth = at[nth >= 0], nth[nth >= 0]
    ok = at + 2 < len(w)
    at, nth = at[ok], nth[ok]
    ok = (unit[at] == unit[at + 2]) & (w[at + 2] >= 0)
    return at[ok], nth[ok] * n + w[at[ok] + 2]


def _features(w: np.ndarray, unit: np.ndarray, n: int, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, key = _pairs(w, unit, n)
    nth = _look(key, two)
    at3, key3 = _triples(w, unit, n, at, nth)
    nth3 = _look(key3, three)
    one = np.flatnonzero(w > 1)  # 0 and 1 are the ends of a sentence
    u = np.concatenate([unit[one], unit[at[nth >= 0]], unit[at3[nth3 >= 0]]])
    f = np.concatenate([w[one], n + nth[nth >= 0], n + len(two) + nth3[nth3 >= 0]])
    each = np.unique(u * (n + len(two) + len(three)) + f)
    return np.divmod(each, n + len(two) + len(three))


def _train(unit: np.ndarray, feature: np.ndarray, n: int, kind: np.ndarray, weight: np.ndarray, seed: int = 5, together: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Weights of independent logistic models, by Adagrad over ``together`` units at a time.

    ``kind`` is that of each unit, -1 for none; a unit of weight 0 is left out.
    """
    rnd, k = np.random.default_rng(seed), len(KINDS)
    w, g2 = np.zeros((n, k)), np.ones((n, k))
    bias, b2 = np.full(k, -3.0), np.ones(k)
    sizes = np.bincount(unit, minlength=len(kind))
    begins = np.cumsum(sizes) - sizes
    used = np.flatnonzero((weight > 0) & (sizes > 0))
    truth = np.zeros((len(kind), k))
    truth[kind >= 0, kind[kind >= 0]] = 1
    for _ in range(PASSES):
        order = rnd.permutation(used)
        for j in range(0, len(order), together):
            some = order[j : j + together]
            m = sizes[some]
            row = np.repeat(np.arange(len(some)), m)
            x = feature[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begins[some], m)]
            s = np.add.reduceat(w[x], np.cumsum(m) - m, axis=0) + bias
            g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - truth[some]) * weight[some, None]
            if np.abs(g).max() < 1e-3:
                continue
            b2 += (g * g).sum(0)
            bias = bias - 0.1 * g.sum(0) / np.sqrt(b2)
            dims, at = np.unique(x, return_inverse=True)
            step, square = np.zeros((2, len(dims), k))
            np.add.at(step, at, (g / np.sqrt(m / 12 + 1)[:, None])[row])
            np.add.at(square, at, (g * g)[row])
            g2[dims] += square
            w[dims] -= RATE * step / np.sqrt(g2[dims])
    return w, bias


def fit(reviewed: list[tuple[str, str]], common: dict[str, float] | None = None, others: list[str] = ()) -> Scorer:
    """A scorer from (text, label) of reviewed documents, common words with counts, other documents and the general examples.

    ``others`` are documents of which nothing is known but that most are clean; they stand for what is usual.
    """
    made = [(x, KINDS.index(k)) for k, xs in examples().items() for x in xs] + [(x + ".", -1) for x in SOBER]
    counts: Counter = Counter({w: math.log1p(c) for w, c in (common or {}).items()})
    for text, kind in made:
        if kind >= 0:
            for word in _words(text):
                if len(word) > 2:
                    counts[word] += KNOWN / 4
    for word in {w for _, nouns, _ in INSULTS.values() for w in nouns.lower().split()} | set("sex porn nude nudes naked fuck dick tits pussy slut whore horny vermin parasites".split()):
        counts[word] += KNOWN
    seen, bad = Counter(), Counter()
    for text, label in reviewed:
        words = {w for w in WORD.findall(text.lower()) if len(w) > 2 and w.isalpha()}
        seen.update(words)
        if label in KINDS:
            bad.update(words)
    share = sum(label in KINDS for _, label in reviewed) / max(1, len(reviewed))
    for word, c in seen.items():
        lifted = bad[word] > 1 and bad[word] > 2 * share * c
        counts[word] += c + LIFTED * bad[word] * lifted
    channel = Channel(dict(counts))
    units, doc = [x for x, _ in made], [-1] * len(made)
    reviewed = reviewed + [(t, "usual") for t in others]
    labels = [label for _, label in reviewed]
    for i, (text, _) in enumerate(reviewed):
        some = sentences(channel.restore(text))
        units += some
        doc += [i] * len(some)
    # numbers of words, of bigrams, and of trigrams
    lists = [_words(u) for u in units]
    words = {"^": 0, "$": 1}
    for x in lists:
        for w in x:
            words.setdefault(w, len(words))
    n = len(words)
    unit = np.repeat(np.arange(len(units)), [len(x) + 2 for x in lists])
    w = np.array([i for x in lists for i in (0, *(words[y] for y in x), 1)], dtype=np.int64)
    at, key = _pairs(w, unit, n)
    two = np.unique(key)
    three = np.unique(_triples(w, unit, n, at, _look(key, two))[1])
    unit, feature = _features(w, unit, n, two, three)
    size = n + len(two) + len(three)
    doc_, label = np.array(doc), np.array([KINDS.index(x) if x in KINDS else {"clean": -1, "usual": -3}.get(x, -2) for x in labels] + [-2])
    of = label[doc_]
    fixed = doc_ < 0
    kind = np.where(fixed, np.array([k for _, k in made] + [0] * (len(units) - len(made))), np.maximum(of, -1))
    # at first every sentence of a document stands for its kind, a share of it each: what clean ones have, too, comes to nothing
    among = np.bincount(doc_[~fixed], minlength=len(reviewed) + 1)[np.maximum(doc_, 0)]
    weight = np.where(fixed, np.where(kind >= 0, 3.0, 1.0), np.where(of >= 0, FIRST / np.maximum(1, among), np.where(of == -3, USUAL, (of == -1).astype(float))))
    weights, bias = _train(unit, feature, size, kind, weight)
    for least in LEAST:
        score = np.tile(bias, (len(units), 1))
        np.add.at(score, unit, weights[feature])
        kind, weight = np.where(fixed, kind, -1), np.where(fixed, weight, 0.0)
        weight[~fixed & (of == -1) & (score.max(1) <= 2.0)] = 1.0  # above: a reviewer's mistake rather than an example
        weight[~fixed & (of >= 0) & (score.max(1) < -5.0)] = 1.0
        weight[~fixed & (of == -3) & (score.max(1) <= 0.0)] = USUAL  # above: most likely one of those that are looked for
        for i in np.flatnonzero(label[:-1] >= 0):
            mine = np.arange(*np.searchsorted(doc_, [i, i + 1]))
            if len(mine):
                best = mine[score[mine, label[i]].argmax()]
                if score[best, label[i]] > least and score[best].argmax() == label[i]:
                    kind[best], weight[best] = label[i], 1.0
        weights, bias = _train(unit, feature, size, kind, weight)
    # what weighs nothing is left out
    keep = np.abs(weights).max(1) > 0.02
    keep2, keep3 = keep[n : n + len(two)], keep[n + len(two) :]
    keep2[three[keep3] // n] = True
    renumber = np.cumsum(keep2) - 1
    return Scorer(dict(counts), words, two[keep2], renumber[three[keep3] // n] * n + three[keep3] % n, np.concatenate([weights[:n], weights[n : n + len(two)][keep2], weights[n + len(two) :][keep3]]), bias)


def _common(docs: DataFrame) -> dict[str, float]:
    """Words of three letters or more that make up at least LEAST_SHARE of those of all documents, with counts."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,40}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    w = cut(w)
    least = max(LEAST_COUNT, (w.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE)
    return {r["w"]: float(r["n"]) for r in w.where(F.col("n") >= least).collect()}


def _fitted(docs: DataFrame, reviews: DataFrame, key: str, sample: int):
    known = (
        reviews.where("doc_id is not null and label is not null").select(F.col("doc_id").alias(key), F.lower(F.trim("label")).alias("label"))
        .distinct().orderBy(F.xxhash64(key), "label").limit(sample)
    )
    rows = docs.select(key, "text").where("text is not null").join(F.broadcast(known), key).distinct().collect()
    usual = docs.select(key, "text").where("text is not null").orderBy(F.xxhash64(key, F.lit("usual")), key).limit(BACKGROUND).collect()
    m = fit(sorted((r["text"], r["label"]) for r in rows), _common(docs), sorted({r["text"] for r in usual}))
    return docs.sparkSession.sparkContext.broadcast((m.channel.words, m.words, m.two, m.three, m.weights, m.bias))


_SCORERS: dict[tuple, Scorer] = {}


def scores(docs: DataFrame, reviews: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, abusive, hateful, sexual, score): chances for each kind, and the largest, of every document."""
    shared = _fitted(docs, reviews, key, sample)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = (len(shared.value[0]), tuple(shared.value[5]))
        if at not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[at] = Scorer(*shared.value)
        m = _SCORERS[at]
        for b in batches:
            s = m.documents([t if isinstance(t, str) else None for t in b["text"]]).round(4)
            yield pd.DataFrame({key: b[key], **{k: s[:, i] for i, k in enumerate(KINDS)}, "score": s.max(1) if len(s) else []})

    schema = f"`{key}` {kind}, " + ", ".join(f"{k} double" for k in KINDS) + ", score double"
    return spread(docs.where(f"`{key}` is not null").select(key, "text")).mapInPandas(work, schema)


def kinds(scored: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, category): a row for each kind whose chance reaches the threshold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("chance")) for k in KINDS]))
    return scored.select(key, pairs.alias("p")).where(F.col("p.chance") >= threshold).select(key, "p.category").distinct()


def found(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, category) of every document with such content."""
    return kinds(scores(docs, reviews))


def rates(docs: DataFrame, reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, and documents of each kind and of any, with the share of any."""
    s = scores(docs, reviews).dropDuplicates(["doc_id"])
    d = docs.select("doc_id", "source").dropDuplicates(["doc_id"])
    return (
        d.join(s, "doc_id").groupBy("source")
        .agg(
            F.count("*").alias("n_docs"),
            *[F.sum((F.col(k) >= threshold).cast("int")).alias(f"n_{k}") for k in KINDS],
            F.sum((F.col("score") >= threshold).cast("int")).alias("n_any"),
            F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("rate_any"),
        )
    )
