"""Problem 1: raw transcript rows into clean, ordered speaker turns.

A parsing-expression grammar reads each row: time stamps of several forms, sound notes in five kinds of
brackets that may hold stamps and other notes, speaker labels, fillers, and words. The parse tree is
transformed into stretches of clean words, each with the person named for it or none. Names are found
among the known speakers by surname, allowing for misspellings (edit distance), and settled by first
name or firm where several are as near. The stretches are then chained per source in the order of
turn_no and place in the text; an unbroken run of one person is a turn.

The chain is computed in blocks of turn numbers: windows run inside (source, block), a summary of one
row per block carries the person and the turn across, so no task sees more than a block of a source,
however long a call is.

Defined results: rows with a null source or turn_no are left out; rows delivered again count once (the
latest ingested_at, then the largest row_id, wins if they differ); a row with only noise belongs to
no turn and breaks none; a stretch that names nobody goes on with the person before, and is left out
if there is none in its source; a voice marked as unknown has speaker_id 0; a speaker cell that
resolves to nobody counts as not given; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import peg
from colloquy.session import cut, spread

#: Turn numbers of a block; a source of up to as many rows is one block.
BLOCK = 4096
#: Known speakers that may be sent to the tasks; more are refused rather than cut.
MAX_SPEAKERS = 500_000
#: First words of sound notes and editors' marks.
CUES = (
    "laughter laughs laughing laugh chuckles chuckle applause clapping music cough coughs coughing crosstalk cross-talk "
    "overlapping inaudible indiscernible unintelligible unclear pause silence ph sic technical audio background noise "
    "static beep phone sigh sighs off-mic foreign no break"
)
#: Fillers, longest first where one starts another.
FILLERS = r"well,? uh|you know|i mean|sort of|kind of|mm-hmm|uh-huh|hmm+|mhm|umm?|uhh?|erm|er|ahh?|eh|like"
#: Voices marked as unknown.
UNKNOWN = r"(?:unidentified|unknown|unnamed|inaudible)(?: (?:speaker|analyst|participant|voice|caller|person|male|female|man|woman))*|(?:fe)?male (?:voice|speaker)|speaker ?\??|voice|participant|u/?m|u/?f|\?+"
#: Honorifics and roles around a name.
TITLES = r"(?:mr|mrs|ms|mx|miss|dr|prof|sir|dame|lord|lady)\.?"

CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?|\d{1,2}h\d{1,2}m(?:\d{1,2}s)?|\d{1,3}m\d{1,2}s|\d{1,3}\.\d{2}"
_PART = r"(?:[^\W\d_]\.|(?:Mr|Ms|Mrs|Mx|Dr|Prof)\.|[^\W\d_][\w'’\-]*)"
NAME = rf"{_PART}(?:,? {{1,2}}[(\[]?{_PART}[)\]]?){{0,4}}"


class People:
    """The known speakers, by surname, with a memory of the names met so far."""

    def __init__(self, rows: list[tuple[int, str, str | None, str | None]]):
        self.by_surname: dict[str, list[tuple[int, str, str]]] = {}
        self.operator = 0
        for i, name, firm, side in sorted(rows):
            parts = (name or "").lower().split()
            if not parts:
                continue
            if side == "operator" or parts == ["operator"]:
                self.operator = i
                continue
            self.by_surname.setdefault(parts[-1], []).append((i, parts[0] if len(parts) > 1 else "", (firm or "").lower()))
        self.by_length: dict[int, list[str]] = {}
        for s in self.by_surname:
            self.by_length.setdefault(len(s), []).append(s)
        self.letters = {s: _letters(s) for s in self.by_surname}
        self.find = lru_cache(maxsize=200_000)(self._find)
        self.near = lru_cache(maxsize=200_000)(self._near)

    def _near(self, surname: str, allowed: int) -> list[tuple[int, str]]:
        """(distance, surname) of the known surnames within ``allowed`` edits.

        An edit changes at most two bits of a word's letter set, so most names are passed over by it.
        """
        mine, out = _letters(surname), []
        for n in range(len(surname) - allowed, len(surname) + allowed + 1):
            for k in self.by_length.get(n, ()):
                if (mine ^ self.letters[k]).bit_count() <= 2 * allowed and (d := distance(surname, k, allowed)) <= allowed:
                    out.append((d, k))
        return out

    def _find(self, raw: str, near: int = 2) -> int | None:
        """The speaker_id a name means; 0 for an unknown voice; None if it means nobody known."""
        s = re.sub(rf"[\[(<]\s*(?:{CLOCK})\s*[\])>]|^\s*>+|\b(?:{CLOCK})\b", " ", raw.lower())
        s = re.sub(r"\s+", " ", s).strip(" :;-–—\t")
        if not s:
            return None
        if re.fullmatch(r"(?:conference |call |the )?(?:operator|coordinator)(?: instructions)?", s):
            return self.operator
        if re.fullmatch(UNKNOWN, s.strip("[]() ")):
            return 0
        firm = ""
        if m := re.search(r" -+ | [–—] ", s):
            s, firm = s[: m.start()], s[m.end() :]
        if m := re.search(r"\(([^)]*)\)", s):
            firm, s = firm or m[1], (s[: m.start()] + " " + s[m.end() :])
        s = re.sub(rf"^\s*{TITLES}\s+", "", s.strip(" []()"))
        if "," in s:
            last, first = (x.strip() for x in s.split(",", 1))
            words = [*first.split(), *last.split()]
        else:
            words = s.split()
        words = [w.strip(".'’\"") for w in words if w.strip(".'’\"")]
        if not words:
            return None
        surname, given = words[-1], words[0] if len(words) > 1 else ""
        near_names = [(0, surname)] if surname in self.by_surname else self.near(surname, min(near, max(0, (len(surname) - 2) // 3)))
        best: list[tuple[tuple, int]] = []
        for d, k in near_names:
            for i, first, house in self.by_surname[k]:
                agrees = 0 if given and (first.startswith(given) or given.startswith(first[:1]) and len(given) == 1) else 1
                if given and agrees:
                    agrees = 1 if distance(given, first, 2) <= 2 else 3
                at = 0 if firm and house and (firm in house or house.split()[0] in firm) else 1
                if d and agrees == 3:
                    continue
                best.append(((d + agrees, at, d), i))
        return min(best)[1] if best else None


def _letters(word: str) -> int:
    """The set of a word's letters as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def grammar(known) -> peg.Parser:
    """The grammar of a row; ``known(name)`` is the predicate that a label names somebody.

    Row    <- (Gap / Stamp / Note / Label / Filler / Run / Any)*
    Stamp  <- Clock '-->' Clock / '[' Clock ']' / '(' Clock ')' / '<' Clock '>' / Clock
    Note   <- '[' Inner ']' / '(' Inner ')' / '{' Inner '}' / '<' Inner '>' / '*' Cue '*'
    Inner  <- (Stamp / Note / CueText)*      of any depth
    Label  <- '>>'? (Name (':' / ' --') / '[' Name ']')      where known(Name)
    """
    clock = peg.term(rf"(?:{CLOCK})")
    gap = peg.term(r"\s+", "gap")
    cue = rf"\s*(?:{'|'.join(CUES.split())})\b"
    enclosed = peg.ahead(
        "[(<",
        peg.term(rf"\[\s*(?:{CLOCK})\s*\]|\(\s*(?:{CLOCK})\s*\)|<\s*(?:{CLOCK})\s*>"),
    )
    bare = peg.term(rf"(?:{CLOCK})(?:\s*-->\s*(?:{CLOCK}))?(?=\s|$)")
    stamp = peg.node("stamp", peg.alt(enclosed, peg.ahead("0123456789", bare)))
    starred = peg.node("note", peg.ahead("*", peg.term(r"\*[^*\n]{1,40}\*")))
    inner = peg.alt(peg.node("stamp", enclosed), starred, peg.node("stamp", peg.ahead("0123456789", clock)))
    nested = rf"\s*[\[({{<*]|{cue}"
    marks = {"[": ("]", nested), "(": (")", nested), "{": ("}", r"[^{}\n]{1,60}\}"), "<": (">", nested)}
    note = peg.alt(peg.balanced("note", marks, inner, r"[^\[\](){}<>*\n\d]+|\d"), starred)
    name = re.compile(rf"(>>\s*)?(?:\[({NAME})\]|(?-i:(?=[A-Z]))({NAME})(?:\s?:|\s--(?!-))(?=\s|$|\[|\())")

    def label(at_text: str, at: int):
        m = name.match(at_text, at)
        if m is None or known(m[2] or m[3]) is None:
            return None
        a, b = m.span(2) if m[2] else m.span(3)
        return m.end(), [("label", a, b, [])]

    unknown = peg.term(r">>\s*")
    filler = peg.term(rf"(?:{FILLERS})(?=[\s,.…]|$)[,.…]*|\.\.\.+|…", "filler", re.I)
    # words run on over sentence ends unless a label or a stamp may follow
    starts = rf">>|\[|\d{{1,2}}:\d{{2}}|(?=[A-Z])(?:{NAME})(?:\s?:|\s--(?!-))"
    run = peg.term(
        rf"[^\s\[\](){{}}<>*.!?…](?:[^\[\](){{}}<>*\n.!?…]|[.!?…](?=\S)|[.!?…][ \t]+(?=[^\s\[\](){{}}<>*\d])(?!{starts}))*[.!?…”\"’»]*", "words"
    )
    single = peg.term(r".", "mark", re.S)
    return peg.many(peg.alt(gap, stamp, label, note, filler, run, unknown, single))


_SPLIT_FILLER = re.compile(rf"(?<![\w-])(?:{FILLERS})(?:\.\.\.|,)(?=\s|$)\s*", re.I)
_REPEAT = re.compile(r"\b(\w+)(?:--)? \1\b", re.I)
_STAMMER = re.compile(r"\b\w{1,4}-- ?(?=\w)")


def clean(text: str) -> str:
    """Words without fillers inside them, stammers and doubled words."""
    text = _SPLIT_FILLER.sub("", text)
    text = _STAMMER.sub("", text)
    text = _REPEAT.sub(r"\1", text)
    return re.sub(r"\s+", " ", text).strip()


class Reader:
    """The parser of a worker, bound to the known speakers."""

    def __init__(self, rows: list[tuple]):
        self.people = People(rows)
        self.parse = grammar(lambda n: self.people.find(n, 1 if " " not in n.strip() else 2))

    def stretches(self, speaker: str | None, firm: str | None, text: str | None, words: bool) -> list[tuple[int, str]]:
        """(speaker_id, clean words) of each stretch of a row in order; -1 where nobody is named.

        Every row is parsed; without ``words`` only the words themselves are left out.
        """
        who = -1
        if speaker and speaker.strip():
            who = self.people.find(f"{speaker} -- {firm}" if firm and firm.strip() and " -- " not in speaker else speaker)
            who = -1 if who is None else who
        out: list[tuple[int, list[str]]] = []
        if not text:
            return []
        for kind, a, b, _ in self.parse(text, 0)[1]:
            if kind == "label":
                who = self.people.find(text[a:b], 2)
            elif kind in ("words", "mark") and (words or not out or out[-1][0] != who):
                piece = text[a:b]
                if kind == "mark" and not piece.isalnum():
                    if words and out:
                        out[-1][1].append(piece)
                    continue
                if not any(c.isalnum() for c in piece) or not clean(piece):
                    continue
                if out and out[-1][0] == who:
                    out[-1][1].append(piece)
                else:
                    out.append((who, [piece]))
        return [(w, clean(" ".join(p)) if words else "") for w, p in out]


_READERS: dict[int, Reader] = {}


def _people(speakers: DataFrame) -> list[tuple]:
    rows = speakers.where("speaker_id is not null").select("speaker_id", "full_name", "firm", "side").limit(MAX_SPEAKERS + 1).collect()
    if len(rows) > MAX_SPEAKERS:
        raise ValueError(f"more than {MAX_SPEAKERS} known speakers")
    return [tuple(r) for r in rows]


def stretches(turns: DataFrame, speakers: DataFrame, words: bool = False) -> DataFrame:
    """(source, block, turn_no, seg, who, words) of every stretch of words, rows delivered again once."""
    rows = _people(speakers)
    shared = turns.sparkSession.sparkContext.broadcast(rows)
    key = hash(tuple(rows))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(shared.value)
        reader = _READERS[key]
        for b in batches:
            found = [reader.stretches(s, f, t, words) for s, f, t in zip(b["speaker"], b["firm"], b["text"], strict=True)]
            out = {
                "source": b["source"], "turn_no": b["turn_no"], "ingested_at": b["ingested_at"], "row_id": b["row_id"],
                "who": [np.array([w for w, _ in f], dtype=np.int32) for f in found],
            }
            out["words"] = [[t for _, t in f] for f in found] if words else [None] * len(found)
            yield pd.DataFrame(out)

    cols = turns.select("source", "turn_no", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), "row_id", "speaker", "firm", "text")
    parsed = spread(cols.where("source is not null and turn_no is not null")).mapInPandas(
        work, "source string, turn_no int, ingested_at timestamp_ntz, row_id long, who array<int>, words array<string>"
    )
    one = (
        parsed.withColumn("block", F.expr(f"turn_no div {BLOCK}").cast("int"))
        .repartition("source", "block")
        .groupBy("source", "block", "turn_no")
        .agg(F.max_by(F.struct("who", "words"), F.struct("ingested_at", "row_id")).alias("s"))
    )
    z = F.arrays_zip("s.who", "s.words") if words else F.arrays_zip("s.who")
    return one.select("source", "block", "turn_no", F.posexplode(z).alias("seg", "z")).select(
        "source", "block", "turn_no", "seg", F.nullif(F.col("z.who"), F.lit(-1)).alias("who"),
        (F.col("z.words") if words else F.lit(None).cast("string")).alias("words"),
    )


def chain(parts: DataFrame) -> DataFrame:
    """``parts`` with the person of every stretch (speaker_id) and the start of its turn (run)."""
    parts = cut(parts)
    place = F.struct("turn_no", "seg")
    here = Window.partitionBy("source", "block").orderBy("turn_no", "seg")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        parts.groupBy("source", "block")
        .agg(F.max_by("who", F.when(F.col("who").isNotNull(), place)).alias("last_who"))
        .select("source", "block", F.last("last_who", True).over(before).alias("carried"))
    )
    filled = (
        parts.join(blocks, ["source", "block"])
        .withColumn("speaker_id", F.coalesce(F.last("who", True).over(here), "carried"))
        .where("speaker_id is not null")
        .withColumn("prior", F.coalesce(F.lag("speaker_id").over(here), "carried"))
        .withColumn("starts", F.when(F.col("prior").eqNullSafe(F.col("speaker_id")), F.lit(None)).otherwise(place))
    )
    runs = (
        filled.groupBy("source", "block")
        .agg(F.max("starts").alias("last_start"))
        .select("source", "block", F.last("last_start", True).over(before).alias("carried_start"))
    )
    return filled.join(runs, ["source", "block"]).withColumn("run", F.coalesce(F.last("starts", True).over(here), "carried_start"))


def clean_turns(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(source, first_turn_no, last_turn_no, speaker_id) of every clean turn."""
    return (
        chain(stretches(turns, speakers))
        .groupBy("source", "run", "speaker_id")
        .agg(F.max("turn_no").alias("last_turn_no"))
        .select("source", F.col("run.turn_no").alias("first_turn_no"), "last_turn_no", "speaker_id")
        .distinct()
    )


def turn_texts(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(source, turn, first_turn_no, last_turn_no, speaker_id, full_name, text): the clean words of each turn in order."""
    place = F.array_sort(F.collect_list(F.struct("turn_no", "seg", "words")))
    named = speakers.select("speaker_id", "full_name").dropDuplicates(["speaker_id"])
    return (
        chain(stretches(turns, speakers, True))
        .groupBy("source", "run", "speaker_id")
        .agg(F.max("turn_no").alias("last_turn_no"), place.alias("parts"))
        .select(
            "source", F.col("run.turn_no").alias("first_turn_no"), F.col("run.seg").alias("place"), "last_turn_no", "speaker_id",
            F.concat_ws(" ", F.transform("parts", lambda p: p["words"])).alias("text"),
        )
        .join(named, "speaker_id", "left")
    )
