"""A small parsing-expression grammar: ordered choice, sequence, repetition, predicates, recursion.

A parser is a function (text, position) -> (end, nodes) or None; a node is (kind, start, end, children).
Terminals are compiled regular expressions, so plain stretches of text cost one call. Choice is
ordered and nothing is tried twice at one place, so parsing is linear for grammars without nested
backtracking. Rules that nest in themselves are parsed by ``balanced``, which keeps no call stack: a text may
nest as deep as it is long.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple[str, int, int, list]
Parser = Callable[[str, int], "tuple[int, list[Node]] | None"]


def term(pattern: str, kind: str = "", flags: int = 0) -> Parser:
    """A regular expression; a node of ``kind`` if one is given. It must consume something."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int):
        m = match(text, at)
        if m is None or m.end() == at:
            return None
        return m.end(), [(kind, at, m.end(), [])] if kind else []

    return run


def seq(*parts: Parser) -> Parser:
    """All parts in a row."""

    def run(text: str, at: int):
        nodes: list[Node] = []
        for p in parts:
            r = p(text, at)
            if r is None:
                return None
            at = r[0]
            nodes += r[1]
        return at, nodes

    return run


def alt(*parts: Parser) -> Parser:
    """The first part that matches."""

    def run(text: str, at: int):
        for p in parts:
            r = p(text, at)
            if r is not None:
                return r
        return None

    return run


def opt(part: Parser) -> Parser:
    """The part, or nothing."""

    def run(text: str, at: int):
        return part(text, at) or (at, [])

    return run


def many(part: Parser) -> Parser:
    """The part as often as it matches and moves on."""

    def run(text: str, at: int):
        nodes: list[Node] = []
        while (r := part(text, at)) is not None and r[0] > at:
            at = r[0]
            nodes += r[1]
        return at, nodes

    return run


def follows(pattern: str, flags: int = 0) -> Parser:
    """An and-predicate: matches nothing, if the expression matches here."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int):
        return (at, []) if match(text, at) else None

    return run


def ahead(first: str, part: Parser) -> Parser:
    """The part, tried only where the next character is one of ``first``."""

    def run(text: str, at: int):
        return part(text, at) if at < len(text) and text[at] in first else None

    return run


def node(kind: str, part: Parser) -> Parser:
    """The part under a node of its own."""

    def run(text: str, at: int):
        r = part(text, at)
        return None if r is None else (r[0], [(kind, at, r[0], r[1])])

    return run


def balanced(kind: str, pairs: dict[str, tuple[str, str]], atoms: Parser, inside: str) -> Parser:
    """A rule that nests in itself: Rule <- open &need (atom / Rule / inside)* close, or an atom that is one.

    ``pairs`` gives the closing mark and the predicate behind each opening mark, ``inside`` a pattern of plain
    stretches. All rules of a text are matched at its first use, from the last opening mark to the first:
    a rule met inside another is then known and passed over in one step, and each plain stretch is read for
    the nearest unmatched opening mark before it alone, so the time is linear in the text.
    """
    need = {a: re.compile(p, re.I).match for a, (_, p) in pairs.items()}
    close = {a: c for a, (c, _) in pairs.items()}
    opening = re.compile("[" + re.escape("".join(pairs)) + "]").finditer
    plain = re.compile(inside).match
    last: list = [None, {}]

    def match_all(text: str) -> dict[int, Node]:
        known: dict[int, Node] = {}
        for start in [m.start() for m in opening(text)][::-1]:
            mark = text[start]
            if not need[mark](text, start + 1):
                continue
            at, nodes = start + 1, []
            while at < len(text):
                if (r := atoms(text, at)) is not None and r[0] > at:
                    at = r[0]
                    nodes += r[1]
                elif at in known:
                    nodes.append(known[at])
                    at = known[at][2]
                elif m := plain(text, at):
                    at = m.end()
                else:
                    break
            if text.startswith(close[mark], at):
                known[start] = (kind, start, at + len(close[mark]), nodes)
        return known

    def run(text: str, at: int):
        if at < len(text) and text[at] in close:
            if last[0] is not text:
                last[:] = [text, match_all(text)]
            if (n := last[1].get(at)) is not None:
                return n[2], [n]
        return None

    return run
