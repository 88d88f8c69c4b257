"""Small tests of the other operators: units of work, brute force, defined results for odd inputs."""

import random
import time

import numpy as np
import pytest

from colloquy.llm import abuse, consensus, encode, leakage, overlap, pairs, scans, sentences


# ---------------------------------------------------------------- sentences


@pytest.mark.parametrize(
    "text,want",
    [
        ("Costs were €0.66bn at 5 p.m. on the day, cf. Fig. 65. We waited... and then it fell.", 2), ("Dr. Vale told us, “It will take time. We will not rush.”, and moved on. Next.", 2),
        ("A good part comes from the U.S. Looking ahead, fine.", 2), ("部長は「心配ない。計画どおりだ。」と述べました。営業費用です。", 2), ("他说：“成本会下降。请给我们时间。”本季度增长。", 2),
        ("M. Vale a précisé : « Nous restons prudents. Rien ne presse. » Pourquoi le coût a-t-il augmenté ?", 2), ("Am 5. März haben wir, z. B. in der Filiale Nr. 94, die Preise angepasst. Gut.", 2),
        ("Γιατί μειώθηκαν το 2020; Τα έσοδα αυξήθηκαν; ναι.", 3), ("เราคาดว่าจะเพิ่มขึ้น ผู้บริหารระวัง", 2), ("قال د. حزمير إنه مستقر. نتوقع 5.4 مليون!", 2), ("डॉ. कोमेश ने कहा। क्या यह बढ़ा?", 2),
        ("Heading\nOne sentence here.\n\nThank you", 3), ("It rose in the plan.Our team agreed.", 2), ("Did they really expect it?! No.", 2), ("We chose option B. The team agreed with J. Vale and P. Q. Moor.", 2), ("", 0), (None, 0), (" \n ", 0), ("...", 0), ("No quote “ here. Yes.", 2),
    ],
)
def test_sentences(text, want):
    got = sentences.split(text)
    assert len(got) == want, [text[a:b] for a, b in got]
    for a, b in got:
        assert text[a:b] == text[a:b].strip() and a < b


def test_sentence_units_of_odd_tables(spark):
    schema = "rec string, rec_key string, text string, x int"
    df = spark.createDataFrame([("turn", "a#1", "One. Two.", 1)] * 2 + [("turn", "a#2", None, 1), ("answer", "p", "", 1), ("turn", None, "x.", 1), ("answer", "q", "word " * 50_000, 1)], schema)
    got = sorted(tuple(r) for r in sentences.sentence_units(df).collect())
    assert got == [("answer", "q", 0, 249_999), ("turn", "a#1", 0, 4), ("turn", "a#1", 5, 9)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


# ---------------------------------------------------------------- encoding


def test_encoding_equals_a_public_library_and_decodes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.default_vocabulary())
    t.encode_special_tokens = True
    rnd = random.Random(2)
    texts = ["", None, " ", "a" * 3000, "<|endoftext|> x", "aaa aaaa", "naïve café 😀 本季度", "it's  we'll\n\n\tok"] + ["".join(rnd.choice("abc é本1 .'s") for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert encode.roundtrip(df).where("not same").count() == 0
    assert encode.encode(df.limit(0)).count() == 0


def test_long_runs_equal_a_public_library_in_linear_time(monkeypatch, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.chdir(tmp_path)
    t = tokenizers.Tokenizer.from_file(encode.default_vocabulary())
    rnd = random.Random(6)
    enc = encode.Encoder(encode.read_vocabulary(encode.default_vocabulary()))
    runs = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "the", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "本季度净利息é") for n in (255, 300, 700, 5000)]
    runs += ["a" * 4097, "ha" * 3000, "=" * 2000, "internationalization" * 300, " " * 3000 + "x", "one " + "q" * 999 + " two"]
    got = enc.encode(runs)
    for run, ids in zip(runs, got, strict=True):
        assert ids.tolist() == t.encode(run, add_special_tokens=False).ids
    assert enc.decode(got) == runs
    took = []
    for n in (20_000, 80_000):
        run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.time()
        ids = enc.encode([run])[0]
        took.append(time.time() - began)
        assert ids.tolist() == t.encode(run, add_special_tokens=False).ids
    assert took[1] < 8 * max(took[0], 0.5)
    assert not list(tmp_path.iterdir())


# ---------------------------------------------------------------- overlap


def edits(a, b, joins=False):
    """Edit distance; with ``joins`` of words, where two words against one of the same characters cost two."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if joins and j > 1 and x == b[j - 2] + y:
                v = min(v, row[j - 2] + 2)
            if joins and i > 1 and a[i - 2] + x == y:
                v = min(v, before[j - 1] + 2)
            new.append(v)
        before, row = row, new
    return row[-1]


def test_band_equals_the_whole_table():
    rnd = random.Random(5)
    a = [[rnd.randrange(3) for _ in range(rnd.randint(0, 40))] for _ in range(400)]
    b = [[rnd.randrange(3) for _ in range(max(0, len(x) + rnd.randint(-6, 6)))] if rnd.random() < 0.5 else [c for c in x if rnd.random() < 0.9] for x in a]
    most = [rnd.choice([0, 1, 3, 8, 30]) for _ in a]
    got = overlap.within([np.array(x, dtype=np.uint32) for x in a], [np.array(x, dtype=np.uint32) for x in b], np.array(most))
    want = [edits(x, y) <= k for x, y, k in zip(a, b, most, strict=True)]
    assert got.tolist() == want and 50 < sum(want) < 350


def test_overlap_equals_brute_force(spark):
    rnd = random.Random(7)
    letters = "abcdefghij"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 4, 6, 9])))
    rows, seqs = [], {}
    for i in range(260):
        if i > 60 and rnd.random() < 0.7:
            s = list(rnd.choice(list(seqs.values())))
            for _ in range(rnd.choice([0, 1, 2, len(s) // 6, len(s) // 4])):
                at, way = rnd.randrange(len(s)), rnd.random()
                if way < 0.5:  # a slip
                    c = rnd.randrange(len(s[at]) + 1)
                    s[at] = s[at][:c] + rnd.choice(["", rnd.choice(letters)]) + s[at][c + (rnd.random() < 0.5) :] or "a"
                elif way < 0.65 and len(s) > 1:
                    s.pop(at)
                elif way < 0.8:
                    s.insert(at, word())
                elif at + 1 < len(s):  # a lost blank
                    s[at : at + 2] = [s[at] + s[at + 1]]
        else:
            s = [word() for _ in range(rnd.choice([1, 2, 3, 4, 8, 15, 30, 60]))]
            if i % 9 == 0:
                s = ["".join(s)[:120]]
        seqs[i] = s
        rows.append((i, " ".join(s).upper() + ".", rnd.random() < 0.3, "r1", "x", 1))
    rows += [(900, None, True, "r1", "x", 1), (901, "", False, None, None, 1), (902, " ?! ", True, None, None, 1), (903, "w1 w2 w3", None, None, None, 1), (903, "w1 w2 w3", None, None, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, human_reviewed boolean, label_round string, source string, h int")
    held = {r[0] for r in rows if r[2]}
    must, may = set(), set()
    for e, a in seqs.items():
        for t, b in seqs.items():
            x, y = "".join(a), "".join(b)
            if e in held and t not in held and abs(len(x) - len(y)) <= len(x) // 8 and edits(x, y) <= len(x) // 8:
                may.add((min(e, t), max(e, t)))
                if len(x) <= overlap.SHORT or len(x) >= overlap.LONG_WORDS * len(a) or x == y or edits(a, b, True) <= max(1, len(a) // 5):
                    must.add((min(e, t), max(e, t)))
    got = {tuple(r) for r in overlap.overlap_pairs(df).collect()}
    assert must <= got <= may and len(must) > 100 and len(got) >= 0.95 * len(may)
    assert overlap.overlap_pairs(df.limit(0)).count() == 0
    report = overlap.overlap_report(df).agg({"n_reviewed": "sum", "n_pairs": "sum"}).first()
    assert (report["sum(n_reviewed)"], report["sum(n_pairs)"]) == (len(held), len(got))


def test_overlap_finds_slips_blanks_and_long_texts(spark):
    long = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    slipped = [w.replace("w", "v", 1) if i % 10 == 3 else w for i, w in enumerate(long)]
    pairs = [
        ("Costs were very high", "Costs wer very high"), ("the cost base went down again in the quarter", "the costbase went down again in the quarter"), (" ".join(long), " ".join(slipped)),
        ("unverwechselbarkeitsprüfungsverfahrensordnung" * 3, "unverwechselbarkeitsprufungsverfahrensordnung" * 3), ("本季度净利息收入增长了百分之十二我们预计明年", "本季度净利息收入增长百分之十二我们预计明年"), ("Thanks. It rose 4%", "it rose 4 per cent"),
        ("the cost base of our bank went down again in the whole quarter, and income of the retail arm rose a lot", "the costbase of our bank went down agan in the whole quarter, and incomeof the retail arm rose a lot"),
    ]
    rows = [(i * 2 + k, t, k == 0, "r", "s") for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(100, "Yes", True, "r", "s"), (101, "Yet", False, "r", "s"), (102, "Costs were very low", False, "r", "s")]
    df = spark.createDataFrame(rows, "row_id long, text string, human_reviewed boolean, label_round string, source string")
    assert {tuple(r) for r in overlap.overlap_pairs(df).collect()} == {(i * 2, i * 2 + 1) for i in range(len(pairs))}


def test_overlap_does_not_depend_on_the_join(spark, monkeypatch):
    rows = [(i, f"the same long text number {i % 5} with some more words in it, and yet more of them to the end", i % 3 == 0, "r", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, text string, human_reviewed boolean, label_round string, source string")
    a = {tuple(r) for r in overlap.overlap_pairs(df).collect()}
    for name in ("BROADCAST_ROWS", "PRUNING_ROWS", "HOT_SEGMENT", "HOT_CLASS"):
        monkeypatch.setattr(overlap, name, 1)
    assert {tuple(r) for r in overlap.overlap_pairs(df).collect()} == a and a


def test_overlap_moves_no_training_texts(spark, monkeypatch):
    """Texts of phrases that many share: what is shuffled and written stays below the texts' own size, in one block and in several."""
    rows = [(i, " ".join(a for _, a in texts(3, i)) + f" That was note {i}.", i % 8 == 0, "r", "s") for i in range(2_400)]
    rows += [(10_000 + i, rows[i][1].replace("note", "nota"), False, "r", "s") for i in range(0, 2_400, 160)]
    df = spark.createDataFrame(rows, "row_id long, text string, human_reviewed boolean, label_round string, source string")
    size = sum(len(r[1]) for r in rows)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    for block in (overlap.BLOCK, 100):
        monkeypatch.setattr(overlap, "BLOCK", block)
        before = moved()
        got = {tuple(r) for r in overlap.overlap_pairs(df).collect()}
        assert {(i, 10_000 + i) for i in range(0, 2_400, 160)} <= got
        assert moved() - before < size


def test_cuts_are_the_rarest():
    one, two = np.array([9, 9, 1, 9, 9, 9, 1, 9, 9, 9]), np.array([9, 1, 1, 9, 9, 1, 1, 9, 9, -1])
    cuts = overlap.rarest_cuts(np.array([10]), np.array([2]), one, two)[0]
    count = lambda a, b: one[a] * np.prod([two[i] / one[i] for i in range(a, b - 1)])
    best = min(count(0, c) + count(c, 10) for c in range(1, 10))
    assert cuts[0] == 0 and cuts[-1] == 10 and len(cuts) == 3 and np.isclose(count(0, cuts[1]) + count(cuts[1], 10), best)


# ---------------------------------------------------------------- leakage


def holds(item, doc):
    """Whether a document holds the item, by every alignment from every two equal words."""
    n, per, short = len(item), leakage.PER_CHANGE, len(item) < leakage.LONG
    starts = [(0, j) for j in range(-leakage.SHIFT, len(doc) + 1)] if short else [(i, j) for i in range(n) for j in range(len(doc)) if item[i] == doc[j]]
    for i, j in starts:
        a, b = item[i:], doc[max(j, 0) :]
        row = list(range(len(b) + 1))
        for x, word in enumerate(a, 1):
            new = [x]
            for y, other in enumerate(b, 1):
                new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (word != other)))
            row = new
            if short:
                if x == n and min(row) * per <= n:
                    return True
            elif x >= leakage.PASSAGE and any(e * per <= x and b[y - 1] == word for y, e in enumerate(row) if y):
                return True
    return False


def test_leaks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)] + [str(i) for i in range(60)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: some(rnd.choice([1, 2, 5, 8, 9, 11, 12, 13, 15, 30, 60, 130])) for i in range(24)}
    docs, rows = {}, []
    for d in range(150):
        w = some(30)
        it = items[rnd.randrange(len(items))]
        n = min(len(it), rnd.choice([5, 8, 9, 11, 12, 13, 16, 17, 24, 40, 130]))
        a = rnd.randrange(len(it) - n + 1)
        part = list(it[a : a + n])
        for _ in range(rnd.choice([0, 1, n // 8, n // 8, n // 7 + 1])):
            at, way = rnd.randrange(len(part)), rnd.random()
            if way < 0.7:
                part[at] = rnd.choice(vocabulary)
            elif way < 0.85:
                part.insert(at, rnd.choice(vocabulary))
            elif len(part) > 1:
                part.pop(at)
        w[10:10] = part
        docs[d] = w
        rows.append((d, " ".join(w).title().replace(" ", ",\n", 3), "s", "z"))
    want = {(d, i) for d, w in docs.items() for i, it in items.items() if holds(it, w)}
    rows += [(1000, None, "s", "z"), (1001, "", None, "z"), (1002, "<p>&nbsp;</p>", "s", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, item_id string")
    its = spark.createDataFrame([(i, " ".join(w), "t") for i, w in items.items()] + [(50, None, "t"), (51, "", "t")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leakage.leaks(df, its).collect()} == want and len(want) > 60
    monkeypatch.setattr(leakage, "HELD_WORDS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(leakage, "HOT_SHINGLE", 2)
    assert {tuple(r) for r in leakage.leaks(df, its).collect()} == want
    assert leakage.leaks(df.limit(0), its).count() == 0 and leakage.leaks(df, its.limit(0)).count() == 0
    assert leakage.leak_report(df, its).count() == 2


def test_leaks_with_changed_words_figures_and_siblings(spark):
    letters = [f"w{chr(97 + i)}" for i in range(26)]
    eight, nine, figures = letters[:8], letters[8:17], [*letters[:6], "12", *letters[17:24]]
    sibling, other = [*letters[10:18], "7", *letters[18:26]], [*letters[10:18], "9", *letters[18:26]]
    items = {1: eight, 2: nine, 3: figures, 4: sibling, 5: other}
    changed = lambda w, at, x: [*w[:at], x, *w[at + 1 :]]
    docs = {
        1: changed(eight, 4, "xx"), 2: changed(nine, 3, "xx"), 3: changed(figures, 6, "14"), 4: sibling, 5: eight[:6], 6: ["qq", *changed(eight, 7, "xx"), "qq"],
        7: [*sibling[:5], *sibling[6:]], 8: changed(sibling, 8, "8"), 9: figures[:11],
    }
    df = spark.createDataFrame([(k, "so " + " ".join(w) + " it was") for k, w in docs.items()], "doc_id long, text string")
    its = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(df, its).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (7, 4), (8, 4), (8, 5)}


# ---------------------------------------------------------------- consensus


def test_consensus_recovers_the_truth_against_a_majority(spark):
    rnd = random.Random(4)
    skill = {"team:ann": 0.95, "bob": 0.95, "cy": 0.2, "dan": 0.2, "eve": 0.9}
    rows, truth = [], {}
    for i in range(400):
        t = rnd.choice(["yes", "no"])
        truth[f"p{i}"] = t
        for c in rnd.sample(sorted(skill), 4):
            said = t if rnd.random() < skill[c] else ("no" if t == "yes" else "yes")
            name = rnd.choice([c, c.upper(), f" {c}", f"coder_{c}"])
            rows.append((f"p{i}", name, None, "?", rnd.choice([said, said.upper() + " ", "YES " if said == "yes" else "N"]), said, None, None, i))
    rows += [("p0", "team:ann", "neg.", None, "", None, None, None, 10_000), ("q", "team:ann", "neutral", None, None, None, None, None, 1), (None, "team:ann", "neg", None, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "pair_id string, coder string, q_label string, a_label string, addressed string, changed_topic string, confidence string, note string, labelled_at int")
    got = {(r["pair_id"], r["field"]): r["label"] for r in consensus.consensus(df).collect()}
    right = np.mean([got[p, "changed_topic"] == t for p, t in truth.items()])
    assert right > 0.93 and not any(f in ("q_label", "a_label") for _, f in got)
    r = {x["coder"]: x["reliability"] for x in consensus.reliability(df).where("field = 'changed_topic'").collect()}
    assert r["team:ann"] > 0.85 and r["cy"] < 0.4
    assert consensus.agreement(df).count() >= 2
    model = consensus.solved(df)[2]
    for field, duals in model.duals.items():
        rises = [b - a for a, b in zip(duals, duals[1:], strict=False)]
        assert model.converged[field] and all(x >= -1e-9 for x in rises), (field, duals)
    assert consensus.consensus(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pairs, scans, abuse


def texts(n, seed=1):
    rnd = random.Random(seed)
    subject = ["deposit balances", "card fees", "the loan book", "staff costs", "trading revenue", "the pension surplus"]
    verb = ["rose", "fell", "improved", "narrowed", "widened"]
    tail = ["because of seasonal bonuses", "in line with plan", "after the sale of a stake", "despite higher wholesale funding"]
    one = lambda: f"{rnd.choice(subject).capitalize()} {rnd.choice(verb)} by {rnd.randint(1, 99)}% in {rnd.randint(2012, 2025)}, {rnd.choice(tail)}."
    return [(f"Why did {rnd.choice(subject)} change in {rnd.randint(2012, 2025)}, and what comes next?", " ".join(one() for _ in range(rnd.randint(1, 4)))) for _ in range(n)]


def test_defects(spark):
    sound = texts(400)
    rows = [(f"s{i}", q, a, "edited", "src", "b") for i, (q, a) in enumerate(sound)]
    q, a = sound[0]
    bad = {
        "e1": (q, None, "empty"), "e2": (q, "", "empty"), "e3": (q, "[no answer]", "empty"), "e4": (None, " - ", "empty"), "c1": (q, q, "copy"), "c2": (q, q.upper(), "copy"),
        "t1": (q, "Deposit balances rose by 4% in 2014, because of sea", "truncated"), "r1": (q, "Respectfully, I can neither confirm nor deny it. Let us move on.", "refusal"),
        "o1": (q, "本季度净利息收入增长了12.6%。我们预计2017年净利息收入将达到47亿元。", "other_language"),
    }
    fine = {"f1": (q, a.rstrip("."), None), "f2": (q, f"{q} {a}", None), "f3": (q, f"We cannot comment on rumours, so let me stay with the facts. {a}", None), "f4": (None, a, None)}
    for k, (x, y, _) in {**bad, **fine}.items():
        rows += [(k, x, y, "edited", "src", "b")] * 2
    df = spark.createDataFrame(rows, "pair_id string, question_text string, answer_text string, text_origin string, source string, bank string")
    got = {r["pair_id"]: r["defect"] for r in pairs.defects(df, 300).collect()}
    assert {k: got.get(k) for k in bad} == {k: d for k, (_, _, d) in bad.items()}
    assert not [k for k in fine if k in got]
    assert sum(k.startswith("s") for k in got) < 8
    assert pairs.defects(df.limit(0)).count() == 0
    empty = df.where("pair_id = 'e1'")
    assert [tuple(r) for r in pairs.defects(empty).collect()] == [("e1", "empty")]


def test_pairs_are_learnt_from_whole_tables(spark):
    """Words, weights and thresholds come from every pair, not from the first ones by hash."""
    sound = texts(900, 5)
    sound = [(q, a + " The zylofant was sold." if i % 9 == 0 else a) for i, (q, a) in enumerate(sound)]
    rows = [("answer", f"k{i}", q, a, None, "src") for i, (q, a) in enumerate(sound)]
    df = spark.createDataFrame(rows + rows[:50] + [("answer", "n", None, None, None, None)], "rec string, rec_key string, question_text string, text string, text_origin string, source string")
    packs = pairs._packs(df, scans.shared(df), 3).cache()
    shards = [pairs._given(x) for x in pairs._unpacked([packs.toPandas()])]
    assert sorted(p for x in shards for p in x) == sorted(sound) and len(shards) == 3 and min(map(len, shards)) > 200
    lexicon, closings = pairs._known(packs)
    alone = pairs.Model(sound)
    assert (lexicon, closings) == (alone.lexicon, alone.closings) and "zylofant" in lexicon
    weights, thresholds = pairs._trained(packs, lexicon, closings)
    models = [pairs.Model(x, lexicon, closings) for x in shards]
    assert np.allclose(weights, np.mean([m.weights for m in models], axis=0), atol=1e-5)
    assert np.allclose(thresholds, np.mean([m.thresholds for m in models], axis=0), atol=1e-5)
    assert sum(map(len, pairs._unpacked([packs.toPandas()]))) == len(sound) + 1  # and the pair without an answer


def test_middle_of_counted_scores():
    rnd = np.random.default_rng(2)
    values, times = rnd.normal(-9, 3, 40).round(3), rnd.integers(1, 9, 40)
    every = np.repeat(values, times)
    middle = np.median(every)
    want = float(np.clip(middle + pairs.LIFT * np.median(np.abs(every - middle)), *pairs.VALLEY))
    assert np.isclose(pairs.beyond(values, times), want) and np.isclose(pairs.beyond(every), want)


def test_refusals_in_words_of_no_list():
    sound = texts(400)
    model = pairs.Model(sound)
    told = [
        "I shall not answer this.", "We refuse to say anything about our plans.", "That question I cannot answer, sorry.", "No comment from us on this matter.", "I am not allowed to tell you.",
        "Nothing will be said about it today.", "We never discuss clients in public.", "You won't get a number from me.", "I'd rather keep silent on that one.", "Not something we can disclose.",
    ]
    listed = {x.lower() for k in pairs.REFUSAL.values() for x in k}
    assert not any(t.rstrip(".").lower() in listed for t in told)
    found = model.defects([q for q, _ in sound[: len(told)]], told)
    assert sum(d == "refusal" for d in found) >= 8
    assert sum(d is not None for d in model.defects([q for q, _ in sound], [a for _, a in sound])) < 8


def test_scans(spark):
    lines = "Deposit bal-\nances improved again because of season-\nPage 7\nElm Bank - Investor Call - 2013-q1\nal bonuscs and the long-\nterm borr0wers rernained in the home market"
    clean = ["Deposit balances improved again because of seasonal bonuses and the long-term borrowers remained in the home market"] * 60
    rows = [("turn", f"c{i}", t, "edited", "x") for i, t in enumerate(clean)] + [("turn", f"n{i}", lines, "scan", "elm_bank-2013-q1-call.txt") for i in range(12)]
    rows += [("turn", "n0", lines, "scan", "elm_bank-2013-q1-call.txt"), ("answer", "z", None, "scan", None), ("answer", "y", "", None, None)]
    df = spark.createDataFrame(rows, "rec string, rec_key string, text string, text_origin string, source string")
    got = {(r["kind"], r["token"]) for r in scans.repairs(df).where("rec_key = 'n0'").collect()}
    assert got == {
        ("hyphen", "balances"), ("hyphen", "seasonal"), ("hyphen", "long-term"), ("pageno", "Page 7"), ("header", "Elm Bank - Investor Call - 2013-q1"),
        ("char", "bonuses"), ("char", "borrowers"), ("char", "remained"),
    }
    fixed = scans.repaired(df).where("rec_key = 'n0'").first()["text"]
    assert fixed == "Deposit balances improved again because of seasonal bonuses and the long-term borrowers remained in the home market"
    assert scans.repairs(df.where("rec_key like 'c%'")).count() == 0
    assert scans.repairs(df.limit(0)).count() == 0


def test_editor_is_right_on_held_out_words():
    rnd = random.Random(3)
    lexicon = {"".join(rnd.choice("aeinorstlmdcbhgu") for _ in range(rnd.randint(5, 10))): 100 for _ in range(900)}
    held = dict(list(lexicon.items())[600:])
    editor = scans.Editor(lexicon, scans.train_editor(dict(list(lexicon.items())[:600])))
    tried = right = 0
    for w in held:
        places = [(i, r, x) for r, xs in scans.CONFUSIONS.items() for x in xs for i in range(len(w)) if w.startswith(r, i)]
        i, r, x = rnd.choice(places)
        bad = w[:i] + x + w[i + len(r) :]
        if bad not in lexicon:
            tried += 1
            right += editor.read(bad.lower()) == w
    assert right / tried > 0.9
    # letters dropped and added, and words broken at line ends
    long = [w for w in held if len(w) > 6]
    assert sum(editor.read(w[:3] + "q" + w[3:]) == w for w in long) / len(long) > 0.7
    assert sum(editor.read(w[:3] + w[4:]) == w for w in long) / len(long) > 0.7
    lexicon = {**lexicon, "year-end": 50, "long-term": 50}
    editor = scans.Editor(lexicon, scans.train_editor(lexicon))
    assert all(editor.join(w[:3], w[3:]) == "join" for w in long) and editor.join("year", "end") == editor.join("long", "term") == "hyphen"


def test_page_numbers_are_told_from_other_figures():
    text = "The margin rose in the quarter\n{}\nand costs fell again in the year\nbecause of lower bonuses"
    weights = scans.train_pages([(text.format(x), "", True) for x in [f"{a} {i}{b} or so" for i in range(12, 32) for a, b in (("so it went on in 20", ""), ("by", "%"), ("it took", " weeks"))]])
    repairer = scans.Repairer({}, {}, {}, {}, weights)
    kind = lambda line: repairer.furniture(text.format(line).split("\n"), "doc")[1]
    assert [kind(x) for x in ("7", "- 12 -", "Page 3", "Page 41 of 60", "p. 9", "[54]", "13 / 49")] == ["pageno"] * 7
    assert [kind(x) for x in ("2019", "14.5%", "in Q3 2019", "12.6% of plan.", "[00:30:01] Right.", "£54m")] == [""] * 6


def test_abuse(spark):
    docs = [(1, "You are a st*pid m.o.r.o.n and everybody knows it.", "s"), (2, "The bank set aside funds.", "s"), (3, "Foreigners are paraasites and must be kicked out of here.", "t"), (4, "Hot girls want sex, n​u​d​e pics. You are an 1d1ot.", "t"),
            (5, None, "t"), (6, " ", None), (7, "The regulator spoke again about short selling of shares.", "s"), (8, "The e.g. case, U.S. B.2 and Q3 4x 5% rose." * 50, "s")]
    df = spark.createDataFrame(docs * 2, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, label string, reviewer string")
    got = {tuple(r) for r in abuse.found(df, none).collect()}
    assert got == {(1, "abusive"), (3, "hateful"), (4, "sexual"), (4, "abusive")}
    assert abuse.rates(df, none).agg({"n_docs": "sum"}).first()[0] == 8
    assert abuse.found(df.limit(0), none).count() == 0


def test_words_outside_the_tree_are_read_if_likely():
    import re

    text = " ".join(m.__doc__ for m in (abuse, scans, pairs, overlap, leakage, sentences)).lower()
    words = re.findall("[a-z]{3,}", text)
    channel = abuse.Channel({w: float(words.count(w)) for w in words})
    assert not {"restoration", "contenders", "storing"} & set(words)
    assert [channel.decode(t) for t in ("restorati0n", "c0ntenders", "st0ring")] == ["restoration", "contenders", "storing"]
    assert [channel.decode(t) for t in ("x9q4z", "b2b", "q3x7")] == [None] * 3


def test_abuse_is_learnt_from_reviews():
    """Sentences that no example has, each in a document of ordinary ones, found again in other documents."""
    rnd = random.Random(8)
    calm = [f"{a} {b} {c}." for a in ("Net income", "The margin", "Our outlook", "Card volume", "The team") for b in ("rose", "fell", "was stable", "met the plan") for c in ("again", "in spring", "for the year", "as told")]
    bad = {
        "abusive": ["Somebody ought to break both your knees", "You brainless worm should vanish", "Crooks like you make me vomit"],
        "hateful": ["Send that whole tribe back in chains", "Such people carry plague and should be fenced in", "Their sort breeds like lice"],
        "sexual": ["He undid her blouse and bit her shoulder in the bed", "Lonely ladies undress for you tonight", "Her thighs trembled under his mouth"],
    }
    listed = {x.lower().rstrip(".") for xs in abuse.examples().values() for x in xs}
    assert not any(x.lower() in listed for xs in bad.values() for x in xs)

    def doc(s=None):
        out = rnd.sample(calm, 4)
        return " ".join(out if s is None else [*out[:2], s + ".", *out[2:]])

    reviewed = [(doc(), "clean") for _ in range(120)] + [(doc(x), k) for k, xs in bad.items() for x in xs for _ in range(4)] + [(doc(), "abusive")] * 2
    model = abuse.fit(reviewed, {}, [doc() for _ in range(50)])
    new = [(doc(x), k) for k, xs in bad.items() for x in xs]
    s = model.documents([t for t, _ in new] + [doc() for _ in range(60)])
    right = sum(s[i, abuse.KINDS.index(k)] >= abuse.THRESHOLD for i, (_, k) in enumerate(new))
    assert right >= 8 and (s[len(new) :] >= abuse.THRESHOLD).sum() <= 1


@pytest.mark.parametrize("token,word", [("$3x", "sex"), ("n***d", "naked"), ("veeeermin", "vermin"), ("m0ron", "moron"), ("1d10t", "idiot"), ("zzz9", None), ("4x", None)])
def test_channel(token, word):
    assert abuse.Channel({"sex": 5, "naked": 5, "vermin": 5, "moron": 5, "idiot": 5, "noted": 0.5}).decode(token) == word


@pytest.mark.parametrize(
    "text,want",
    [
        ("what a m.o.r.o.n he is", "what a moron he is"), ("a s.t.u.p.i.d c.r.e.t.i.n", "a stupid cretin"), ("s.t.u.p.i.d m.o.r.o.n.", "stupid moron."), ("a f-i-l-t-h-y s-t-u-p-1-d m-0-r-o-n", "a filthy stupid moron"),
        ("s t u p i d m o r o n", "stupid moron"), ("s.t.u.p.i.d.m.o.r.o.n", "stupid moron"), ("s*t*u*p*i*d a m.*.r.o.n", "stupid a moron"), ("m.o.r.o.n", "moron"), ("3 m.o.r.o.n", "3 moron"),
        ("x y z", "x y z"), ("2 4 5 s 1 3", "2 4 5 s 1 3"), ("U.S. a b", "U.S. a b"), ("n*k*d", "naked"), ("n***d", "naked"), ("a s****d", "a stupid"),
    ],
)
def test_parted_words_in_a_row(text, want):
    words = {"stupid": 50, "moron": 50, "cretin": 50, "filthy": 50, "naked": 50, "ass": 50, "sod": 900, "nod": 900, "together": 50}
    assert abuse.Channel(words).restore(text) == want
