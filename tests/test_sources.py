import pytest

from colloquy.sources import catalog, packs, transcripts
from colloquy.streaming import windows


def test_store_round_trip(spark, tmp_path):
    s = catalog.Store(spark, str(tmp_path), {"short": "Long Name"})
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, None)], "bank string, n int, tags array<string>")
    s.save(df, "Long Name", ["bank"])
    assert s.has("short") and s.names() == ["long_name"]
    assert {(r["bank"], r["n"]) for r in s.load("short").collect()} == {("a", 1), ("b", 2)}
    s.replace_groups(spark.createDataFrame([("a", 9, None)], df.schema), "Long Name", ["bank"])
    assert {(r["bank"], r["n"]) for r in s.load("short").collect()} == {("a", 9), ("b", 2)}
    with pytest.raises(FileNotFoundError):
        s.load("none")
    docs = "name string, mime string, body string"
    s.put(spark.createDataFrame([("d", "text", "one"), ("e", "text", "two")], docs), "documents", "name")
    s.put(spark.createDataFrame([("d", "text", "three")], docs), "documents", "name", "b")
    assert s.document("d") == "three" and s.document("e") == "two" and s.document("f") is None
    catalog.export(df, str(tmp_path / "out"), ["n"])
    assert catalog.read_strings(spark, str(tmp_path / "out")).columns == ["bank", "tags"]


def test_labels_overlay_and_problems(spark, tmp_path):
    (tmp_path / "p_labels_ann.csv").write_text("pair_id,label\n1,yes\n2,\n")
    t = catalog.read_labels(spark, [str(tmp_path / "p_labels_ann.csv")], "pair_id", "label")
    assert {tuple(r) for r in t.collect()} == {("ann", "1", "yes"), ("ann", "2", None)}
    new = spark.createDataFrame([("1", "no"), ("2", "")], "pair_id string, label_new string")
    assert {r["pair_id"]: r["label"] for r in catalog.overlay(t, new, "pair_id", "label", "label_new").collect()} == {"1": "no", "2": None}
    labels = spark.createDataFrame([("1", "yes"), ("1", "maybe"), ("9", "no")], "id string, l string")
    items = spark.createDataFrame([("1",), ("2",)], "id string")
    assert {tuple(r) for r in catalog.problems(labels, items, "id", "l", ["yes", "no"]).collect()} == {
        ("1", "label not allowed"), ("9", "unknown item"), ("2", "missing item"), ("1", "repeated item"),
    }


def test_pack_rules(spark):
    rows = [("f", "s", 1, ["Total income", "31,440 ", "30,000"]), ("f", "s", 2, ["Total income again", "5", "4"]), ("f", "s", 3, ["At constant currency", None, None]), ("f", "s", 4, ["Operating costs", "9", "8"])]
    g = spark.createDataFrame(rows, "file string, sheet string, row_no int, cells array<string>")
    got = {r["metric"]: (r["value"], r["prior"]) for r in packs.first_matches(g, {"income": "^total income", "costs": "costs"}, "constant currency").collect()}
    assert got == {"income": (31440.0, 30000.0)}
    assert packs.shortest_matches(g, {"income": "total income"}).first()["cells"][1] == "31,440 "
    lines = spark.createDataFrame([("f", 1, "| a | b |"), ("f", 2, "|---|---|"), ("f", 3, "no")], "file string, line_no int, line string")
    assert packs.pipe_table(lines).first()["cells"] == ["a", "b"]
    feed = spark.createDataFrame([('{"title":"t","link":"u"}',), ('{"content":{"title":"x","canonicalUrl":{"url":"y"}}}',)], "json string")
    assert {(r["title"], r["url"]) for r in packs.feed_items(feed).collect()} == {("t", "u"), ("x", "y")}


def test_manifest(spark):
    files = spark.createDataFrame([("/d/elm/2024-2q-call.txt",), ("/d/elm/2024-2q-call.txt",), ("/d/oak/2023 fy pack.xlsx",), ("/d/oak/~$2023.xlsx",), ("/d/oak/2023-annual-analysts-meeting.txt",)], "path string")
    got = {r["source"]: (r["bank"], r["kind"], r["quarter"], r["event_type"]) for r in packs.manifest(files, ["elm", "oak"]).collect()}
    assert got["2024-2q-call.txt"] == ("elm", "transcript", "2024-q2", "results_call")
    assert got["2023 fy pack.xlsx"] == ("oak", "results_pack", "2023-annual", "results_call")
    assert got["2023-annual-analysts-meeting.txt"][3] == "other" and len(got) == 3


def test_layouts(spark):
    body = "This is a turn that is long enough."
    caps = "\n".join(f"{n}: {body}" for n in ["ANN LEE, GROUP CFO", "BOB RAY, ELM RESEARCH", "ANN LEE, GROUP CFO", "OPERATOR", "CY DAY, ELM RESEARCH"])
    dash = "\n".join(f"{n}\n{body}" for n in ["Ann Lee -- Chief Executive", "Bob Ray -- Elm Research", "Ann Lee -- Chief Executive", "Bob Ray -- Elm Research", "Cy Day -- Analyst"])
    comma = f"Ann Lee, Group CFO\n{body}\nBob Ray, Elm Research\n{body}"
    df = spark.createDataFrame([("a", "bk", caps), ("b", "bk", dash), ("c", "bk", comma), ("d", "bk", None)], "source string, bank string, text string")
    got = {}
    for r in transcripts.segment(df).orderBy("source", "turn_no").collect():
        got.setdefault((r["source"], r["layout"]), []).append(r["role"])
    assert got == {
        ("a", "caps"): ["management", "analyst", "management", "analyst"], ("b", "dash"): ["management", "analyst", "management", "analyst", "analyst"],
        ("c", "comma"): ["management", "analyst"],
    }


def test_streams_equal_tables(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), "a" if i % 2 else "b", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.parquet_stream(spark, str(tmp_path / "in"), df)
    got = windows.run_once(windows.tumbling(stream, "ts", "1 day"), "tumbled", str(tmp_path / "c1"), "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in windows.tumbling(df, "ts", "1 day").collect()}
    prints = spark.createDataFrame([("a", "x", 1, 3), ("a", "x", 2, 0), ("a", "x", 3, 1), ("a", "y", 1, 0)], "bank string, topic string, print_no int, n_turns int")
    prints.coalesce(1).write.parquet(str(tmp_path / "p"))
    out = windows.run_once(windows.presence_stream(windows.parquet_stream(spark, str(tmp_path / "p"), prints)), "present", str(tmp_path / "c2"))
    assert {(r["topic"], r["print_no"]): r["delta"] for r in out.collect()} == {("x", 1): "first_seen", ("x", 2): "disappeared", ("x", 3): "appeared", ("y", 1): "first_absent"}


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "lm.csv").write_text("Word,Negative,Positive,Uncertainty\nLOSS,2009,0,0\nGAIN,0,2009,\nMAY,0,x,2009\n,1,1,1\n")
    lex = catalog.read_lexicon(spark, str(tmp_path / "lm.csv"))
    assert {tuple(r) for r in lex.collect()} == {("negative", "loss"), ("positive", "gain"), ("uncertainty", "may")}
    rows = spark.createDataFrame([(1, "A loss, a LOSS, maybe a gain may come"), (2, None), (3, "")], "k int, t string")
    assert {tuple(r) for r in catalog.category_counts(rows, "k", "t", lex).collect()} == {(1, "negative", 2), (1, "positive", 1), (1, "uncertainty", 1)}
