import json

from pyspark.sql import functions as F

from confab.functions import formats
from confab.operators import catalog, edits, evaluate, polish
from confab.sources import files


def test_formats(spark):
    rows = [(0.0,), (65.0,), (3725.0,), (0.5,), (2.5,), (-5.0,), (None,)]
    d = spark.createDataFrame(rows, "s double").select(formats.timestamp("s"), formats.timecode("s"), formats.minutes_left("s"), formats.elapsed("s"), formats.duration("s")).collect()
    assert [r[0] for r in d] == ["00:00", "01:05", "01:02:05", "00:00", "00:02", "00:00", None]
    assert [r[1] for r in d][:3] == ["0:00", "1:05", "1:02:05"] and d[6][1] == "0:00"
    assert [r[2] for r in d] == ["<1 min", "1 min", "62 min", "<1 min", "<1 min", None, None]
    assert d[1][3] == "1m 05s" and d[6][3] == "-" and d[0][4] == "" and d[6][4] == ""


def accepted(spark, raw, edited):
    return edits.accept(spark.createDataFrame([(raw, edited)], "raw string, edited string")).collect()[0].accepted


def test_accept(spark):
    raw = "dneska rano jsme sli domu spolecne"
    assert accepted(spark, raw, "Dneska ráno jsme šli domů společně.") == "Dneska ráno jsme šli domů společně."
    assert accepted(spark, raw, raw * 5) == raw and accepted(spark, raw, None) == raw
    assert accepted(spark, raw, "úplně jiná slova která nikdo neřekl") == raw
    assert accepted(spark, raw, f"```text\n{raw}!\n```") == raw + "!"


def test_drift_and_vote(spark):
    d = edits.drift(spark.createDataFrame([("it cost 1 000 then", "it costs 1,000 and 25 and 25")], "raw string, edited string")).collect()[0]
    assert d.novel_words == ["costs", "000", "and"] or "costs" in d.novel_words
    assert d.novel_numbers == ["25", "25"]
    v = spark.createDataFrame([("g", "b", 0), ("g", "a", 1), ("g", "a", 2), ("g", "b", 3), ("h", "x", 0)], "k string, v string, n int")
    assert [(r.k, r.v, r.votes) for r in edits.vote(v, ["k"], "v", "n").collect()] == [("g", "b", 2)]
    assert edits.gated("we met john there", "We met peter there.") == "We met john there"


def test_quality(spark):
    t = " ".join(["a b c d e"] * 3)
    n, share = edits.repetition(F.col("t"))
    r = spark.createDataFrame([(t,), ("x",), ("",)], "t string").select(n.alias("n"), share.alias("s"), edits.phrase_hits(F.col("t")).alias("h")).collect()
    assert r[0].n == 15 and abs(r[0].s - (1 - 5 / 11)) < 1e-9 and r[1].s == 0 and r[2].n == 0


def test_polish_batches(spark):
    b = spark.createDataFrame([("c", i, f"text number {i} spoken") for i in range(1, 14)], "call_id string, block_no long, text string")
    got = polish.polish_blocks(b, lambda q: json.dumps([t.replace("text", "Text") for t in json.loads(q)])).orderBy("block_no").collect()
    assert [r.polished for r in got] == [f"Text number {i} spoken" for i in range(1, 14)]
    assert all(r.polished == r.text for r in polish.polish_blocks(b, lambda q: "no json").collect())
    assert polish.parse_reply('["a", 1]', 2) == ["a", None] and polish.parse_reply('["a"]', 2) == [None, None] and polish.parse_object('x {"a": 1} y') == {"a": 1}


def test_bench_and_ratings(spark):
    runs = spark.createDataFrame([("a", 10.0, 5.0), ("b", 0.0, 5.0), ("c", 10.0, 0.0)], "id string, duration double, elapsed double")
    assert [(r.rtf, r.speedup) for r in evaluate.metrics(runs).orderBy("id").collect()] == [(0.5, 2.0), (None, None), (None, None)]
    cols = "id string, seconds double, error string, rating int, notes string"
    old = spark.createDataFrame([("a", 1.0, None, 4, "n"), ("b", 2.0, None, 3, "m")], cols)
    new = spark.createDataFrame([("a", 9.0, None, None, ""), ("b", None, "boom", None, ""), ("c", 3.0, None, None, "")], cols)
    got = {r.id: (r.seconds, r.error, r.rating) for r in evaluate.upsert_runs(old, new).collect()}
    assert got == {"a": (9.0, None, 4), "b": (2.0, "boom", 3), "c": (3.0, None, None)}
    rated = evaluate.rate(old, spark.createDataFrame([("a", 9, "x", 1), ("a", 5, None, 2), ("z", 1, "q", 3)], "id string, rating int, notes string, seq int"))
    assert {r.id: (r.rating, r.notes) for r in rated.collect()} == {"a": (5, ""), "b": (3, "m")}


def test_names_and_options(spark):
    t = spark.createDataFrame([("c", 0, 1, None), ("c", 2, 1, "Eva"), ("c", 2, 1, "Eva"), ("c", 5, 1, " ")], "call_id string, idx int, channels int, title string")
    assert [r.name for r in catalog.named_tracks(t).orderBy("idx").collect()] == ["Speaker 1", "Eva", "Speaker 3"]
    w = spark.createDataFrame([("f", "call", ".md", 1), ("f", "call", ".md", 2)], "folder string, stem string, suffix string, seq int")
    taken = spark.createDataFrame([("f", "call.md")], "folder string, name string")
    assert [r.name for r in catalog.free_names(w, taken).orderBy("seq").collect()] == ["call (2).md", "call (3).md"]
    d = spark.createDataFrame([([1, 2], ["a", "b"], "b")], "s array<int>, n array<string>, x string")
    r = d.select(catalog.include(F.col("s"), F.lit(2), F.lit(False)).alias("i"), catalog.remember(F.col("n"), F.col("x")).alias("m"), catalog.place_of(F.col("s"), F.lit(9)).alias("p")).collect()[0]
    assert r.i == [1] and r.m == ["b", "a"] and r.p == 0


def test_media_listing_and_probe(spark, tmp_path):
    for p in ("call.mp3", "nested/call.MP4", "nested/deeper/call.wav", "notes.txt", "image.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [r.path.split(str(tmp_path) + "/")[1] for r in files.media(spark, str(tmp_path)).collect()] == ["call.mp3", "nested/call.MP4", "nested/deeper/call.wav"]
    j = spark.createDataFrame([("a", '{"streams":[{"index":1,"tags":{"title":" Eva "}},{"index":2,"channels":2,"tags":{"title":" "}}],"format":{"duration":"3.5"}}'), ("b", "{bad")], "call_id string, json string")
    assert [(r.idx, r.channels, r.title, r.duration) for r in files.streams(j).orderBy("idx").collect()] == [(1, 1, "Eva", 3.5), (2, 2, None, 3.5)]


def test_transcripts_read_back(spark):
    t = "---\nmodel: x\n---\n\n**P** [00:00]\none\n\n**Q** [00:04] (interrupting)\ntwo\nmore\n"
    d = spark.createDataFrame([(1, t), (2, "A\n\nB\n"), (3, ""), (4, None)], "id int, text string")
    got = files.transcript_turns(d, "id").orderBy("id", "turn_no").collect()
    assert [(r.id, r.speaker, r.ts, r.interrupting, r.text) for r in got] == [(1, "P", "00:00", False, "one"), (1, "Q", "00:04", True, "two\nmore"), (2, "", "", False, "A"), (2, "", "", False, "B")]
