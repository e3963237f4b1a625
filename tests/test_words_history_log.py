import json

from pyspark.sql import functions as F

from confab.operators import commitlog, history, words
from confab.streaming import ingest

TOK = "key string, seq long, type string, text string, start_ms long, end_ms long"


def test_spacing_tokens(spark):
    t = [("k", 0, "word", "Ahoj", 0, 1), ("k", 1, "spacing", "", None, None), ("k", 2, "word", "!", 1, 2), ("k", 3, "spacing", " ", None, None), ("k", 4, "audio_event", "(x)", 2, 3), ("k", 5, "word", "No", 3, 4), ("k", 6, "word", "bad", None, 5)]
    got = words.spaced_words(spark.createDataFrame(t, TOK)).orderBy("seq").collect()
    assert [(r.text, r.lead_space) for r in got] == [("Ahoj", False), ("!", False), ("No", True)]


def test_coalesce_words(spark):
    w = spark.createDataFrame([("k", 0, 0, 500, "A", False), ("k", 1, 2500, 3000, "b.", True), ("k", 2, 3100, 3200, "C", True)], "key string, seq long, start_ms long, end_ms long, text string, lead_space boolean")
    assert [(r.text, r.start_ms, r.end_ms) for r in words.coalesce_words(w).orderBy("segment_no").collect()] == [("A", 0, 500), ("b.", 2500, 3000), ("C", 3100, 3200)]


def test_token_words(spark):
    t = spark.createDataFrame([("k", i, x, i, i + 1) for i, x in enumerate([" r", "ô", "z", "ne", "."])], "key string, seq long, text string, start_ms long, end_ms long")
    assert [(r.text, r.end_ms, r.lead_space) for r in words.token_words(t).collect()] == [("rôzne.", 5, True)]


def test_words_by_count(spark):
    s = spark.createDataFrame([("k", 0, "ahoj"), ("k", 1, "jak  sa"), ("k", 2, ""), ("k", 3, "mas")], "key string, seq long, text string")
    w = spark.createDataFrame([("k", i, x) for i, x in enumerate(["ahoj", "jak", "sa", "mas", "left"])], "key string, word_no long, text string")
    assert {r.seq: r.words for r in words.bucket_words(s, w).collect()} == {0: ["ahoj"], 1: ["jak", "sa"], 3: ["mas"]}


def test_segments_of_over_a_thousand_words(spark, tmp_path):
    from confab.plans import queries

    said = {0: [f"a{i}" for i in range(1203)], 1: ["b0", "b1", "b2"], 2: ["c0", "c1"]}
    rows = [("k", n, 1000.0 * n, 1000.0 * n + 900, " ".join(ws), [(1000.0 * n + i / 2, 1000.0 * n + i / 2 + 0.4, w, True) for i, w in enumerate(ws)]) for n, ws in said.items()]
    df = spark.createDataFrame(rows, f"call_id string, seq long, start double, end double, text string, words array<{words.WORD}>")
    df.write.parquet(f"{tmp_path}/segments.parquet")
    every = sorted(w for ws in said.values() for w in ws)
    assert {r.seq: r.words for r in queries.word_bucket(spark, str(tmp_path)).collect()} == {n: " ".join(ws) for n, ws in said.items()}
    assert [r.text for r in queries.word_coalesce(spark, str(tmp_path)).orderBy("segment_no").collect()] == [" ".join(said[n]) for n in said]
    assert sorted(r.text for r in queries.token_words(spark, str(tmp_path)).collect()) == every
    got = queries.spacing_tokens(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == every and all(r.lead_space for r in got)


def test_retime():
    w = lambda t, s, e: {"start": s, "end": e, "text": t, "lead_space": True}
    got = words.retime([w("Um,", 0.0, 0.2), w("I", 0.3, 0.5), w("think", 0.6, 0.9), w("so.", 1.0, 1.2)], "I think so.")
    assert [x["start"] for x in got] == [0.3, 0.6, 1.0]
    got = words.retime([w("Hello", 0.0, 1.0), w("world", 4.0, 5.0)], "Hello my dear world")
    assert got[0]["start"] == 0.0 and got[3]["start"] == 4.0 and all(1.0 <= x["start"] <= 4.0 for x in got[1:3])
    assert words.retime([], "a b")[1]["start"] == 0.0 and words.retime([w("a", 0.0, 1.0)], "") == []


HIST = "id long, source_path string, model string, language string, audio_duration_seconds double, elapsed_seconds double, started_at string, status string, output_path string, turns_json string"


def test_estimates(spark):
    rows = [(1, "a", "m", "cs", 100.0, 40.0, "t", "success", "o", None), (2, "a", "n", None, 100.0, 50.0, "t", "success", "o", None), (3, "a", "n", None, 100.0, 999.0, "t", "error", "o", None)]
    rows += [(10 + i, "a", "x", "en", 1.0, 9.0 if i < 5 else 0.5, "t", "success", "o", None) for i in range(25)]
    h = history.migrated(spark.createDataFrame(rows, HIST))
    q = spark.createDataFrame([("m", "en", 100.0), ("n", None, 100.0), ("z", "en", 200.0), ("x", "en", 10.0)], "model string, language string, duration double")
    assert {r.model: r.seconds for r in history.estimate(q, h).collect()} == {"m": 40.0, "n": 50.0, "z": 70.0, "x": 5.0}


def test_latest_turns_and_json(spark):
    rows = [(1, "a", "m", None, 1.0, 1.0, "t", "success", "o", '[{"speaker":"old"}]'), (2, "a", "m", None, 1.0, 1.0, "t", "success", "o", '[{"speaker":"P","text":"x"}]'), (3, "a", "m", None, 1.0, 1.0, "t", "success", "o", None), (4, "a", "m", None, 1.0, 1.0, "t", "success", "p", '[{"spe')]
    h = spark.createDataFrame(rows, HIST)
    got = {r.output_path: r.turns_json for r in history.latest_turns(h).collect()}
    assert json.loads(got["o"])[0]["speaker"] == "P"
    assert [r.n for r in h.where("id in (2, 4)").orderBy("id").select(history.parsed_turns("turns_json").alias("t")).select(F.when(F.col("t").isNotNull(), F.size("t")).alias("n")).collect()] == [1, None]


def test_resumable_oldest_first(spark):
    rows = [("done", "09:00", 1), ("running", "12:00", 2), ("paused", "08:00", 3), ("running", None, 4)]
    got = history.resumable(spark.createDataFrame(rows, "status string, started_at string, id long")).collect()
    assert [r.id for r in got] == [4, 3, 2]


def test_committed_rows(spark):
    log = spark.createDataFrame([("k", "t0", 0, "a0"), ("k", "t0", 5, "a5"), ("k", "t1", 0, "b0"), ("k", "t1", 1, "b1"), ("x", "t0", 0, "no")], "key string, unit string, chunk int, text string")
    points = spark.createDataFrame([("k", ["t0"], "t1", 1)], "key string, completed_units array<string>, partial_unit string, partial_done_chunks int")
    assert sorted(r.text for r in commitlog.committed(log, points).collect()) == ["a0", "a5", "b0"]


def test_torn_lines_are_dropped(spark):
    lines = spark.createDataFrame([('{"unit":"u","start":0.0,"end":1.0,"text":"a"}',), ("",), ('{"unit":"u","te',)], "value string")
    assert [(r.text, r.chunk) for r in commitlog.parse_lines(lines).collect()] == [("a", 0)]


def test_stream_commits_once(spark, tmp_path):
    src, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    rows = lambda chunks: [json.dumps({"key": "k", "line_no": c, "unit": "u", "chunk": c, "start": 0.0, "end": 1.0, "text": f"c{c}"}) for c in chunks]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(rows([0, 1])))
    ingest.commit(ingest.chunk_stream(spark, src), log, state).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join(rows([1, 2])))  # chunk 1 again, after a crash
    ingest.commit(ingest.chunk_stream(spark, src), log, state).awaitTermination()
    ingest.commit(ingest.chunk_stream(spark, src), log, state).awaitTermination()
    got = ingest.read_log(spark, log)
    assert sorted(r.text for r in got.collect()) == ["c0", "c1", "c2"]
    assert [(r.chunks, r.speech) for r in ingest.progress(got).collect()] == [(3, 3.0)]
