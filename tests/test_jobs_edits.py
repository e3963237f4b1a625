import json
import time

import pytest
from pyspark.sql import functions as F

from confab.functions import formats
from confab.operators import catalog, edits, evaluate, jobs, polish, recognise, turns
from confab.sources import files
from confab.streaming.queue import JobQueue

JOB = "id long, source_path string, status string, status_detail string, error string, output_path string, polish boolean, audio_duration_seconds double, estimated_seconds double, estimated_polish_seconds double, transcribe_fraction double, transcribe_position_fraction double, elapsed double, polish_elapsed double"


def job(i, status, **more):
    empty = dict.fromkeys((c.split()[0] for c in JOB.split(", ")))
    return tuple((empty | {"id": i, "source_path": "/r/call.one.mp3", "status": status, "polish": False} | more).values())


def test_lines_and_panel(spark):
    rows = [
        job(1, "transcribing", transcribe_fraction=0.5, transcribe_position_fraction=0.25, audio_duration_seconds=200.0, elapsed=100.0, status_detail="track 1/2 - Bob"),
        job(2, "transcribing", estimated_seconds=100.0, elapsed=20.0, polish=True, estimated_polish_seconds=0.0),
        job(3, "transcribing"), job(4, "polishing", polish=True, estimated_seconds=60.0, estimated_polish_seconds=40.0, polish_elapsed=10.0), job(5, "error", error="boom"), job(6, "ready"), job(7, "ready", audio_duration_seconds=5.0),
        job(8, "queued", estimated_seconds=65.0), job(9, "converting", elapsed=5.0), job(10, "done", elapsed=61.0), job(11, "stopped"), job(12, "loading model"),
    ]
    d = spark.createDataFrame(rows, JOB)
    got = {r.id: (r.status_line, r.bar and round(r.bar, 6), r.detail) for r in jobs.lines(d).collect()}
    assert got[1] == ("transcribing (track 1/2 - Bob)", 50.0, "track 1/2 - Bob  ·  0:50 / 3:20  ·  ~2 min left")
    assert got[2] == ("transcribing", 19.0, "~ Estimated 1 min left") and got[3] == ("transcribing", None, "Transcribing…")
    assert got[4] == ("polishing", 70.0, "Polishing…  ·  ~<1 min left") and got[5] == ("error: boom", 0.0, "-")
    assert [got[i][2] for i in range(6, 13)] == ["estimating...", "-", "waiting... (~1m 05s)", "5s", "done in 1m 01s", "stopped", "Loading model…"] and got[12][1] is None
    p = {r.id: (r.title, r.detail) for r in jobs.panel(d).collect()}
    assert p[1] == ("Transcribing: call.one.mp3 (track 1/2 - Bob)", "0:50 / 3:20  •  50%  •  about 2 min left") and p[9] == ("Converting: call.one.mp3", "5s elapsed") and 10 not in p
    assert [r.name for r in jobs.in_flight(d).where("id = 1").collect()] == ["call.one"]


def test_shares(spark):
    rows = [(0.0, 10.0), (10.0, 0.0), (0.0, 0.0), (None, None), (50.0, 50.0), (75.0, 25.0)]
    d = spark.createDataFrame(rows, "t double, p double").select(formats.polish_share("t", "p").alias("on"), formats.polish_share("t", "p", False).alias("off")).collect()
    assert [r.on for r in d] == [0.4, 0.05, 0.0, 0.0, 0.4, 0.25] and {r.off for r in d} == {0.0}


def test_checkpoints(spark, tmp_path):
    texts = [json.dumps({"key": "a", "config": {"source_path": "/x", "model": "m", "track_names": {"2": "Eva"}}, "completed_units": ["track1"]}), '{"key": "b", "sta', '{"status": "paused"}', "", None, "[1]"]
    c = jobs.checkpoints(spark.createDataFrame([(t,) for t in texts], "value string"))
    r = c.collect()
    assert [(x.key, x.status, x.phase, x.completed_units, x.partial_done_chunks) for x in r] == [("a", "running", "queued", ["track1"], 0)]
    again = jobs.checkpoints(jobs.checkpoint_json(c)).collect()[0]
    assert again.updated_at and again.config.track_names == {"2": "Eva"} and again.key == "a"
    assert [x.go for x in jobs.resumed(c, spark.createDataFrame([("/x",)], "path string")).collect()] == ["queue"]
    assert [x.go for x in jobs.resumed(c, spark.createDataFrame([], "path string")).collect()] == ["discard"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "job.json").write_text("{}")
    assert jobs.discard(spark, str(tmp_path / "a")) and not (tmp_path / "a").exists() and not jobs.discard(spark, str(tmp_path / "a"))


def test_configs(spark):
    d = spark.createDataFrame([(1, "/a", "m", [3, 1], {2: "Eva"}, {}, {1: [2, 3]})], "id int, source_path string, model string, selected_track_indices array<int>, track_names map<int,string>, track_languages map<int,string>, track_subtractions map<int,array<int>>")
    r = jobs.config_json(d)
    assert json.loads(r.collect()[0].config)["selected_track_indices"] == [1, 3]
    got = jobs.parsed_config(r).collect()[0]
    assert (got.selected_track_indices, got.track_names, got.track_languages, got.track_subtractions, got.polish, got.language) == ([1, 3], {2: "Eva"}, None, {1: [2, 3]}, False, None)


def test_queue(spark, tmp_path):
    heard = []

    def work(job, stopping):
        if job["id"] == "bad":
            raise ValueError("no")
        if job["id"] == "long":
            q.stop("long")
            while not stopping():
                time.sleep(0.01)
        n = spark.range(100).count()
        return {"output_path": f"/out/{job['id']}.md", "turns_json": str(n)}

    q = JobQueue(spark, work, heard.append, str(tmp_path / "history"), str(tmp_path / "jobs"), grace=1.0)
    (tmp_path / "jobs" / "long").mkdir(parents=True)
    for i in ("one", "bad", "long", "never"):
        q.submit({"id": i, "source_path": f"/{i}", "model": "m", "language": None})
    q.stop("never")
    q.run()
    assert {i: j["status"] for i, j in q.known.items()} == {"one": "done", "bad": "error", "long": "stopped", "never": "stopped"}
    assert sorted((r.source_path, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "history")).collect()) == [("/bad", "error", "ValueError: no"), ("/long", "stopped", None), ("/never", "stopped", None), ("/one", "success", None)]
    assert q.resume("never") and not q.resume("nobody") and not q.stop("nobody")
    q.run()
    assert q.known["never"]["status"] == "done" and [j["status"] for j in heard if j["id"] == "one"] == ["queued", "transcribing", "done"]
    assert q.discard("long") and not (tmp_path / "jobs" / "long").exists() and not q.resume("long")


def test_recognisers(spark):
    units = spark.createDataFrame([("k", "u", "/a", "large", "cs"), ("k", "v", "/b", "Parakeet-x", None), ("k", "w", "/c", "groq:x", None)], "key string, unit string, path string, model string, language string")
    chunks = spark.createDataFrame([("k", "u", 0.0, 10.0), ("k", "u", 12.0, 20.0), ("k", "u", 30.0, 31.0), ("k", "v", 0.0, 1.0)], "key string, unit string, start double, end double")
    tasks = recognise.chunk_tasks(units, chunks, spark.createDataFrame([("k", "u", 1)], "key string, unit string, chunks int"))
    assert sorted((r.unit, r.chunk, r.start, r.end) for r in tasks.collect()) == [("u", 1, 12.0, 20.0), ("u", 2, 30.0, 31.0), ("v", 0, 0.0, None), ("w", 0, 0.0, None)]
    say = lambda: lambda path, language, start, end: [(0.0, 1.0, f" {path} "), (1.0, 2.0, " ")]
    got = recognise.recognised(tasks, {"whisper": say, "parakeet": say}).collect()
    assert sorted((r.unit, r.chunk, r.start, r.text, r.error is None) for r in got if r.text) == [("u", 1, 12.0, "/a", True), ("u", 2, 30.0, "/a", True), ("v", 0, 0.0, "/b", True)]
    assert [(r.unit, r.error) for r in got if r.error] == [("w", "KeyError: 'groq'")]
    p = spark.createDataFrame([("k", "u", i, 0.9 if i in (10, 11, 14, 30) else 0.1) for i in range(40)], "key string, unit string, n int, p double")
    r = recognise.regions_of(p, 0.5, 0.1).orderBy("start").collect()
    assert [(round(x.start, 3), round(x.end, 3)) for x in r] == [(0.8, 1.7), (2.8, 3.3)]


@pytest.mark.parametrize(
    "raw,edited,want",
    [
        ("we met john there", "We met peter there.", "We met john there"),
        ("no no stop now", "Stop, now.", "Stop, now."),
        ("short", "short " * 9, "short"),
        ("um", "", "um"),
        ("aaaa bbbb", "aaaa xy bbbb", "aaaa xy bbbb"),
        ("a b", "a xy b", "a b"),
        ("dneska rano", "Dneska ráno", "Dneska ráno"),
    ],
)
def test_gate(raw, edited, want):
    assert edits.gated(raw, edited) == want


def test_ensemble(spark):
    assert edits.agreed("a b c", ["A b c", "A c", "a c d"]) == "A c"
    assert edits.agreed("a b", ["a x b y", "a x b", "a b y"]) == "a x b y" and edits.agreed("", ["x"]) == "" and edits.agreed("a", ["", "", "a"]) == "a"
    d = spark.createDataFrame([("a b", ["A b", "A b", None]), ("a", None), (None, ["x"])], "r string, c array<string>").select(edits.ensemble()("r", "c").alias("o")).collect()
    assert [x.o for x in d] == ["A b", "a", None]


def test_packs_and_strategies(spark):
    b = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate([5, 700, 600, 300, 1600, 2, 3])] + [("d", 1, "y")], "call_id string, block_no int, text string")
    got = lambda **k: sorted((r.call_id, r.pack, [x["block_no"] for x in r.blocks]) for r in polish.packs(b, **k).collect())
    assert got(max_chars=1500) == [("c", 0, [0, 1, 2]), ("c", 1, [3]), ("c", 2, [4]), ("c", 3, [5, 6]), ("d", 0, [1])]
    assert got(max_turns=5) == [("c", 0, [0, 1, 2, 3, 4]), ("c", 1, [5, 6]), ("d", 0, [1])] and got() == [("c", 0, list(range(7))), ("d", 0, [1])]
    assert got(max_turns=2, max_chars=1500)[0] == ("c", 0, [0, 1])
    loud = lambda q: json.dumps([t.upper() for t in json.loads(q)]) if q.startswith("[") else q.upper()
    for g in ("batch_small", "whole_array"):
        assert {(r.call_id, r.block_no): r.edited for r in polish.cleaned(b, g, loud).collect()} == {(c, i): t.upper() if c == "c" and (g == "whole_array" or i < 5) else t for c, i, t in [tuple(r) for r in b.collect()]}
    assert {r.block_no: r.edited[:1] for r in polish.cleaned(b.where("call_id = 'c'"), "isolated", loud).collect()} == {0: "x", 1: "X", 2: "X", 3: "X", 4: "X", 5: "x", 6: "x"}
    seen = polish.cleaned(b.where("call_id = 'c'"), "window", lambda q: str(q.count("\n"))).collect()
    assert {r.block_no: r.edited for r in seen if len(r.raw) > 12} == {1: "6", 2: "7", 3: "7", 4: "7"}
    with pytest.raises(ValueError):
        polish.cleaned(b, "none", loud)


def test_tournament(spark, tmp_path):
    b = spark.createDataFrame([("c", i, f"this is the text number {i}") for i in range(7)], "call_id string, block_no int, text string")
    asked = spark.sparkContext.accumulator(0)

    def model(change):
        def answer(q):
            asked.add(1)
            return json.dumps([change(t) for t in json.loads(q)]) if q.startswith("[") and q[1] == '"' else None

        return answer

    models = {"a": model(str.capitalize), "b": model(str.capitalize), "c": model(lambda t: t + " invented")}
    configs = [{"name": "one", "granularity": "batch_small", "model": "a"}, {"name": "gate", "granularity": "batch_small", "algorithm": "diff_gate", "model": "c"}, {"name": "vote", "granularity": "whole_array", "algorithm": "ensemble"}, {"name": "check", "granularity": "batch_small", "algorithm": "self_verify", "model": "a"}]
    got = {(r.config, r.block_no): r.edited for r in polish.tournament(b, configs, models, str(tmp_path)).collect()}
    assert got["one", 3] == got["vote", 3] == got["check", 3] == "This is the text number 3" and got["gate", 3] == "this is the text number 3"
    n = asked.value
    assert {(r.config, r.block_no): r.edited for r in polish.tournament(b, configs, models, str(tmp_path)).collect()} == got and asked.value == n
    assert [r.failed for r in edits.looks_failed(spark.createDataFrame([("k", "x" * 121, "x" * 121), ("l", "x" * 120, "x" * 120)], "k string, raw string, edited string"), "k").orderBy("k").collect()] == [True, False]


def test_polish_text(spark):
    d = spark.createDataFrame([(1, "first line of it\nsecond line"), (2, None), (3, "")], "id int, text string")
    assert [r.polished for r in polish.polish_text(d, "id", lambda t: t.replace("line", "Line"), limit=20).orderBy("id").collect()] == ["first Line of it\nsecond line", None, ""]


def test_families_states_and_names(spark):
    m = spark.createDataFrame([("groq:whisper",), ("elevenlabs:scribe_v2",), ("mlx/Parakeet-tdt",), ("Groq:x",), ("large-v3",), (None,)], "m string")
    assert [r.f for r in m.select(catalog.family(F.col("m")).alias("f")).collect()] == ["groq", "elevenlabs", "parakeet", "whisper", "whisper", "whisper"]
    d = spark.createDataFrame([(x,) for x in ("Speaker 3", "Track 3", "", "Eva", " ")], "x string").select(catalog.remember(F.array(F.lit("a"), F.lit("Eva")), F.col("x")).alias("r")).collect()
    assert [r.r for r in d] == [["a", "Eva"], ["Track 3", "a", "Eva"], ["a", "Eva"], ["Eva", "a"], [" ", "a", "Eva"]]
    ids = "call_id string, idx int"
    t = spark.createDataFrame([("c", i) for i in range(1, 7)], ids)
    sel = t.where("idx in (1, 2, 3, 6)")
    subs = spark.createDataFrame([("c", 2, [1]), ("c", 3, [1])], ids + ", subtract array<int>")
    w = spark.createDataFrame([("c", 2, 1, "contains"), ("c", 3, 6, "duplicate"), ("c", 4, 1, "duplicate")], "call_id string, mix_idx int, component_idx int, kind string")
    dup = spark.createDataFrame([("c", 5, None)], ids + ", duplicate_of int")
    assert {r.idx: r.state for r in catalog.track_states(t, sel, subs, w, dup).collect()} == {1: "clean", 2: "isolated", 3: "conflict", 4: "skipped_dup", 5: "excluded", 6: "conflict"}


def test_free_names_meet_only_their_own(spark):
    w = spark.createDataFrame([("f", "call", ".md", i) for i in range(3)] + [("f", "call (2)", ".md", 9), ("g", "x", "", 1)], "folder string, stem string, suffix string, seq int")
    taken = spark.createDataFrame([("f", "call.md"), ("f", "call (3).md"), ("f", "callx.md"), ("f", "call (2) (2).md"), ("g", "x"), ("h", "call.md")], "folder string, name string")
    got = {r.seq: r.name for r in catalog.free_names(w, taken).where("folder = 'f'").collect()}
    assert [got[i] for i in range(3)] == ["call (2).md", "call (4).md", "call (5).md"]
    assert [r.name for r in catalog.free_names(w, taken).where("folder = 'g'").collect()] == ["x (2)"]


def test_judging(spark):
    rows = [("v", 1, 2, 0.125, "3", ["a", "b", "c", "d"]), ("v", 2, 4, 0.5, "4", None), ("v", 3, 3, None, "5", ["z"])]
    d = spark.createDataFrame(rows, "k string, run int, n int, s double, t string, e array<string>")
    r = evaluate.judged(d, ["k"], ["n"], ["s", "t"], ["e"]).collect()[0]
    assert (r.runs, r.n_median, r.n_min, r.n_max, r.s_mean, r.t_mean, r.e_examples) == (3, 3.0, 2.0, 4.0, 0.31, None, ["a", "b", "c"])
    g = spark.createDataFrame([([], 0.0), (["1"], 0.0), (None, 1.0), (None, None)], "f array<string>, h double").select(evaluate.gate_of(F.col("f"), F.col("h")).alias("g")).collect()
    assert [x.g for x in g] == [False, True, True, False]
    b = spark.createDataFrame([("c", i, "x" * (5 if i in (30, 40) else 1)) for i in range(60)], "call_id string, block_no int, text string")
    assert sorted(x.block_no for x in evaluate.excerpt(b).collect()) == list(range(8, 32))


def test_transcript_lines(spark, tmp_path):
    t = "---\nmodel: x\n---\n\n**P Q** [00:00]\none\n\n**broken** [0]\n**Q** [1:02:03] (interrupting)\n\ntwo\nmore\n\n"
    p = files.parsed_transcripts(spark.createDataFrame([(1, t), (2, None), (3, "plain")], "id int, text string"), "id")
    got = {r.id: (r.front, [tuple(x) for x in r.turns]) for r in p.collect()}
    assert got[1] == ("---\nmodel: x\n---", [("P Q", "00:00", "", "one\n\n**broken** [0]"), ("Q", "1:02:03", " (interrupting)", "two\nmore")]) and got[2] == ("", []) and got[3] == ("", [])
    bodies = lambda n: spark.createDataFrame([(1, [f"b{i}" for i in range(n)])], "id int, bodies array<string>")
    assert files.reassembled(p, bodies(2), "id").collect()[0].text == "---\nmodel: x\n---\n\n**P Q** [00:00]\nb0\n\n**Q** [1:02:03] (interrupting)\nb1\n"
    with pytest.raises(Exception, match="bodies 3 != blocks 2"):
        files.reassembled(p, bodies(3), "id").collect()
    (tmp_path / "r.json").write_text(json.dumps({"audio_duration_seconds": 9.5, "runs": {"a": {"label": "A", "elapsed_seconds": 1.5, "rating": 4}}}))
    assert [(r.id, r.label, r.rating, r.duration) for r in files.results(spark, str(tmp_path / "r.json")).collect()] == [("a", "A", 4, 9.5)]
    assert files.results(spark, str(tmp_path / "none.json")).collect() == []
    assert files.settings('A=1\n# x\nB = "two"\nA=3\n\nnonsense') == {"A": "1", "B": "two"}
    (tmp_path / "d").mkdir()
    for n in (".hidden", "b.mp3", "a.mp3"):
        (tmp_path / "d" / n).write_text("x")
    assert files.first_file(spark, str(tmp_path / "d")).collect()[0].path.endswith("/a.mp3")


def test_turns_in_many_partitions(small_batches):
    """Blocks and flags against a plain loop, over partitions and batches of a few rows."""
    import random

    rnd = random.Random(9)
    rows = []
    for call in ("a", "b", "c", "d"):
        for seq in range(rnd.choice([1, 9, 60])):
            start = rnd.randrange(60_000)
            rows.append((call, seq, "X" if call in "bd" else rnd.choice(["X", "Y", None]), start, start + rnd.choice([0, 500, 5000, 30_000]), f"t{seq}", rnd.choice([None, 1.0, 2.0])))
    rows += rnd.sample(rows, len(rows) // 4) + [(None, 1, "X", 1, 2, "x", 1.0), ("a", 900, "X", None, 2, "x", 1.0)]
    df = small_batches.createDataFrame(rows, "call_id string, seq long, speaker string, start_ms long, end_ms long, text string, energy double")
    got = {(r.call_id, r.block_no): tuple(r)[2:] for r in turns.turn_rows(df).collect()}
    want = {}
    for call in "abcd":
        own = sorted({(r[3], r[1]): r for r in rows if r[0] == call and r[3] is not None}.values(), key=lambda r: (r[3], r[1]))
        many, blocks = len({r[2] for r in own}) > 1, []
        for r in own:
            if not blocks or (r[2] != blocks[-1][0][2] if many else r[3] - max(x[4] for x in blocks[-1]) > 800):
                blocks.append([])
            blocks[-1].append(r)
        for i, b in enumerate(blocks):
            end = max(x[4] for x in b)
            energy = [x[6] for x in b if x[6] is not None]
            want[call, i + 1] = (b[0][2], b[0][3], end, max(energy) if energy else None, len(b), " ".join(x[5] for x in b), bool(i) and b[0][3] < max(x[4] for x in blocks[i - 1]))
    assert got == want
    assert turns.turn_rows(df.limit(0)).collect() == []


def test_player_and_events(spark, tmp_path):
    from confab.streaming import ingest

    rows = [("t", 1, " 3.50 M-A: 0"), ("t", 2, "noise"), ("t", 3, "10.25  A-V: 0"), ("u", 1, "x")]
    assert [(r.token, r.seconds) for r in ingest.playback_clock(spark.createDataFrame(rows, "token string, line_no int, line string")).collect()] == [("t", 10.25)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"at": 2, "id": "b"}\n{"at": 1, "id": "a"}\n')
    heard = []
    assert ingest.follow(ingest.tell(spark.readStream.schema("at long, id string").json(str(tmp_path / "in")), heard.append, str(tmp_path / "state")))
    assert [json.loads(h)["id"] for h in heard] == ["a", "b"]


def test_streams_are_stopped_and_failures_told(spark, tmp_path):
    from confab.streaming import ingest

    slow = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).start()
    assert ingest.follow(slow, lambda: True) is False and not slow.isActive

    def fail(batch, _):
        raise ValueError("no")

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"at": 2}\n')
    bad = spark.readStream.schema("at long").json(str(tmp_path / "in")).writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no"):
        ingest.follow(bad)
