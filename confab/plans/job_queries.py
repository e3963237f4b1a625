"""Queries of jobs, checkpoints, recognisers, evaluation and files, over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions import formats
from confab.functions.text import millis, utrim, zip_shorter
from confab.operators import catalog, commitlog, edits, evaluate, history, jobs, polish, recognise, rendering, turns
from confab.session import checkpoint_dir
from confab.sources import files
from confab.streaming import ingest

STATES = ("ready", "queued", "converting", "loading model", "transcribing", "polishing", "done", "error", "stopped")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return history.migrated(table(spark, folder, "transcriptions")).dropDuplicates(["id"])


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the history as jobs in all states and stages."""
    i, d = F.col("id"), F.col("audio_duration_seconds")
    share = F.when(i % 3 == 0, (i % 101) / 100.0)
    return _history(spark, folder).select(
        "id", "source_path", "model", "language", F.element_at(F.array(*map(F.lit, STATES)), (i % 9 + 1).cast("int")).alias("status"), F.when(i % 4 == 0, "track 1/2 - Eva").alias("status_detail"),
        F.when(i % 9 == 7, "boom").alias("error"), "output_path", (i % 2 == 0).alias("polish"), "audio_duration_seconds", F.when(i % 5 != 0, d * 0.35).alias("estimated_seconds"),
        F.when(i % 2 == 0, 8 + d * 0.05).alias("estimated_polish_seconds"), share.alias("transcribe_fraction"), share.alias("transcribe_position_fraction"), F.col("elapsed_seconds").alias("elapsed"), (i % 50).cast("double").alias("polish_elapsed"),
    )


def job_payload(spark: SparkSession, folder: str) -> DataFrame:
    j = _jobs(spark, folder)
    t = j.select("output_path").where("output_path is not null").distinct().withColumn("transcript", F.upper("output_path"))
    return jobs.payload(j, t)


def job_lines(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.lines(_jobs(spark, folder)).withColumn("bar", F.round("bar", 6))


def job_panel(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.panel(_jobs(spark, folder))


def job_buttons(spark: SparkSession, folder: str) -> DataFrame:
    does, can = jobs.button(F.col("status"))
    return _jobs(spark, folder).select("id", does.alias("does"), can.alias("can"), F.round(formats.polish_share("estimated_seconds", "estimated_polish_seconds", F.col("polish")), 6).alias("share"))


def job_reset(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.reset(_jobs(spark, folder)).select("id", "status", "model", "language", "error", "output_path", "elapsed", "transcribe_fraction", "polish")


def jobs_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.in_flight(_jobs(spark, folder))


def overall_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of a call whose tracks but the last are done, that one to a half."""
    t = catalog.named_tracks(table(spark, folder, "tracks"))
    n = t.groupBy("call_id").agg(F.max("position").alias("n"))
    return n.select("call_id", F.round(jobs.overall(F.col("n") - 1, F.lit(0.5), F.col("n")), 6).alias("done"))


def _checkpoint_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints of jobs as JSON; every eleventh is cut off, every thirteenth has no key."""
    i = F.col("id")
    full = F.concat(
        F.lit('{'), F.when(i % 13 != 0, F.concat(F.lit('"key":"k'), i.cast("string"), F.lit('",'))).otherwise(""), F.lit('"status":"'), F.when(i % 3 == 0, "running").when(i % 3 == 1, "paused").otherwise("done"),
        F.lit('","completed_units":["track1"],"partial_done_chunks":'), (i % 7).cast("string"), F.lit(',"started_at":"'), "started_at", F.lit('","config":{"source_path":"'), "source_path", F.lit('","model":"'), "model",
        F.lit('","track_names":{"1":"Eva"}}}'),
    )
    return _history(spark, folder).select(F.when(i % 11 == 0, F.substring(full, 1, 40)).otherwise(full).alias("value"))


def checkpoint_load(spark: SparkSession, folder: str) -> DataFrame:
    c = jobs.checkpoints(_checkpoint_texts(spark, folder))
    return c.select("key", "status", "phase", "version", F.array_join("completed_units", ",").alias("units"), "partial_unit", "partial_done_chunks", F.col("config.source_path").alias("source"))


def resumed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs to go on with; recordings whose path has an odd length are gone."""
    there = _history(spark, folder).where(F.char_length("source_path") % 2 == 0).select(F.col("source_path").alias("path"))
    return jobs.resumed(jobs.checkpoints(_checkpoint_texts(spark, folder)), there).select("key", "status", "go", "started_at")


def config_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations written as JSON and read back."""
    j = _history(spark, folder).select("id", "source_path", "model", "language", (F.col("id") % 2 == 0).alias("polish"), F.array(F.lit(3), F.lit(1)).alias("selected_track_indices"), F.when(F.col("id") % 3 == 0, F.create_map(F.lit(2), F.col("model"))).alias("track_names"))
    c = jobs.parsed_config(jobs.config_json(j))
    return c.select("id", "source_path", "model", "language", "polish", F.array_join("selected_track_indices", ",").alias("selected"), F.try_element_at("track_names", F.lit(2)).alias("name"), F.col("track_subtractions").isNull().alias("none"))


def settings_shown(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    q = h.groupBy("model").agg(F.min("id").alias("n")).select("model", F.when(F.col("n") % 3 == 0, "Cloud").when(F.col("n") % 3 == 1, "Fast").otherwise("Slow").alias("quality"))
    s = h.select("id", F.when(F.col("id") % 4 != 0, F.col("model")).alias("model"), F.when(F.col("id") % 2 == 0, F.lit(False)).alias("polish"), "language")
    return jobs.settings_view(s, q, "none", "cs")


def jobs_analysed(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with a duration found for every third, and twins for every fourth."""
    h = _history(spark, folder)
    lengths = h.where("id % 3 = 0").select("id", (F.col("id") * 1.5).alias("audio_duration_seconds"))
    twins = h.where("id % 4 = 0").select("id", F.lit(2).alias("twin"))
    return jobs.analysed(h.select("id", "model", "audio_duration_seconds"), lengths, twins)


def recent_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Of the latest runs the good ones whose transcript is there; those of every third run are gone."""
    h = _history(spark, folder)
    return history.recent(h, 60, h.where("id % 3 <> 0").select(F.col("output_path").alias("path"))).select("id", "output_path")


# ---- tracks, options ----


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.named_tracks(table(spark, folder, "tracks"))


def chosen_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """First tracks of calls with several; a call with one track has no selection that fits."""
    t = _named(spark, folder)
    return catalog.chosen(t, t.where("several and position = 1")).select("call_id", "idx")


def needed_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Second tracks, and what they refer to."""
    t = _named(spark, folder)
    return catalog.needed(t.where("position = 2"), t.where("position < 4").select("call_id", "idx", F.array(F.col("idx") + 10).alias("subtract")))


def track_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names by an override, where there is one, and languages by a map; labels of unknown ones are themselves."""
    t = _named(spark, folder).where("idx is not null")
    own = F.create_map(F.lit(1), F.lit("Host"), F.lit(2), F.lit(""))
    labels = t.select(F.col("name").alias("id")).where("id like 'Speaker %'").distinct().withColumn("label", F.upper("id"))
    out = catalog.labelled(t.withColumn("named", catalog.override(own, F.col("idx"), F.col("name"))), labels, "named", "label")
    changed = catalog.put(F.create_map(F.lit(1), F.lit("cs")), F.col("idx"), F.when(F.col("position") == 1, "auto").otherwise("de"), F.lit("auto"))
    asked = catalog.request_options(F.create_map(F.col("idx").cast("string"), F.when(F.col("position") > 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    return out.select("call_id", "idx", "named", "label", F.array_join(F.array_sort(F.transform(F.map_entries(changed), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))), ",").alias("languages"), F.size(F.coalesce(F.map_keys(asked), F.array().cast("array<int>"))).alias("asked"))


def recent_names(spark: SparkSession, folder: str) -> DataFrame:
    t = _named(spark, folder)
    recent = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("Name "), i.cast("string")))
    return t.select("call_id", "idx", F.array_join(catalog.remember(recent, F.col("name")), "|").alias("names"))


# ---- recognisers ----


def _units(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    return h.select(F.col("id").cast("string").alias("key"), F.lit("mp3").alias("unit"), F.col("source_path").alias("path"), "model", "language")


def recogniser_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 28 s of each recording for the recognisers that take chunks, of which the first id % 3 are done."""
    h = _history(spark, folder).where("audio_duration_seconds > 0 and audio_duration_seconds < 2000")
    c = h.select(F.col("id").cast("string").alias("key"), F.lit("mp3").alias("unit"), "audio_duration_seconds", F.explode(F.sequence(F.lit(0), F.floor(F.col("audio_duration_seconds") / 28).cast("int"))).alias("n"))
    c = c.select("key", "unit", (F.col("n") * 28.0).alias("start"), F.least(F.col("n") * 28.0 + 28, F.col("audio_duration_seconds")).alias("end"))
    done = h.select(F.col("id").cast("string").alias("key"), F.lit("mp3").alias("unit"), (F.col("id") % 3).cast("int").alias("chunks"))
    return recognise.chunk_tasks(_units(spark, folder), c, done).select("key", "family", "chunk", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _echoing():
    """A recogniser for tests: says its path's length and the chunk, fails on paths whose length is a multiple of 10."""
    return lambda path, language, start, end: [(0.5, 1.5, f" {len(path)} ")] if len(path) % 10 else [][0]


def recognised_texts(spark: SparkSession, folder: str) -> DataFrame:
    tasks = recognise.chunk_tasks(_units(spark, folder))
    return recognise.recognised(tasks, dict.fromkeys(("whisper", "parakeet", "groq", "elevenlabs"), _echoing)).select("key", "chunk", "start", "end", "text", (F.col("error").isNotNull()).alias("failed"))


def benchmark_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Back ends whose id holds an a, on each language's first recording."""
    h = _history(spark, folder)
    configs = h.select(F.col("model").alias("id"), F.lit("whisper").alias("backend"), F.lit(None).cast("string").alias("language")).distinct()
    tracks = h.groupBy(F.coalesce("language", F.lit("auto")).alias("track")).agg(F.min("source_path").alias("path"))
    return recognise.benchmark(configs, tracks, {"whisper": _echoing}, "a").select("id", "track", "text", F.col("error").isNotNull().alias("failed"))


def speech_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Segments as chunks of speech of which the first 40 of each call are done."""
    s = table(spark, folder, "segments").where("end > start").select(F.col("call_id").alias("key"), F.lit("u").alias("unit"), F.col("seq").alias("chunk"), millis("start").alias("start"), millis("end").alias("end")).distinct()
    d = recognise.speech_done(s, s.select("key", "unit").distinct().withColumn("chunks", F.lit(40)))
    return d.select("key", F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), F.round("fraction", 6).alias("fraction"))


def track_union(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the labels of each call, those of labels of even length first."""
    s = table(spark, folder, "segments").select("call_id", "seq", "speaker").distinct()
    even = F.coalesce(F.char_length("speaker") % 2 == 0, F.lit(False))
    return recognise.labelled_union([s.where(even), s.where(~even)]).select("call_id", "seq", "speaker", "track_no")


def unit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Committed rows of one label."""
    log = table(spark, folder, "segments").select(F.col("call_id").alias("key"), F.lower("speaker").alias("unit"), F.floor(millis("start") / 30000).cast("int").alias("chunk"), "seq").distinct()
    points = log.select("key").distinct().select("key", F.array(F.lit("track1")).alias("completed_units"), F.lit("track2").alias("partial_unit"), F.lit(3).alias("partial_done_chunks"))
    return commitlog.unit_rows(log, points, "track2")


# ---- evaluation, texts ----


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "blocks").groupBy("call_id", "block_no").agg(F.min("text").alias("raw"))
    n = b.select(F.col("call_id").alias("_c"), (F.col("block_no") - 1).alias("_n"), F.col("raw").alias("edited"))
    return b.join(n, (F.col("call_id") == F.col("_c")) & (F.col("block_no") == F.col("_n"))).drop("_c", "_n")


def judge_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Run times as counts and lengths as scores, per model; a text column has no numbers."""
    h = _history(spark, folder).withColumn("words", F.split("source_path", "/"))
    j = evaluate.judged(h, ["model"], ["elapsed_seconds"], ["audio_duration_seconds", "language"], ["words"], order="id")
    return j.withColumn("words_examples", F.array_join("words_examples", "|"))


def fastest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The fastest run of each model as cards, failed ones marked."""
    h = _history(spark, folder)
    runs = h.groupBy(F.col("model").alias("id")).agg(F.min("elapsed_seconds").alias("elapsed"), F.when(F.count_if(F.col("status") == "success") % 2 == 0, "failed").alias("error"))
    return evaluate.fastest_first(runs).select("id", "place", "fastest")


def score_table(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a score card, in order of how often a model succeeds."""
    h = _history(spark, folder)
    v = h.groupBy(F.col("model").alias("name")).agg(F.round(F.avg((F.col("status") == "success").cast("double")), 6).alias("good")).withColumns({"seq": F.col("name"), "one": F.lit(1)})
    r = evaluate.ranked(v, ["one"], F.col("good") < 0.5, "good", evaluate.quality("good", "good"))
    return evaluate.scorecard(r).select(F.col("place").cast("int").alias("place"), "line")


def first_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The first run of each model and language."""
    return evaluate.keep_first(_history(spark, folder).select("model", "language", "id", "source_path"), ["model", "language"], "id")


def call_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "blocks").groupBy("call_id", "block_no").agg(F.min("text").alias("text"))
    return evaluate.excerpt(b).select("call_id", "block_no")


def judge_payload(spark: SparkSession, folder: str) -> DataFrame:
    return edits.judge_payload(_pairs(spark, folder), "call_id")


def failed_edits(spark: SparkSession, folder: str) -> DataFrame:
    return edits.looks_failed(_pairs(spark, folder).withColumn("edited", F.when(F.col("block_no") % 50 == 0, F.col("raw")).otherwise(F.col("edited"))), "call_id")


def candidate_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Models as candidates for each language."""
    h = _history(spark, folder).groupBy(F.coalesce("language", F.lit("auto")).alias("track"), F.col("model").alias("config")).agg(F.min("source_path").alias("text"), F.count(F.lit(1)).cast("string").alias("note"))
    return evaluate.judge_bundle(h)


def quality_figures(spark: SparkSession, folder: str) -> DataFrame:
    d = edits.quality_metrics(table(spark, folder, "documents").select("doc_id", "text"))
    return d.select("doc_id", "chars", "words", "repeat_5gram", F.array_join("hits", "|").alias("hits"))


def plain_transcript(spark: SparkSession, folder: str) -> DataFrame:
    """Each label of a call as a recording of its own."""
    s = table(spark, folder, "segments").select(F.concat_ws("/", "call_id", F.coalesce("speaker", F.lit(""))).alias("call_id"), "seq", millis("start").alias("start_ms"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return files.plain_text(s)


def transcripts_again(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks written as transcripts, read line by line and put together with the same bodies: the same text again."""
    b = table(spark, folder, "blocks").groupBy("call_id", "block_no").agg(F.min(F.regexp_replace("text", r"(?U)[\s*]+", " ")).alias("text"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: F.concat(F.lit("**S"), (x["block_no"] % 3).cast("string"), F.lit("** [00:01]\n"), F.trim(x["t"])))
    docs = b.groupBy("call_id").agg(F.concat(F.lit("---\nmodel: x\n---\n\n"), F.array_join(body, "\n\n"), F.lit("\n")).alias("text"))
    parsed = files.parsed_transcripts(docs, "call_id")
    again = files.reassembled(parsed, parsed.select("call_id", F.transform("turns", lambda t: t["body"]).alias("bodies")), "call_id")
    return again.select("call_id", F.regexp_replace("text", r"\s+$", "").alias("text"))


def runs_with_texts(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    runs = h.select("id", F.when(F.col("id") % 3 != 0, F.col("output_path")).alias("transcript_file"))
    texts = h.where("id % 2 = 0 and output_path is not null").groupBy(F.col("output_path").alias("file")).agg(F.min("model").alias("text"))
    return files.with_transcripts(runs, texts).select("id", "transcript_text")


def middle_clips(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select("id", files.middle(F.col("audio_duration_seconds"), 420.0).alias("start"), _analysis("audio_duration_seconds").alias("analysis"))


def _analysis(c: str) -> Column:
    from confab.operators import signals

    return signals.analysis_start(F.col(c))


def turn_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks as JSON and back."""
    b = turns.turn_rows(turns.spoken_segments(table(spark, folder, "segments")))
    j = turns.turn_json(b)
    back = F.from_json("turn", "struct<speaker:string,start:long,end:long,interrupting:boolean,text:string>")
    return j.select("call_id", "block_no", back["speaker"].alias("speaker"), back["start"].alias("start_ms"), back["interrupting"].alias("interrupting"))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of turns, texts trimmed."""
    return turns.merge_turns(turns.spoken_segments(table(spark, folder, "segments"))).select("call_id", "block_no", utrim("text").alias("text"))


def _exclaim(request: str) -> str | None:
    """A model for tests: every text with an exclamation mark."""
    return json.dumps([t + "!" for t in json.loads(request)]) if request.startswith("[") else request + "!"


def polished_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return polish.polish_blocks(_numbered(spark, folder), _exclaim)


def cleaned_alone(spark: SparkSession, folder: str) -> DataFrame:
    return polish.cleaned(_numbered(spark, folder).withColumn("text", F.regexp_replace("text", "[\\[`]", "")), "isolated", _exclaim)


def cleaned_batches(spark: SparkSession, folder: str) -> DataFrame:
    return polish.cleaned(_numbered(spark, folder), "batch_small", _exclaim)


def voted_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the next block's text proposed by two of three, which is then agreed."""
    p = _pairs(spark, folder)
    return p.select("call_id", "block_no", edits.ensemble()("raw", F.array("edited", "raw", "edited")).alias("text"))


def packed_chars(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks packed by characters: which pack each is in."""
    p = polish.packs(_numbered(spark, folder), max_chars=1500)
    return p.select("call_id", F.col("pack").cast("long").alias("pack"), F.explode("blocks").alias("b")).select("call_id", "pack", "b.block_no")


def transcripts_written(spark: SparkSession, folder: str) -> DataFrame:
    """Files of runs: those with an even id were cleaned and have a raw text too."""
    h = _history(spark, folder).where("source_path is not null")
    r = h.select("id", F.regexp_extract("source_path", r"^(.*)/", 1).alias("folder"), "source_path", "model", "language", F.col("started_at").alias("at"), F.col("elapsed_seconds").alias("elapsed"), F.lit(2).alias("speakers"), F.lit(None).cast("string").alias("diarization"), F.lit("said").alias("text"), F.when(F.col("id") % 2 == 0, "raw").alias("raw"))
    f = catalog.transcript_files(r, r.limit(0).select("folder", F.col("text").alias("name")))
    return f.select("id", F.endswith("name", F.lit(".raw.md")).alias("raw"), "text")


def requested_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs changed by requests: names for every second, speakers for every third, subtractions for every fifth, empty ones for the tenth."""
    i, n = F.col("id"), F.col("id").cast("string")
    text_map, lists = "map<string,string>", "map<string,array<int>>"
    h = _history(spark, folder)
    j = h.select("id", F.create_map(F.lit(1), "model").alias("track_names"), F.array(F.lit(7)).alias("selected_track_indices"), F.create_map(F.lit(1), F.array(F.lit(2))).alias("track_subtractions"))
    o = h.select("id", F.when(i % 2 == 0, F.create_map(F.lit("2"), n)).otherwise(F.create_map().cast(text_map)).alias("names"), F.when(i % 3 == 0, F.array(F.lit(3), F.lit(1), F.lit(3))).alias("speakers"), F.when(i % 10 == 0, F.create_map(F.lit("4"), F.array().cast("array<int>"))).when(i % 5 == 0, F.create_map(F.lit("4"), F.array(F.lit(5)))).cast(lists).alias("subtractions"))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return catalog.asked_for(j, o).select("id", flat("track_names"), F.array_join("selected_track_indices", ",").alias("speakers"), flat("track_subtractions"))


def effective_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of tracks by override, default and number; and of one that is not there."""
    t = _named(spark, folder)
    own = t.groupBy("call_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "name")))).alias("names"))
    asked = t.select("call_id", "idx").union(own.select("call_id", F.lit(99)))
    return asked.join(own, "call_id").select("call_id", "idx", catalog.effective_name(F.create_map(F.lit(1), F.lit("Host"), F.lit(2), F.lit("")), F.col("names"), F.col("idx")).alias("name"))


def zipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of segments and their labels side by side, one text fewer than labels."""
    s = table(spark, folder, "segments").select("call_id", "seq", "speaker").distinct()
    g = s.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seq", "speaker"))).alias("p"))
    z = zip_shorter(F.transform("p", lambda x: x["seq"]), F.slice(F.transform("p", lambda x: x["speaker"]), 1, F.size("p") - 1))
    return g.where(F.size("p") > 1).select("call_id", F.explode(z).alias("z")).select("call_id", F.col("z.a").alias("seq"), F.col("z.b").alias("speaker"))


def streamed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Segments written as chunk files, streamed, committed once and read back."""
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    s = table(spark, folder, "segments").select(F.col("call_id").alias("key"), F.col("seq").alias("line_no"), F.lower("speaker").alias("unit"), F.floor(millis("start") / 30000).cast("int").alias("chunk"), "start", "end", "text", "speaker").distinct()
    s.write.json(f"{place}/in")
    ingest.follow(ingest.commit(ingest.chunk_stream(spark, f"{place}/in"), f"{place}/log", f"{place}/state"))
    return ingest.read_log(spark, f"{place}/log").select("key", "unit", "chunk", "line_no", F.round("start", 3).alias("start"))


def live_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Spoken stretches per call and label by session windows, in a batch: pauses of up to a second."""
    s = table(spark, folder, "segments").where("start is not null").select(F.col("call_id").alias("key"), F.coalesce("speaker", F.lit("")).alias("speaker"), "seq", "start", "end").distinct()
    s = s.withColumn("at", F.timestamp_millis(millis("start")))
    return ingest.live_turns(s).select("key", "speaker", "segments", millis("start").alias("start_ms"))


# ---- sources and sinks ----


def probed_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks as probes in JSON, a video stream in front; every sixth call's is cut off."""
    t = table(spark, folder, "tracks").select("call_id", "idx", "channels", "title").distinct()
    audio = F.concat(F.lit('{"index":'), F.col("idx").cast("string"), F.lit(',"codec_type":"audio","channels":'), F.col("channels").cast("string"), F.lit(',"tags":'), F.to_json(F.struct(F.concat(F.lit(" "), "title").alias("title"))), F.lit("}"))
    j = t.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list(audio)), ",").alias("s"))
    full = F.concat(F.lit('{"streams":[{"index":77,"codec_type":"video"},'), "s", F.lit('],"format":{"duration":"12.5"}}'))
    m = j.select("call_id", F.when(F.char_length("s") % 6 == 0, F.substring(full, 1, 60)).otherwise(full).alias("json"))
    return files.streams(m).select("call_id", "idx", "channels", "title", "duration")


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    return files.dropped(_history(spark, folder).select("id", F.when(F.col("id") % 2 == 0, F.upper("source_path")).when(F.col("id") % 5 == 0, F.concat("source_path", F.lit(".txt"))).otherwise(F.col("source_path")).alias("path")))


def wav_again(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as WAV bytes of 16 bits and as samples again: number and sum of the whole numbers written."""
    v = table(spark, folder, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("x"))
    back = v.select("vec_id", files.wav_samples(rendering.wav(16000)("x")).alias("y"), files.wav_stretch(0.001, 0.002)(rendering.wav(16000)("x")).alias("part"))
    return back.select("vec_id", F.size("y").alias("n"), F.aggregate("y", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 32768).cast("long")).alias("total"), F.size("part").alias("part"))


def playback_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a player, made of the history; the last with a position counts."""
    h = _history(spark, folder)
    line = F.when(F.col("id") % 3 == 0, F.lit("nothing")).otherwise(F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(".25 "), F.when(F.col("id") % 2 == 0, "M-A").otherwise("A-V"), F.lit(": 0.000 fd=0")))
    return ingest.playback_clock(h.select(F.col("model").alias("token"), F.col("id").alias("line_no"), line.alias("line")))


def track_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The set of a call's tracks without the first, with one more, and where the last stands among all."""
    t = table(spark, folder, "tracks").where("idx is not null").select("call_id", "idx").distinct().groupBy("call_id").agg(F.array_sort(F.collect_set("idx")).alias("all"))
    first, last = F.element_at("all", 1), F.element_at("all", -1)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.select("call_id", text(catalog.include(F.col("all"), first, F.lit(False))).alias("less"), text(catalog.include(F.col("all"), F.lit(50), F.lit(True))).alias("more"), catalog.place_of(F.col("all"), last).cast("int").alias("place"), catalog.place_of(F.col("all"), F.lit(51)).cast("int").alias("none"))


def reply_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects and arrays in replies with words around them; every seventh is cut off, and so is every array of another length."""
    i = F.col("id").cast("string")
    r = _history(spark, folder).select("id", F.when(F.col("id") % 7 == 0, '{"a": ').otherwise(F.concat(F.lit('Sure: {"a": '), i, F.lit("} done"))).alias("o"), F.concat(F.lit('Here ["x", '), i, F.when(F.col("id") % 4 == 0, ', "z"').otherwise(""), F.lit("]")).alias("l"))
    a = F.pandas_udf(lambda s: s.map(lambda t: str((polish.parse_object(t) or {}).get("a", ""))), "string")
    n = F.pandas_udf(lambda s: s.map(lambda t: "|".join(polish.parse_array(t, 2) or ["none"])), "string")
    return r.select("id", a("o").alias("a"), n("l").alias("parts"))


def runs_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark rows of models, of which every second is run again, every third with an error, and new ones come in."""
    h = _history(spark, folder).groupBy(F.col("model").alias("id")).agg(F.min("id").alias("n"), F.count(F.lit(1)).cast("double").alias("seconds"))
    old = h.where("n % 5 <> 0").select("id", "seconds", F.lit(None).cast("string").alias("error"), F.lit(4).alias("rating"), F.lit("good").alias("notes"))
    new = h.where("n % 2 = 0 or n % 5 = 0").select("id", F.when(F.col("n") % 3 != 0, F.col("seconds") * 2).alias("seconds"), F.when(F.col("n") % 3 == 0, "boom").alias("error"), F.lit(None).cast("int").alias("rating"), F.lit("").alias("notes"))
    return evaluate.upsert_runs(old, new)


def log_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The committed rows of a log, written to a new place and read from there."""
    log = table(spark, folder, "segments").select(F.col("call_id").alias("key"), F.lower("speaker").alias("unit"), F.floor(millis("start") / 30000).cast("int").alias("chunk"), "seq").distinct()
    points = log.select("key").distinct().select("key", F.array(F.lit("track1")).alias("completed_units"), F.lit("track2").alias("partial_unit"), F.lit(3).alias("partial_done_chunks"))
    place = f"{checkpoint_dir(spark)}/log-{uuid.uuid4()}"
    commitlog.compact(log, points, place)
    return spark.read.parquet(place)


def history_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Runs appended to a history in two goes, of which the first lacks columns of today."""
    h, place = _history(spark, folder), f"{checkpoint_dir(spark)}/history-{uuid.uuid4()}"
    history.record(h.where("id % 2 = 0").drop("turns_json"), place)
    history.record(h.where("id % 2 = 1"), place)
    return spark.read.parquet(place).select("id", "model", "status", F.col("turns_json").isNotNull().alias("turns"))


QUERIES = {
    f.__name__: f
    for f in (
        job_payload, job_lines, job_panel, job_buttons, job_reset, jobs_in_flight, overall_progress, checkpoint_load, resumed_jobs, config_round_trip, settings_shown, jobs_analysed, recent_calls, chosen_tracks, needed_tracks, track_labels, recent_names,
        recogniser_tasks, recognised_texts, benchmark_cells, speech_progress, track_union, unit_log, judge_rounds, fastest_runs, score_table, first_configs, call_excerpt, judge_payload, failed_edits, candidate_bundle,
        quality_figures, plain_transcript, transcripts_again, runs_with_texts, middle_clips, turn_objects, polished_blocks, cleaned_alone, cleaned_batches, voted_edits, packed_chars, transcripts_written, requested_jobs, effective_names, zipped_texts, streamed_log, live_stretches, probed_streams, dropped_files, wav_again, playback_clocks, track_sets, reply_objects, runs_upserted, log_compacted, history_recorded,
    )
}
