"""Queries of the general operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions import formats
from confab.functions.text import is_blank, match_key, millis, utrim
from confab.plans import job_queries
from confab.session import checkpointed, spread
from confab.operators import bleed, catalog, commitlog, echo, edits, evaluate, history, intervals, separation, signals, turns, words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A longer silence is a break in the recording.
LONGEST_GAP_MS = 1_800_000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods of speech of each call and the gaps between them."""
    s = table(spark, folder, "segments").where(~is_blank("text") & (F.col("end") > F.col("start")))
    s = s.select("call_id", millis("start").alias("start_ms"), millis("end").alias("end_ms"))
    out = intervals.periods_and_gaps(s, "call_id", "start_ms", "end_ms", LONGEST_GAP_MS)
    return out.select("call_id", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def p1_interrupting(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the stored flag and the one that their times give."""
    b = table(spark, folder, "blocks").select("call_id", "block_no", millis("start").alias("start_ms"), millis("end").alias("end_ms"), F.col("interrupting").alias("stored"))
    b = b.groupBy("call_id", "block_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("stored").alias("stored"))
    return turns.flag_interruptions(b).select("call_id", "block_no", "stored", "interrupting")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return turns.spoken_segments(table(spark, folder, "segments"))


def turn_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return turns.merge_turns(_segments(spark, folder))


def turn_interruptions(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turn_rows(_segments(spark, folder)).select("call_id", "block_no", "speaker", "start_ms", "end_ms", "interrupting")


def pause_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each label of a call as a recording of its own: blocks end at pauses."""
    s = _segments(spark, folder).withColumn("call_id", F.concat_ws("/", "call_id", "speaker"))
    return turns.merge_turns(s).select("call_id", "block_no", "start_ms", "end_ms", "segments")


def turn_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return turns.markdown(turns.turn_rows(_segments(spark, folder)))


def lane_payload(spark: SparkSession, folder: str) -> DataFrame:
    return turns.lanes(turn_blocks(spark, folder)).select("call_id", "block_no", "speaker", "lane")


def batch5(spark: SparkSession, folder: str) -> DataFrame:
    return turns.batches(turn_blocks(spark, folder)).select("call_id", "batch", F.size("texts").alias("n"), F.array_join("texts", "|").alias("texts"))


def context_window(spark: SparkSession, folder: str) -> DataFrame:
    c = turns.context(turn_blocks(spark, folder))
    return c.select("call_id", "block_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def region_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Periods of speech packed for a recogniser: chunks of up to 28 s across gaps of up to 1 s."""
    periods = p1_found(spark, folder).where("kind = 'period'").select("call_id", "start_ms", "end_ms")
    return turns.pack_regions(periods, 28_000, 1_000)


def line_pack(spark: SparkSession, folder: str) -> DataFrame:
    return turns.pack_lines(table(spark, folder, "documents"), "doc_id", limit=1600)


def echo_candidates(spark: SparkSession, folder: str) -> DataFrame:
    c = echo.candidates(turn_blocks(spark, folder))
    return c.select("call_id", F.col("a_block_no").alias("a_no"), F.col("b_block_no").alias("b_no"), echo.loser_is_a().alias("a_loses"))


def echo_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks without echoes, flags computed again."""
    return turns.flag_interruptions(echo.drop_echoes(checkpointed(turn_blocks(spark, folder)))).select("call_id", "block_no", "speaker", "start_ms", "end_ms", "interrupting")


# ---- words ----


def _worded(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that have words, each once."""
    s = table(spark, folder, "segments").where(F.size("words") > 0)
    return s.select(F.col("call_id").alias("key"), "seq", "start", "end", "text", "words").dropDuplicates(["key", "seq"])


#: Words are ordered by their segment and their place in it, however many it has.
_ORDER = ("seq", "pos")


def _words(spark: SparkSession, folder: str) -> DataFrame:
    w = _worded(spark, folder).select("key", "seq", F.posexplode("words").alias("pos", "w"))
    return w.select("key", "seq", F.col("pos").cast("long").alias("pos"), millis("w.start").alias("start_ms"), millis("w.end").alias("end_ms"), utrim("w.text").alias("text"), F.coalesce("w.lead_space", F.lit(True)).alias("lead_space"))


def _token_no() -> Column:
    """One number for a token (two a word), by segment and place; up to 1,000,000 words a segment it is unique."""
    return (F.col("seq") * 2_000_000 + F.col("pos")).alias("seq")


def spacing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words again from a stream of word and spacing tokens made of them."""
    w = _words(spark, folder)
    word = w.select("key", "seq", (F.col("pos") * 2 + 1).alias("pos"), F.lit("word").alias("type"), "text", "start_ms", "end_ms")
    space = w.select("key", "seq", (F.col("pos") * 2).alias("pos"), F.lit("spacing").alias("type"), F.when(F.col("lead_space"), " ").otherwise("").alias("text"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    return words.spaced_words(word.unionByName(space), _ORDER, words.SEGMENTS).select("key", _token_no(), "text", "start_ms", "end_ms", "lead_space")


def word_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return words.coalesce_words(_words(spark, folder), order=_ORDER, width=words.SEGMENTS)


def token_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words again from sub-word tokens of two characters and the rest."""
    w = _words(spark, folder).where(F.char_length("text") > 0)
    head = w.select("key", "seq", (F.col("pos") * 2).alias("pos"), F.concat(F.lit(" "), F.substring("text", 1, 2)).alias("text"), "start_ms", "end_ms")
    tail = w.where(F.char_length("text") > 2).select("key", "seq", (F.col("pos") * 2 + 1).alias("pos"), F.substr("text", F.lit(3)).alias("text"), "start_ms", "end_ms")
    return words.token_words(head.unionByName(tail), _ORDER, words.SEGMENTS).select("key", _token_no(), "text", "start_ms", "end_ms")


def word_bucket(spark: SparkSession, folder: str) -> DataFrame:
    from confab.operators.ordered import with_order

    numbered = with_order(_words(spark, folder).withColumn("one", F.lit(1).cast("long")), "key", [*_ORDER], words.SEGMENTS, total={"n": "one"})
    own = words.bucket_words(_worded(spark, folder), numbered.withColumn("word_no", F.col("n") - 1))
    return own.select("key", "seq", F.array_join("words", " ").alias("words"))


def segment_times(spark: SparkSession, folder: str) -> DataFrame:
    s = _worded(spark, folder)
    a, z = words.word_times(F.col("words"), F.col("start"), F.col("end"))
    moved = words.offset_words(F.col("words"), F.lit(10.0))
    return s.select("key", "seq", a.alias("first"), z.alias("last"), F.element_at(moved, 1)["start"].alias("moved"))


def realign(spark: SparkSession, folder: str) -> DataFrame:
    """Words of segments against their normalised text."""
    s = _worded(spark, folder)
    return s.select("key", "seq", F.explode(words.realign("words", match_key("text"))).alias("w")).select("key", "seq", "w.*")


# ---- history ----


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return history.migrated(table(spark, folder, "transcriptions")).dropDuplicates(["id"])


def eta_by_model_language(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    asked = h.select("model", "language").distinct().withColumn("duration", F.lit(600.0)).withColumn("tracks", F.lit(2))
    return history.estimate(asked, h).select("model", "language", F.round("seconds", 4).alias("seconds"))


def history_latest200(spark: SparkSession, folder: str) -> DataFrame:
    return history.grid(history.latest(_history(spark, folder), 200))


def recent_success60(spark: SparkSession, folder: str) -> DataFrame:
    return history.recent(_history(spark, folder)).select("id", "model", "output_path")


def latest_turns(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_turns(_history(spark, folder))


def stored_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Number of turns in each stored JSON; null where it is cut off."""
    h = _history(spark, folder).where("turns_json is not null")
    return h.select("id", F.size(history.parsed_turns("turns_json")).alias("turns")).withColumn("turns", F.when(F.col("turns") >= 0, F.col("turns")))


def resumable_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return history.resumable(_history(spark, folder), ("stopped", "error")).select("id", "status", "started_at")


def committed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Segments as a log: labels of even length are finished, the first label is in work, five chunks of it done."""
    log = table(spark, folder, "segments").select(F.col("call_id").alias("key"), F.lower("speaker").alias("unit"), F.floor(millis("start") / 30000).cast("int").alias("chunk"), "seq").distinct()
    points = log.groupBy("key").agg(F.collect_set(F.when(F.char_length("unit") % 2 == 0, F.col("unit"))).alias("completed_units"), F.min("unit").alias("partial_unit"), F.lit(5).alias("partial_done_chunks"))
    return commitlog.committed(log, points)


def format_all(spark: SparkSession, folder: str) -> DataFrame:
    h, e, d = _history(spark, folder), F.col("elapsed_seconds"), F.col("audio_duration_seconds")
    return h.select(
        "id", formats.timestamp(e).alias("stamp"), formats.elapsed(e).alias("spent"), formats.timecode(d).alias("code"), formats.minutes_left(e).alias("left"), formats.duration(d).alias("length"),
        formats.month_day("started_at").alias("day"), F.round(formats.polish_seconds(d), 6).alias("polish"),
    )


# ---- evaluation ----


def bench_metrics(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    return evaluate.metrics(h, "audio_duration_seconds", "elapsed_seconds").select("id", (F.col("rtf").isNull()).alias("no_rtf"), "rtf", "speedup")


def judge_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Run times as counts, audio lengths as scores, per model."""
    return evaluate.judged(_history(spark, folder), ["model"], ["elapsed_seconds"], ["audio_duration_seconds"])


def gated_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Models per language by how often they succeed; gated if one run in ten is an error."""
    h = _history(spark, folder).withColumn("language", F.coalesce("language", F.lit("auto")))
    v = h.groupBy("language", F.col("model").alias("name")).agg(F.avg((F.col("status") == "success").cast("double")).alias("good"), F.avg((F.col("status") == "error").cast("double")).alias("bad"))
    r = evaluate.ranked(v.withColumn("seq", F.col("name")), ["language"], F.col("bad") > 0.1, "good", evaluate.quality("good", 1 - F.col("bad")))
    return r.select("language", "name", "gated", "place", F.round("quality", 6).alias("quality"))


def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The language most runs of one recording were made with."""
    return edits.vote(_history(spark, folder), ["source_path"], "language", "id")


def rating_upsert(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    runs = h.select(F.col("model").alias("id"), F.lit(None).cast("int").alias("rating"), F.lit("").alias("notes")).distinct()
    given = h.select(F.col("model").alias("id"), (F.col("id") % 7).cast("int").alias("rating"), F.col("language").alias("notes"), F.col("id").alias("seq"))
    return evaluate.rate(runs, given)


# ---- edited texts ----


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each block's text and, as if it were its edit, that of the next block."""
    b = table(spark, folder, "blocks").groupBy("call_id", "block_no").agg(F.min("text").alias("raw"))
    n = b.select(F.col("call_id").alias("_c"), (F.col("block_no") - 1).alias("_n"), F.col("raw").alias("edited"))
    return b.join(n, (F.col("call_id") == F.col("_c")) & (F.col("block_no") == F.col("_n"))).drop("_c", "_n")


def norm_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").select("call_id", "block_no", match_key("text").alias("norm")).distinct()


def fold_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").select("call_id", "block_no", "text").distinct().select("call_id", "block_no", edits.fold("text").alias("folded"))


def containment_accept(spark: SparkSession, folder: str) -> DataFrame:
    return edits.accept(_pairs(spark, folder)).select("call_id", "block_no", (F.col("accepted") == F.col("raw")).alias("kept"), "accepted")


def drift_metrics(spark: SparkSession, folder: str) -> DataFrame:
    d = edits.drift(_pairs(spark, folder))
    return d.select("call_id", "block_no", F.round("length_ratio", 6).alias("length_ratio"), F.round("retention", 6).alias("retention"), F.array_join("novel_words", " ").alias("novel_words"), F.array_join("novel_numbers", " ").alias("novel_numbers"))


def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    return edits.drift_report(_pairs(spark, folder), "call_id")


def repetition_5gram(spark: SparkSession, folder: str) -> DataFrame:
    n, share = edits.repetition(F.col("text"))
    return spread(table(spark, folder, "documents").select("doc_id", "text").where("text is not null")).select("doc_id", n.alias("words"), F.round(share, 6).alias("repeated"))


def phrase_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.array_join(edits.phrase_hits(F.col("text")), "|").alias("hits"))


def compression_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", edits.compression("text").alias("ratio"))


def edit_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("call_id", "block_no", edits.gate_edits("raw", "edited").alias("text"))


# ---- signals ----


#: Samples a second of the tracks made of vectors: a vector of 64 is a chunk of 125 ms.
RATE = 512


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as tracks of 8 s, three to a call, silent at times; a fourth is the sum of the first two, a fifth another take of the third."""
    n = F.col("vec_id")
    quiet = F.when((F.floor(n / 12) + n % 3) % 3 == 0, 0.02).otherwise(1.0)
    v = table(spark, folder, "embeddings").select(F.floor(n / 192).alias("call_id"), (n % 3).cast("int").alias("idx"), (F.floor(n / 3) % 64).alias("chunk"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * quiet).alias("samples"))
    a, b = v.where("idx = 0").select("call_id", "chunk", F.col("samples").alias("x")), v.where("idx = 1").select("call_id", "chunk", F.col("samples").alias("y"))
    mix = a.join(b, ["call_id", "chunk"]).select("call_id", F.lit(3).alias("idx"), "chunk", F.zip_with("x", "y", lambda p, q: p + q).alias("samples"))
    take = v.where("idx = 2").select("call_id", F.lit(4).alias("idx"), "chunk", F.transform("samples", lambda x: x * 0.97).alias("samples"))
    return v.unionByName(mix).unionByName(take)


def track_levels(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder)
    on = signals.activity(c, signals.hop(RATE)).groupBy("call_id", "idx").agg(F.count_if("active").cast("int").alias("active"), F.count(F.lit(1)).cast("int").alias("windows"))
    return signals.levels(c).join(on, ["call_id", "idx"]).select("call_id", "idx", F.round("rms", 6).alias("rms"), "active", "windows")


def pair_corr_gain(spark: SparkSession, folder: str) -> DataFrame:
    s = signals.pair_stats(_chunks(spark, folder), signals.hop(RATE))
    return s.select("call_id", "a_idx", "b_idx", *(F.round(c, 6).alias(c) for c in ("corr", "g_b_in_a", "g_a_in_b", "resid", "a_given_b", "b_given_a")))


def envelope(spark: SparkSession, folder: str) -> DataFrame:
    e = signals.envelope(_chunks(spark, folder), 16, signals.hop(RATE))
    return e.select("call_id", "idx", F.col("bucket").cast("int").alias("bucket"), F.round("level", 6).alias("level"))


def _warnings(spark: SparkSession, folder: str) -> DataFrame:
    return signals.shared_voices(signals.pair_stats(_chunks(spark, folder), signals.hop(RATE)))


def shared_voice(spark: SparkSession, folder: str) -> DataFrame:
    return _warnings(spark, folder).withColumn("drop_db", F.round("drop_db", 4))


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("call_id", "idx").distinct()


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return separation.resolve(_selected(spark, folder), checkpointed(_warnings(spark, folder)))


def _listed(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def resolve_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).select("call_id", "idx", "action", _listed("subtract"))


def _given_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings made up for every call of the tracks table: the second track holds the first, the third is a take of the second."""
    t = catalog.named_tracks(table(spark, folder, "tracks")).select("call_id", "idx", "position")
    first = t.where("position = 1").select("call_id", F.col("idx").alias("one"))
    pair = t.where("position in (2, 3)").join(t.select("call_id", (F.col("position") + 1).alias("position"), F.col("idx").alias("before")), ["call_id", "position"]).join(first, "call_id")
    holds = F.col("position") == 2
    return pair.select("call_id", F.col("idx").alias("mix_idx"), F.when(holds, F.col("one")).otherwise(F.col("before")).alias("component_idx"), F.when(holds, "contains").otherwise("duplicate").alias("kind"), F.lit(0.0).alias("drop_db"))


def given_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of real calls over made-up warnings, where every fifth call's user has chosen and every seventh has a saved plan."""
    sel = table(spark, folder, "tracks").select("call_id", "idx").distinct()
    detected = separation.resolve(sel, _given_warnings(spark, folder))
    no = F.regexp_extract("call_id", r"(\d+)$", 1).try_cast("int")
    saved = detected.where(no % 7 == 0).select("call_id", "idx", F.lit("keep").alias("action"), F.array().cast("array<int>").alias("subtract"))
    chosen = sel.where(no % 5 == 0).select("call_id", "idx", F.array("idx").alias("subtract"))
    return separation.applied(sel, saved, chosen, detected).select("call_id", "idx", "action", _listed("subtract"), "origin")


def track_roster(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "tracks")
    plan = separation.resolve(t.select("call_id", "idx").distinct(), _given_warnings(spark, folder))
    return separation.roster(t, plan).select("call_id", "idx", "audio", "place", "name", "lane", "ghost", _listed("removes"), "set_aside", "start")


def track_states(spark: SparkSession, folder: str) -> DataFrame:
    """States under the made-up warnings where nothing is subtracted in every second call and the last track of every third is off."""
    t = catalog.named_tracks(table(spark, folder, "tracks"))
    no, w = F.coalesce(F.regexp_extract("call_id", r"(\d+)$", 1).try_cast("int"), F.lit(0)), _given_warnings(spark, folder)
    last = t.groupBy("call_id").agg(F.max("idx").alias("last"))
    sel = t.join(last, "call_id").where(~((no % 3 == 0) & (F.col("idx") == F.col("last")) & F.col("several"))).select("call_id", "idx")
    subs = separation.resolve(sel, w).where(no % 2 == 1).select("call_id", "idx", "subtract").where(F.size("subtract") > 0)
    none = t.limit(0).select("call_id", "idx", F.col("idx").alias("duplicate_of"))
    return catalog.track_states(t, sel, subs, w, none).select("call_id", "idx", "state")


def track_roles(spark: SparkSession, folder: str) -> DataFrame:
    return signals.classify(_chunks(spark, folder), signals.hop(RATE)).select("call_id", "idx", "kind", _listed("refs"), "duplicate_of")


def isolate_residual(spark: SparkSession, folder: str) -> DataFrame:
    """The fourth track of each call without the first, level of what is left."""
    c = _chunks(spark, folder)
    plan = c.select("call_id").distinct().select("call_id", F.lit(3).alias("idx"), F.array(F.lit(0)).alias("refs"))
    return signals.levels(signals.isolate(c, plan)).select("call_id", F.round("rms", 6).alias("rms"))


def first_speech(spark: SparkSession, folder: str) -> DataFrame:
    h = signals.half_seconds(_chunks(spark, folder))
    return h.select("call_id", "idx", F.round(signals.first_speech(F.col("levels")), 6).alias("at"))


def segment_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of stretches of a second and a bit from each track."""
    t = _selected(spark, folder)
    s = t.select("call_id", "idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("call_id", "idx", "k", (F.col("k") * 1.03).alias("start"), (F.col("k") * 1.03 + 1.21).alias("end"))
    return signals.segment_energy(s, _chunks(spark, folder), RATE).select("call_id", "idx", "k", F.round("energy", 6).alias("energy"))


def envelope_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks whose envelope an earlier one has too."""
    e = signals.envelope(_chunks(spark, folder), 16, signals.hop(RATE))
    levels = e.groupBy("call_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "level"))), lambda x: x["level"]).alias("levels"))
    return separation.twins(levels.withColumn("channel", F.lit(0)))


def bleed_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on each pair of tracks."""
    d = bleed.decide(bleed.analyse(checkpointed(bleed.window_lags(_chunks(spark, folder), RATE)), RATE))
    return d.select("call_id", "a_idx", "b_idx", F.round("rho", 6).alias("rho"), "lag", "direction", F.round("consistency", 6).alias("consistency"), F.round("symmetry", 6).alias("symmetry"), "n_active", "verdict", "tier")


def bleed_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the verdicts per pair of positions."""
    s = bleed.sweep(bleed_verdicts(spark, folder), "a_idx", "b_idx")
    return s.select("a_idx", "b_idx", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")), "auto_clean", "ask", "refuse", "tier", "sure")


# ---- catalogue ----


def track_names(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.named_tracks(table(spark, folder, "tracks")).select("call_id", "idx", "position", "several", "name", formats.unit_key("idx").alias("unit"))


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    stem, suffix = catalog.file_parts(F.col("source_path"))
    return _history(spark, folder).select("id", stem.alias("stem"), suffix.alias("suffix"), catalog.family(F.col("model")).alias("family"))


def name_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Names for the transcripts of all runs where those of every tenth run exist already."""
    h = _history(spark, folder)
    stem, _ = catalog.file_parts(F.col("source_path"))
    w = h.select(F.regexp_extract("source_path", r"^(.*)/", 1).alias("folder"), stem.alias("stem"), F.lit(".md").alias("suffix"), F.col("id").alias("seq"))
    taken = w.where("seq % 10 = 0").select("folder", F.concat("stem", "suffix").alias("name")).distinct()
    return catalog.free_names(w, taken).select("seq", "folder", "name")


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    return h.select("id", catalog.front_matter(F.col("source_path"), F.col("model"), F.col("language"), F.col("started_at"), F.col("elapsed_seconds")).alias("head"))


FLAGSHIP = turn_markdown
QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_interrupting, turn_blocks, turn_interruptions, pause_blocks, turn_markdown, lane_payload, batch5, context_window, region_pack, line_pack, echo_candidates, echo_drop,
        spacing_tokens, word_coalesce, token_words, word_bucket, segment_times, realign, eta_by_model_language, history_latest200, recent_success60, latest_turns, stored_turns, resumable_jobs,
        committed_log, format_all, bench_metrics, judge_aggregate, gated_rank, majority_vote, rating_upsert, norm_text, fold_text, containment_accept, drift_metrics, drift_report, repetition_5gram,
        phrase_hits, compression_ratio, edit_gate, track_levels, pair_corr_gain, envelope, shared_voice, resolve_plan, given_plan, track_roster, track_states, track_roles, isolate_residual, first_speech, segment_levels, envelope_twins, bleed_verdicts, bleed_sweep, track_names, file_catalog,
        name_suffix, front_matter,
    )
}
QUERIES |= job_queries.QUERIES
