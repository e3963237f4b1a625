"""Jobs, their checkpoints and what is shown of them.

A job is a row: id, source_path, model, language, status, status_detail, error,
output_path, polish, audio_duration_seconds, estimated_seconds,
estimated_polish_seconds, transcribe_fraction, transcribe_position_fraction,
elapsed (seconds since it started, or that it took), polish_elapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions import formats

#: Sets of states.
ACTIVE, TERMINAL, RESUMABLE = ("converting", "loading model", "transcribing", "polishing"), ("done", "error", "stopped"), ("running", "paused")
CANCELABLE = ("queued", *ACTIVE)
#: What is written of a job at each stage, and what stands between the parts.
TRANSCRIBING, ESTIMATING, ESTIMATED, POLISHING, LOADING, DONE_IN, STOPPED = "Transcribing…", "Estimating…", "~ Estimated ", "Polishing…", "Loading model…", "done in ", "stopped"
FIRST_GUESS, NOTHING, WAITING, RESUMING, PART, PANEL_PART = "estimating...", "-", "waiting...", "Resuming…", "  ·  ", "  •  "
PANEL_LOADING, PANEL_UNKNOWN, PANEL_GUESS, PANEL_POLISHING = "Loading model into memory…", "Transcribing…  •  estimating progress", "Estimating progress", "Cleaning up the transcript"
#: Maps of a configuration whose keys are track numbers.
TRACK_MAPS = {"track_names": "string", "track_languages": "string", "track_denoise": "boolean", "track_subtractions": "array<int>", "selected_channel_by_track": "int"}
CONFIG = (
    "struct<source_path:string,model:string,language:string,polish:boolean,audio_duration_seconds:double,separation_done:boolean,tracks:array<struct<index:int,channels:int,title:string>>,"
    "selected_track_indices:array<int>," + ",".join(f"{n}:map<string,{t}>" for n, t in TRACK_MAPS.items()) + ">"
)
CHECKPOINT = (
    f"struct<key:string,version:int,status:string,phase:string,multi_track:boolean,completed_units:array<string>,partial_unit:string,partial_done_chunks:int,artifacts:map<string,string>,started_at:string,updated_at:string,config:{CONFIG}>"
)
#: Qualities that are offered again after a restart, and the one taken instead of others.
RESTORED, SLOW = ("Slow", "Fast"), "Slow"


def checkpoints(texts: DataFrame, value: str = "value") -> DataFrame:
    """Checkpoints from their JSON, one a row; text that is no JSON object with a key counts as none (SRC-13).

    Missing fields have their defaults: running, queued, no units done, version 1.
    """
    ok = texts.where(F.expr(f"try_parse_json(`{value}`)").isNotNull() & F.col(value).rlike(r"^\s*\{"))
    c = ok.select(F.from_json(value, CHECKPOINT).alias("c")).select("c.*").where("key is not null")
    empty = {"version": F.lit(1), "status": F.lit("running"), "phase": F.lit("queued"), "completed_units": F.array().cast("array<string>"), "partial_done_chunks": F.lit(0), "artifacts": F.create_map().cast("map<string,string>")}
    return c.select(*(F.coalesce(n, empty[n]).alias(n) if n in empty else F.col(n) for n in c.columns))


def checkpoint_json(points: DataFrame) -> DataFrame:
    """key and ``value``: checkpoints as JSON with nulls kept, stamped with the time of writing (SNK-5)."""
    p = points.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return p.select("key", F.to_json(F.struct(*p.columns), {"ignoreNullFields": "false"}).alias("value"))


def config_json(jobs: DataFrame) -> DataFrame:
    """id and ``config``: what a job is to do, as JSON (SRC-20).

    Track sets are sorted, numeric keys of the TRACK_MAPS become text and empty maps
    null; progress and results are left out.
    """
    have = set(jobs.columns)
    col = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t)
    maps = [F.when(F.size(col(n, f"map<int,{t}>")) > 0, F.transform_keys(col(n, f"map<int,{t}>"), lambda k, v: k.cast("string"))).alias(n) for n, t in TRACK_MAPS.items()]
    body = F.struct(
        col("source_path", "string").alias("source_path"), col("model", "string").alias("model"), col("language", "string").alias("language"), F.coalesce(col("polish", "boolean"), F.lit(False)).alias("polish"),
        col("audio_duration_seconds", "double").alias("audio_duration_seconds"), F.coalesce(col("separation_done", "boolean"), F.lit(False)).alias("separation_done"),
        col("tracks", "array<struct<index:int,channels:int,title:string>>").alias("tracks"), F.array_sort(col("selected_track_indices", "array<int>")).alias("selected_track_indices"), *maps,
    )
    return jobs.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("config"))


def parsed_config(configs: DataFrame, value: str = "config") -> DataFrame:
    """The other way: the other columns and the fields of CONFIG, map keys as numbers again; polish is on unless it is stored as off (SRC-20)."""
    rest = [c for c in configs.columns if c != value]
    c = configs.select(*rest, F.from_json(value, CONFIG).alias("c")).select(*rest, "c.*")
    c = c.withColumn("polish", F.coalesce("polish", F.lit(True))).withColumn("separation_done", F.coalesce("separation_done", F.lit(False)))
    for n in TRACK_MAPS:
        c = c.withColumn(n, F.when(F.size(n) > 0, F.transform_keys(n, lambda k, v: k.cast("int"))))
    return c


def resumed(points: DataFrame, sources: DataFrame) -> DataFrame:
    """Checkpoints in a resumable state with ``go``: to be queued again, or discarded since the source is gone; oldest first (PRJ-18).

    `sources`: path of the files there are.
    """
    s = sources.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    j = points.where(F.col("status").isin(*RESUMABLE)).join(s, F.col("config.source_path") == F.col("_path"), "left")
    out = j.withColumn("go", F.when(F.col("_there"), "queue").otherwise("discard")).drop("_path", "_there")
    return out.orderBy(F.coalesce("started_at", F.lit("")), "key")


def in_flight(jobs: DataFrame) -> DataFrame:
    """Rows for jobs that were queued again and are not finished: id, name, source, status, progress, detail (PRJ-18)."""
    name = F.regexp_replace(F.regexp_extract("source_path", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    return jobs.where(~F.col("status").isin(*TERMINAL)).select("id", name.alias("name"), F.col("source_path").alias("source"), F.lit("working").alias("status"), percent("transcribe_fraction").alias("progress"), F.lit(RESUMING).alias("detail"))


def percent(fraction: Column | str) -> Column:
    """A share in whole hundredths, halves to even, null as 0."""
    f = F.col(fraction) if isinstance(fraction, str) else fraction
    return F.bround(F.coalesce(f, F.lit(0.0)) * 100, 0).cast("int")


#: What a finished job loses when it is set back.
RUN_TIME = ("estimated_seconds", "started_at", "elapsed", "transcribe_fraction", "transcribe_position_fraction", "polish_started_at", "polish_elapsed", "output_path", "error")


def reset(jobs: DataFrame) -> DataFrame:
    """Finished jobs set back to ready: what they are to do stays, what the run left is null (PRJ-22)."""
    blank = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in RUN_TIME if c in jobs.columns}
    done = F.col("status").isin(*TERMINAL)
    return jobs.select(*((F.when(done, blank[c]).otherwise(F.col(c)).alias(c) if c in blank else F.when(done, "ready").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)) for c in jobs.columns))


def payload(jobs: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """What is told of each job (PRJ-3): id, status, progress, detail, source, polish_eta, output, transcript, error.

    An estimate only while it is polished, output and transcript (of `transcripts`:
    output_path, transcript) only when it is done, the error only after one.
    """
    done = (F.col("status") == "done") & F.col("output_path").isNotNull()
    if transcripts is not None:
        jobs = jobs.join(transcripts.select(F.col("output_path").alias("_o"), F.col("transcript").alias("_t")), F.col("output_path") == F.col("_o"), "left")
    said = F.when(done, F.col("_t")) if transcripts is not None else F.lit(None).cast("string")
    return jobs.select(
        "id", "status", percent("transcribe_fraction").alias("progress"), F.coalesce(F.nullif("status_detail", F.lit("")), "status").alias("detail"), F.col("source_path").alias("source"),
        F.when(F.col("status") == "polishing", F.coalesce("estimated_polish_seconds", F.lit(0.0)).cast("int")).alias("polish_eta"),
        F.when(done, F.col("output_path")).alias("output"), said.alias("transcript"), F.when(F.col("status") == "error", F.col("error")).alias("error"),
    )


def button(status: Column) -> tuple[Column, Column]:
    """What the button of a job does, and whether it can be pressed (PRJ-20)."""
    does = F.when(status == "ready", "start").when(status.isin(*CANCELABLE), "stop").when(status.isin(*TERMINAL), "reset").otherwise("busy")
    return does, does != "busy"


def settings_view(settings: DataFrame, qualities: DataFrame, default_model: str, default_language: str) -> DataFrame:
    """quality, tidy and language of stored settings (model, polish, language); a quality that is not RESTORED is Slow (PRJ-19).

    `qualities`: model, quality.
    """
    q = qualities.select(F.col("model").alias("_m"), "quality")
    s = settings.withColumn("_model", F.coalesce("model", F.lit(default_model))).join(q, F.col("_model") == F.col("_m"), "left")
    rest = [c for c in settings.columns if c not in ("model", "polish", "language")]
    return s.select(*rest, F.when(F.col("quality").isin(*RESTORED), F.col("quality")).otherwise(SLOW).alias("quality"), F.coalesce("polish", F.lit(True)).alias("tidy"), F.coalesce("language", F.lit(default_language)).alias("language"))


def overall(tracks_done: Column, fraction: Column, total: Column) -> Column:
    """Share of a job of several tracks that is done, when so much of the next one is (WIN-10)."""
    return (tracks_done + fraction) / F.greatest(total, F.lit(1))


def viewed(jobs: DataFrame) -> DataFrame:
    """`jobs` with share, fraction, real, timecode and eta of the transcription (FMT-9).

    A measured fraction counts before an estimate; only it has a timecode. The
    clean-up pass keeps its share of the bar and its time of what is left.
    """
    share = formats.polish_share("estimated_seconds", "estimated_polish_seconds", F.coalesce("polish", F.lit(False)))
    d, e, later = F.col("audio_duration_seconds"), F.coalesce("elapsed", F.lit(0.0)), F.coalesce("estimated_polish_seconds", F.lit(0.0))
    real, guess = F.col("transcribe_fraction").isNotNull(), F.coalesce("estimated_seconds", F.lit(0.0)) != 0
    raw = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("transcribe_fraction")))
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("transcribe_position_fraction"))) * d
    code = F.when(real & (d != 0) & F.col("transcribe_position_fraction").isNotNull(), F.concat(formats.timecode(place), F.lit(" / "), formats.timecode(d)))
    fraction = F.when(real, raw * (1 - share)).when(guess, F.least(F.lit(0.99), e / F.col("estimated_seconds")) * (1 - share))
    eta = F.when(real, F.when((raw > 0) & (e != 0), e / raw - e + later)).when(guess, F.greatest(F.lit(0.0), F.col("estimated_seconds") - e) + later)
    return jobs.withColumns({"share": share, "fraction": fraction, "real": real, "timecode": code, "eta": eta})


def polish_viewed(jobs: DataFrame) -> DataFrame:
    """`jobs` with fraction and eta of the clean-up pass, which goes on where the transcription ended (FMT-9)."""
    share = formats.polish_share("estimated_seconds", "estimated_polish_seconds", F.coalesce("polish", F.lit(False)))
    share = F.when(share == 0, formats.SHARE_MIN).otherwise(share)
    whole = F.when(F.coalesce("estimated_polish_seconds", F.lit(0.0)) == 0, formats.POLISH_BASE).otherwise(F.col("estimated_polish_seconds"))
    e = F.coalesce("polish_elapsed", F.lit(0.0))
    done = F.when(whole > 0, F.least(F.lit(0.99), e / whole)).otherwise(0.99)
    return jobs.withColumns({"fraction": (1 - share) + share * done, "eta": F.greatest(F.lit(0.0), whole - e)})


def lines(jobs: DataFrame) -> DataFrame:
    """id, status_line, bar, detail of each job's row (FMT-11, FMT-9).

    bar is null while nothing can be said of the progress.
    """
    v = viewed(jobs)
    p = polish_viewed(jobs).select("id", F.col("fraction").alias("p_fraction"), F.col("eta").alias("p_eta"))
    j = v.join(p, "id")
    status, left, p_left = F.col("status"), formats.minutes_left("eta"), formats.minutes_left("p_eta")
    state = F.when((status == "error") & (F.coalesce("error", F.lit("")) != ""), F.concat(F.lit("error: "), "error")).otherwise(status)
    note = F.nullif("status_detail", F.lit(""))
    head = F.when(note.isNotNull(), F.concat(state, F.lit(" ("), note, F.lit(")"))).otherwise(state)
    parts = F.array_compact(F.array(note, F.col("timecode"), F.when(left.isNotNull(), F.concat(F.lit("~"), left, F.lit(" left")))))
    measured = F.when(F.size(parts) > 0, F.array_join(parts, PART)).otherwise(F.concat(percent("fraction").cast("string"), F.lit("%")))
    guessed = F.when(left.isNotNull(), F.concat(F.lit(ESTIMATED), left, F.lit(" left"))).otherwise(ESTIMATING)
    total = F.when(F.coalesce("estimated_seconds", F.lit(0.0)) != 0, formats.elapsed(F.col("estimated_seconds") + F.coalesce("estimated_polish_seconds", F.lit(0.0))))
    detail = (
        F.when(status == "transcribing", F.when(F.col("fraction").isNull(), TRANSCRIBING).when(F.col("real"), measured).otherwise(guessed))
        .when(status == "polishing", F.when(p_left.isNotNull(), F.concat(F.lit(f"{POLISHING}{PART}~"), p_left, F.lit(" left"))).otherwise(POLISHING))
        .when(status == "loading model", LOADING)
        .when(status == "done", F.concat(F.lit(DONE_IN), formats.elapsed("elapsed")))
        .when(status == "stopped", STOPPED)
        .when(status == "ready", F.when(total.isNotNull(), F.concat(F.lit("~"), total, F.lit(" estimated"))).when(F.col("audio_duration_seconds").isNull(), FIRST_GUESS).otherwise(NOTHING))
        .when(status == "queued", F.when(total.isNotNull(), F.concat(F.lit(f"{WAITING} (~"), total, F.lit(")"))).otherwise(WAITING))
        .otherwise(formats.elapsed("elapsed"))
    )
    bar = F.when(status == "transcribing", F.col("fraction") * 100).when(status == "polishing", F.col("p_fraction") * 100).when(status == "done", 100.0).when(status != "loading model", 0.0)
    return j.select("id", head.alias("status_line"), bar.alias("bar"), detail.alias("detail"))


def panel(jobs: DataFrame) -> DataFrame:
    """id, title, detail of the panel above, for jobs at work (FMT-11)."""
    v = viewed(jobs.where(F.col("status").isin(*ACTIVE)))
    p = polish_viewed(jobs).select("id", F.col("eta").alias("p_eta"))
    j = v.join(p, "id")
    status, left, p_left = F.col("status"), formats.minutes_left("eta"), formats.minutes_left("p_eta")
    name, note = F.regexp_extract("source_path", r"([^/]*)/*$", 1), F.nullif("status_detail", F.lit(""))
    title = F.concat(F.upper(F.substring("status", 1, 1)), F.substr("status", F.lit(2)), F.lit(": "), name)
    about = lambda x: F.when(x.isNotNull(), F.concat(F.lit("about "), x, F.lit(" left")))
    joined = lambda *x: F.array_join(F.array_compact(F.array(*x)), PANEL_PART)
    detail = (
        F.when(status == "loading model", PANEL_LOADING)
        .when(status == "transcribing", F.when(F.col("fraction").isNull(), PANEL_UNKNOWN).when(F.col("real"), joined(F.col("timecode"), F.concat(percent("fraction").cast("string"), F.lit("%")), about(left))).otherwise(joined(F.lit(PANEL_GUESS), about(left))))
        .when(status == "polishing", joined(F.lit(PANEL_POLISHING), about(p_left)))
        .otherwise(F.concat(formats.elapsed(F.coalesce("elapsed", F.lit(0.0))), F.lit(" elapsed")))
    )
    return j.select("id", F.when(note.isNotNull(), F.concat(title, F.lit(" ("), note, F.lit(")"))).otherwise(title).alias("title"), detail.alias("detail"))


def analysed(jobs: DataFrame, *results: DataFrame) -> DataFrame:
    """`jobs` with what analyses of their files found (STR-11).

    Each of `results` has id and columns of jobs or new ones; what it knows replaces
    what was known, null changes nothing. Analyses are lazy and may be missing for
    any job; nothing waits for them but the join.
    """
    for r in results:
        found = [c for c in r.columns if c != "id"]
        j = jobs.join(r.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in found)), F.col("id") == F.col("_id"), "left")
        old = [F.coalesce(f"_{c}", c).alias(c) if c in found else F.col(c) for c in jobs.columns]
        jobs = j.select(*old, *(F.col(f"_{c}").alias(c) for c in found if c not in jobs.columns))
    return jobs


def discard(spark: SparkSession, folder: str) -> bool:
    """Delete a job's folder with all it holds; whether there was one (SNK-7)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
