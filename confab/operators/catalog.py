"""Tracks, names, plans and options of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import is_blank


def named_tracks(tracks: DataFrame) -> DataFrame:
    """One row a track with its position and name: the title, or Speaker n (PRJ-9, PRJ-13, PRJ-21)."""
    t = tracks.select("call_id", "idx", "channels", "title").distinct()
    w = Window.partitionBy("call_id").orderBy("idx")  # a handful of tracks a call
    t = t.withColumn("position", F.row_number().over(w)).withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("call_id")) > 1)
    return t.withColumn("name", F.when(is_blank("title"), F.concat(F.lit("Speaker "), F.col("position").cast("string"))).otherwise(F.col("title")))


def override(own: Column, key: Column, default: Column) -> Column:
    """A map's value for the key; missing and empty ones fall back (PRJ-8)."""
    return F.coalesce(F.nullif(F.try_element_at(own, key), F.lit("")), default)


def effective_name(overrides: Column, names: Column, idx: Column) -> Column:
    """Name of a track: the override (number to name), else the default one (the same), else Speaker <number> (PRJ-21)."""
    return F.coalesce(F.nullif(F.try_element_at(overrides, idx), F.lit("")), F.try_element_at(names, idx), F.concat(F.lit("Speaker "), idx.cast("string")))


def labelled(df: DataFrame, labels: DataFrame, key: str, out: str) -> DataFrame:
    """`df` with the label of a key, or the key itself (PRJ-10, JON-6)."""
    names = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    return df.join(names, F.col(key) == F.col("_id"), "left").withColumn(out, F.coalesce("_label", key)).drop("_id", "_label")


#: How recogniser ids tell their make.
PARAKEET, GROQ, ELEVENLABS = "parakeet", "groq:", "elevenlabs:"


def family(model: Column) -> Column:
    """Which recogniser an id is sent to (PRJ-11): by the hosts' prefixes, then by a name anywhere in it, else whisper."""
    return F.when(F.startswith(model, F.lit(GROQ)), "groq").when(F.startswith(model, F.lit(ELEVENLABS)), "elevenlabs").when(F.contains(F.lower(model), F.lit(PARAKEET)), "parakeet").otherwise("whisper")


def put(options: Column, key: Column, value: Column, default: Column) -> Column:
    """A map with the key set, or removed where the value is the default one (MAP-1)."""
    rest = F.map_filter(options, lambda k, v: k != key)
    return F.when(value.isNull() | (value == default), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def request_options(raw: Column) -> Column:
    """Options keyed by text to ones keyed by number; empty lists dropped, nothing left is null (MAP-2)."""
    m = F.map_filter(F.transform_keys(raw, lambda k, v: k.cast("int")), lambda k, v: F.size(v) > 0)
    return F.when(F.size(m) > 0, m)


def asked_for(jobs: DataFrame, options: DataFrame) -> DataFrame:
    """`jobs` (id, track_names, selected_track_indices, track_subtractions, ...) as a request's options change them (MAP-2).

    `options`: id, names and subtractions (maps keyed by text), speakers (list). Names
    and speakers count if there are any; subtractions if they are given at all, without
    their empty lists.
    """
    o = options.select(F.col("id").alias("_id"), F.col("names").alias("_n"), F.col("speakers").alias("_s"), F.col("subtractions").alias("_x"))
    j = jobs.join(o, F.col("id") == F.col("_id"), "left")
    new = {
        "track_names": F.when(F.size("_n") > 0, F.transform_keys("_n", lambda k, v: k.cast("int"))).otherwise(F.col("track_names")),
        "selected_track_indices": F.when(F.size("_s") > 0, F.array_sort(F.array_distinct("_s"))).otherwise(F.col("selected_track_indices")),
        "track_subtractions": F.when(F.col("_x").isNotNull(), request_options(F.col("_x"))).otherwise(F.col("track_subtractions")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns))


def include(selected: Column, idx: Column, on: Column) -> Column:
    """The set with or without an index; the last one stays (ARR-1)."""
    return F.when(on, F.array_union(selected, F.array(idx))).when(F.size(selected) > 1, F.array_remove(selected, idx)).otherwise(selected)


def remember(recent: Column, name: Column, most: int = 12) -> Column:
    """The name in front of those used lately, each once; default-looking names are not remembered (ARR-2)."""
    return F.when(name.isNull() | (name == "") | name.rlike(r"^Speaker \d+$"), recent).otherwise(F.slice(F.array_distinct(F.concat(F.array(name), recent)), 1, most))


def place_of(streams: Column, idx: Column) -> Column:
    """Position of a stream from 0; 0 if it is missing (ARR-3)."""
    return F.greatest(F.array_position(streams, idx) - 1, F.lit(0))


def chosen(tracks: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected tracks of each call; all of a call without a selection that fits (PRJ-7, JON-5)."""
    s = selected.select(F.col("call_id").alias("_c"), F.col("idx").alias("_i")).distinct()
    t = tracks.join(s, (F.col("call_id") == F.col("_c")) & (F.col("idx") == F.col("_i")), "left").withColumn("_any", F.max(F.col("_i").isNotNull()).over(Window.partitionBy("call_id")))
    return t.where(F.col("_i").isNotNull() | ~F.col("_any")).drop("_c", "_i", "_any")


def needed(pending: DataFrame, references: DataFrame) -> DataFrame:
    """Tracks to decode: those to be done and the ones they refer to (SET-2, SET-3)."""
    refs = references.join(pending, ["call_id", "idx"], "left_semi").select("call_id", F.explode("subtract").alias("idx"))
    return pending.select("call_id", "idx").union(refs.select("call_id", "idx")).distinct()


def unhandled(warnings: DataFrame, selected: DataFrame, subtractions: DataFrame) -> DataFrame:
    """Warnings of which both tracks are selected and the component is not taken out of the mix yet (PRJ-15).

    Two takes of one voice stay unhandled whatever is subtracted. `subtractions`:
    call_id, idx, subtract.
    """
    s = selected.select("call_id", "idx").distinct()
    w = warnings.join(s.withColumnRenamed("idx", "mix_idx"), ["call_id", "mix_idx"], "left_semi").join(s.withColumnRenamed("idx", "component_idx"), ["call_id", "component_idx"], "left_semi")
    done = subtractions.select("call_id", F.col("idx").alias("mix_idx"), F.explode("subtract").alias("component_idx")).withColumn("kind", F.lit("contains"))
    return w.join(done, ["call_id", "mix_idx", "component_idx", "kind"], "left_anti")


def _partners(warnings: DataFrame) -> DataFrame:
    """call_id, idx, other: each end of a warning with the other one."""
    ends = F.array(F.struct(F.col("mix_idx").alias("idx"), F.col("component_idx").alias("other")), F.struct(F.col("component_idx").alias("idx"), F.col("mix_idx").alias("other")))
    return warnings.select("call_id", "kind", F.explode(ends).alias("e")).select("call_id", "kind", "e.*")


def track_states(tracks: DataFrame, selected: DataFrame, subtractions: DataFrame, warnings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """State of each track, the first that fits (PRJ-14).

    Of tracks not selected: skipped_dup if it is an exact copy (`duplicates`: call_id,
    idx, duplicate_of) or another take of a selected one, else excluded. Of the
    others: conflict if a warning is unhandled, isolated if something is taken out of
    it, else clean.
    """
    keys = ["call_id", "idx"]
    sel = selected.select(*keys).distinct()
    take = _partners(warnings).where("kind = 'duplicate'").join(sel.withColumnRenamed("idx", "other"), ["call_id", "other"], "left_semi").select(*keys)
    twin = take.union(duplicates.where("duplicate_of is not null").select(*keys)).distinct().withColumn("_twin", F.lit(True))
    open_ = _partners(unhandled(warnings, selected, subtractions)).select(*keys).distinct().withColumn("_open", F.lit(True))
    less = subtractions.where(F.size("subtract") > 0).select(*keys).distinct().withColumn("_less", F.lit(True))
    j = tracks.join(sel.withColumn("_sel", F.lit(True)), keys, "left").join(twin, keys, "left").join(open_, keys, "left").join(less, keys, "left")
    state = F.when(F.col("_sel").isNull(), F.when(F.col("_twin"), "skipped_dup").otherwise("excluded")).when(F.col("_open"), "conflict").when(F.col("_less"), "isolated").otherwise("clean")
    return j.withColumn("state", state).drop("_sel", "_twin", "_open", "_less")


def file_parts(path: Column) -> tuple[Column, Column]:
    """Stem and small suffix of a path; a name that only starts with a dot has none (TXT-19)."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.substr(name, F.lit(1), F.char_length(name) - F.char_length(suffix)), F.lower(suffix)


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Collision-free names: stem, stem (2), stem (3)... (SNK-2).

    `wanted`: folder, stem, suffix, seq; `taken`: folder, name. Rows that want one
    stem get the free numbers in order of seq.
    """
    w = wanted.withColumn("_k", F.row_number().over(Window.partitionBy("folder", "stem", "suffix").orderBy("seq")))
    stems = ["folder", "stem", "suffix"]
    # of the names in use only those that this stem could get: the stem alone or with a number
    many = w.groupBy(*stems).agg(F.max("_k").alias("_n"))
    t = taken.select("folder", "name").distinct().select("folder", "name", F.regexp_extract("name", r"^(.*?)(?: \((?:[2-9]|[1-9]\d+)\))?(\.[^.]*)?$", 1).alias("_b"), F.regexp_extract("name", r"^.*?(?: \((?:[2-9]|[1-9]\d+)\))?(\.[^.]*)?$", 1).alias("suffix"))
    used = t.groupBy("folder", F.col("_b").alias("stem"), "suffix").agg(F.count(F.lit(1)).alias("_t"))
    slots = many.join(used, stems, "left").select(*stems, F.explode(F.sequence(F.lit(1), F.col("_n") + F.coalesce("_t", F.lit(0)))).alias("_s"))
    slots = slots.withColumn("name", F.concat("stem", F.when(F.col("_s") > 1, F.concat(F.lit(" ("), F.col("_s").cast("string"), F.lit(")"))).otherwise(""), "suffix"))
    free = slots.join(taken.select("folder", "name"), ["folder", "name"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy("folder", "stem", "suffix").orderBy("_s")))
    return w.join(free.select("folder", "stem", "suffix", "_k", "name"), ["folder", "stem", "suffix", "_k"]).drop("_k")


def front_matter(source: Column, model: Column, language: Column, at: Column, elapsed: Column, speakers: Column | None = None, diarization: Column | None = None, polished: Column | None = None) -> Column:
    """Header of a written transcript; fields that are not set are left out (SNK-1)."""
    fields = {"source": source, "model": model, "language": F.coalesce(F.nullif(language, F.lit("")), F.lit("auto")), "transcribed_at": at, "elapsed_seconds": F.bround(elapsed, 0).cast("long"), "speakers": speakers, "diarization": diarization, "polished": polished}
    lines = [F.lit("---"), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items() if v is not None)]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))


def transcript_files(runs: DataFrame, taken: DataFrame) -> DataFrame:
    """id, folder, name, text of the files to be written for each run: the transcript, and next to a cleaned one the raw text (SNK-1, SNK-2).

    `runs`: id, folder, source_path, model, language, at, elapsed, speakers,
    diarization, text, raw (null if it was not cleaned). `taken`: folder, name.
    """
    stem, _ = file_parts(F.col("source_path"))
    names = free_names(runs.select("folder", stem.alias("stem"), F.lit(".md").alias("suffix"), F.col("id").alias("seq")), taken).select(F.col("seq").alias("id"), "name")
    j = runs.join(names, "id")
    clean = F.col("raw").isNotNull()
    head = lambda polished: front_matter(*(F.col(c) for c in ("source_path", "model", "language", "at", "elapsed", "speakers", "diarization")), F.when(clean, polished))
    both = F.array(F.struct("name", F.concat(head("true"), F.lit("\n"), "text").alias("text")), F.when(clean, F.struct(F.concat(F.regexp_replace("name", r"\.md$", ""), F.lit(".raw.md")).alias("name"), F.concat(head("false"), F.lit("\n"), "raw").alias("text"))))
    return j.select("id", "folder", F.explode(F.array_compact(both)).alias("f")).select("id", "folder", "f.name", "f.text")
