"""Files as tables: media listings, stream manifests, samples and written transcripts."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import is_blank, utrim

#: The suffixes of recordings.
SUFFIXES = ("mp3", "mp4", "m4a", "wav", "mov", "aac", "flac")
PROBE = "struct<streams:array<struct<index:int,codec_type:string,channels:int,tags:struct<title:string>>>,format:struct<duration:string>>"


def media(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path and length of the recordings below a folder, in order of their path's parts (SRC-1).

    Suffixes are matched whatever their case; contents are not read.
    """
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(folder)
    return files.select("path", "length").orderBy(F.split("path", "/"))


#: The suffixes of files that may be dropped on the program.
DROPPED = ("mp3", "wav", "m4a", "aac", "flac", "mp4", "mov", "m4v", "mkv", "webm")


def dropped(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of given paths those that are recordings by their suffix, whatever its case (SRC-3)."""
    return paths.where(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*DROPPED))


def first_file(spark: SparkSession, folder: str) -> DataFrame:
    """The first file of a folder that does not begin with a dot (SRC-2)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith(".")).orderBy("path").limit(1)


def streams(manifests: DataFrame, value: str = "json") -> DataFrame:
    """Audio streams of media probes in JSON: the other columns, idx, channels, title, duration (SRC-4, SRC-5, SRC-6).

    Malformed probes have no streams; a missing channel count is 1, an empty title null.
    """
    ok = manifests.where(F.expr(f"try_parse_json({value})").isNotNull()).withColumn("_p", F.from_json(value, PROBE))
    rest = [c for c in manifests.columns if c != value]
    s = ok.select(*rest, F.col("_p.format.duration").try_cast("double").alias("duration"), F.explode("_p.streams").alias("s")).where("s.codec_type is null or s.codec_type = 'audio'")
    return s.select(*rest, F.col("s.index").alias("idx"), F.coalesce("s.channels", F.lit(1)).alias("channels"), F.nullif(utrim("s.tags.title"), F.lit("")).alias("title"), "duration")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """Mono samples from -1 to 1 of 16-bit WAV bytes; channels are averaged (SRC-7, SRC-8)."""

    def one(data: bytes) -> list[float]:
        with wave.open(io.BytesIO(data)) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            return (x.mean(axis=1) / 32768).tolist()

    return content.map(lambda d: None if d is None else one(bytes(d)))


def wav_stretch(start: float = 0.0, seconds: float | None = None, channel: int | None = None):
    """UDF (content): mono samples of a stretch of 16-bit WAV bytes, of one channel or averaged; only its frames are decoded (SRC-7)."""

    def one(data: bytes) -> list[float]:
        with wave.open(io.BytesIO(data)) as w:
            begin = min(int(start * w.getframerate()), w.getnframes())
            w.setpos(begin)
            n = w.getnframes() - begin if seconds is None else int(seconds * w.getframerate())
            x = np.frombuffer(w.readframes(n), "<i2").reshape(-1, w.getnchannels())
            return ((x.mean(axis=1) if channel is None else x[:, channel].astype(float)) / 32768).tolist()

    return F.pandas_udf(lambda content: content.map(lambda d: None if d is None else one(bytes(d))), T.ArrayType(T.DoubleType()))


def sample_range(samples: Column, rate: int, start: float = 0.0, seconds: float | None = None) -> Column:
    """The samples of a time range (SRC-7)."""
    begin = int(start * rate)
    return F.slice(samples, begin + 1, int(seconds * rate) if seconds is not None else F.greatest(F.size(samples) - begin, F.lit(0)))


def _head(line: str) -> tuple[str, str, str] | None:
    """Speaker, time and what follows, of a line that heads a turn: a name in two stars each side, a time in brackets."""
    if not line.startswith("**"):
        return None
    name, stars, rest = line[2:].partition("**")
    rest = rest.lstrip()
    clock, bracket, tail = rest[1:].partition("]")
    digits = clock.split(":")
    timed = len(digits) in (2, 3) and all(d.isascii() and d.isdigit() for d in digits) and len(digits[0]) <= 2 and all(len(d) == 2 for d in digits[1:])
    return (name.strip(), clock, tail) if stars and name and rest.startswith("[") and bracket and timed else None


def _read_transcript(text: str) -> tuple[str, list[tuple]]:
    """Front matter, and (speaker, ts, tail, body) of each turn of a written transcript, read line by line."""
    lines = text.splitlines()
    front, at = [], 0
    if text.startswith("---"):
        end = next((i for i, line in enumerate(lines[1:], 1) if line.startswith("---")), None)
        if end is not None:
            front, at = lines[: end + 1], end + 1
    turns: list[tuple] = []
    for line in lines[at:]:
        if head := _head(line.strip()):
            turns.append((*head, []))
        elif turns:
            turns[-1][3].append(line)
    return "\n".join(front), [(s, c, tail, "\n".join(b).strip()) for s, c, tail, b in turns]


_TURN = "array<struct<speaker:string,ts:string,tail:string,body:string>>"


def parsed_transcripts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, front, turns of written transcripts (SRC-16). Null texts have an empty front and no turns."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pages:
            read = [_read_transcript(t or "") for t in p[text]]
            yield pd.DataFrame({key: p[key], "front": [f for f, _ in read], "turns": [[dict(zip(("speaker", "ts", "tail", "body"), t)) for t in ts] for _, ts in read]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, front string, turns {_TURN}")


def transcript_turns(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Turns of written transcripts: key, turn_no, speaker, ts, interrupting, text (SRC-15).

    A front matter is skipped, and so are turns without text. A text without turns
    gives its paragraphs, with empty speaker and time; blank texts give none.
    """
    d = parsed_transcripts(docs.where(~is_blank(text)), key, text)
    own = docs.where(~is_blank(text)).select(F.col(key).alias("_k"), F.col(text).alias("_t")).distinct()
    said = F.filter("turns", lambda t: t["body"] != "")
    with_turns = d.where(F.size(said) > 0).select(key, F.posexplode(said).alias("turn_no", "t"))
    with_turns = with_turns.select(key, "turn_no", "t.speaker", "t.ts", F.startswith(F.col("t.tail"), F.lit(" (interrupting)")).alias("interrupting"), F.col("t.body").alias("text"))
    # of the others the paragraphs behind the front matter
    body = F.when(F.startswith("_t", F.lit("---")), F.regexp_replace("_t", r"(?s)\A---.*?---", "")).otherwise(F.col("_t"))
    plain = own.join(d.where(F.size(said) > 0).select(F.col(key).alias("_k")), "_k", "left_anti").select(F.col("_k").alias(key), F.split(utrim(body), "\n\n").alias("p"))
    plain = plain.select(key, F.posexplode(F.filter(F.transform("p", lambda x: utrim(x)), lambda x: x != "")).alias("turn_no", "text"))
    return with_turns.unionByName(plain.select(key, "turn_no", F.lit("").alias("speaker"), F.lit("").alias("ts"), F.lit(False).alias("interrupting"), "text"))


def reassembled(parsed: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """key and text: transcripts with their heads and new bodies (SNK-14).

    `parsed` as of ``parsed_transcripts``, `bodies`: key, bodies ARRAY<STRING>. A
    different number of bodies and turns is an error, not a silent loss.
    """
    j = parsed.join(bodies.select(key, "bodies"), key)
    same = F.assert_true(F.size("turns") == F.size("bodies"), F.concat(F.lit("bodies "), F.size("bodies").cast("string"), F.lit(" != blocks "), F.size("turns").cast("string")))
    part = F.zip_with("turns", "bodies", lambda t, b: F.concat(F.lit("**"), t["speaker"], F.lit("** ["), t["ts"], F.lit("]"), t["tail"], F.lit("\n"), utrim(b), F.lit("\n")))
    head = F.when(F.col("front") != "", F.concat(F.regexp_replace("front", r"\n+$", ""), F.lit("\n\n"))).otherwise("")
    return j.withColumn("_ok", same).where("_ok is null").select(key, F.concat(utrim(F.concat(head, F.array_join(part, "\n"))), F.lit("\n")).alias("text"))


RESULTS = "struct<audio_duration_seconds:double,runs:map<string,struct<label:string,elapsed_seconds:double,load_seconds:double,error:string,rating:int,notes:string,transcript_file:string>>>"


def results(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a results file: id and the fields of each; no file, and one that is no JSON, has none (SRC-17)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "id string, label string, elapsed_seconds double, load_seconds double, error string, rating int, notes string, transcript_file string, duration double")
    text = spark.read.text(path, wholetext=True).where(F.expr("try_parse_json(value)").isNotNull())
    r = text.select(F.from_json("value", RESULTS).alias("r")).select("r.audio_duration_seconds", F.explode("r.runs").alias("id", "run"))
    return r.select("id", "run.*", F.col("audio_duration_seconds").alias("duration"))


def with_transcripts(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """`runs` with the text of their transcript_file; '' if there is no such file, null where none is named (SRC-18). `texts`: file, text."""
    t = texts.select(F.col("file").alias("_f"), F.col("text").alias("_t"))
    named = F.coalesce("transcript_file", F.lit("")) != ""
    return runs.join(t, F.col("transcript_file") == F.col("_f"), "left").withColumn("transcript_text", F.when(named, F.coalesce("_t", F.lit("")))).drop("_f", "_t")


def middle(duration: Column, clip: float) -> Column:
    """Where a clip of so many seconds from the middle of a recording begins (SNK-17)."""
    return F.greatest(F.lit(0.0), duration / 2 - clip / 2)


def plain_text(segments: DataFrame, key: str = "call_id", order: tuple[str, ...] = ("start_ms", "seq")) -> DataFrame:
    """key and text: the transcript of a recording with one track, its segments joined by blanks; a line break ends what is not empty (TXT-14)."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    joined = utrim(F.array_join(F.transform(parts, lambda p: p["text"]), " "))
    return segments.groupBy(key).agg(joined.alias("text")).withColumn("text", F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise(""))


def settings(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and quotes around values are taken off (SRC-19)."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out.setdefault(k.strip(), v.strip().strip("\"'"))
    return out


def write_transcripts(docs: DataFrame, folder: str) -> None:
    """One text file a row under folder/name=...; `docs`: name, text (SNK-1).

    Rows are spread by name, so writers work side by side.
    """
    docs.select("name", F.col("text").alias("value")).repartition("name").write.mode("append").partitionBy("name").text(folder, lineSep="\0")
