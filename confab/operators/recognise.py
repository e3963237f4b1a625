"""Recognisers as pluggable batch functions: dispatch, chunks, resuming, benchmarks (SRC-21, SRC-22, UDF-1, UDF-2, UDF-7, UDF-8).

A recogniser is made once a partition by a factory and then called with (path,
language, start, end) of one chunk; it returns rows (start, end, text) on the
chunk's own clock, or a text. Models stay outside of this library.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators import catalog

Recogniser = Callable[[str, str | None, float, float | None], Any]
Registry = dict[str, Callable[[], Recogniser]]
#: A recogniser's chunk in seconds, and the silence it is carried over.
LONGEST_CHUNK, LONGEST_SILENCE = 28.0, 1.0
_OUT = "key string, unit string, chunk int, start double, end double, text string, error string"


def regions_of(probabilities: DataFrame, threshold: float, step: float, least_silence: float = 0.4, pad: float = 0.2) -> DataFrame:
    """Regions of speech from a detector's probability per step: key, unit, start, end (SRC-22).

    `probabilities`: key, unit, n (number of the step), p. Steps above the threshold
    belong together across pauses shorter than `least_silence`; regions are padded on
    both sides, which may join them.
    """
    from confab.operators.intervals import periods_and_gaps

    reach = least_silence / 2
    on = probabilities.where(F.col("p") > threshold).select(F.struct("key", "unit").alias("e"), F.round((F.col("n") * step - reach) * 1000).alias("a"), F.round(((F.col("n") + 1) * step + reach) * 1000).alias("z"))
    on = on.select(F.to_json("e").alias("e"), "a", "z")
    p = periods_and_gaps(on, "e", "a", "z", 0).where("kind = 'period'")
    k = F.from_json("e", "struct<key:string,unit:string>")
    more = (pad - reach) * 1000
    return p.select(k["key"].alias("key"), k["unit"].alias("unit"), F.greatest(F.lit(0.0), (F.col("start") - more) / 1000).alias("start"), ((F.col("end") + more) / 1000).alias("end"))


def chunk_tasks(units: DataFrame, chunks: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """What is to be recognised: one row a chunk, from the first that is not done (SRC-21, STR-4).

    `units`: key, unit, path, model, language. `chunks`: key, unit, start, end; only
    models that take chunks get them, the others get the whole file as chunk 0 and
    start again. `done`: key, unit, chunks (how many are finished).
    """
    u = units.withColumn("family", catalog.family(F.col("model")))
    by_chunk = F.col("family") == "whisper"
    whole = u.where(~by_chunk if chunks is not None else F.lit(True)).select("*", F.lit(0).alias("chunk"), F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end"))
    if chunks is None:
        return whole
    from confab.operators.ordered import with_order

    c = chunks.select(F.concat_ws("\0", "key", "unit").alias("_e"), "key", "unit", F.round(F.col("start") * 1000).cast("long").alias("_ms"), "start", "end", F.lit(1).alias("_one"))
    c = with_order(c, "_e", ["_ms"], total={"_n": "_one"}).select("key", "unit", (F.col("_n") - 1).cast("int").alias("chunk"), "start", "end")
    if done is not None:
        c = c.join(done.select("key", "unit", F.col("chunks").alias("_done")), ["key", "unit"], "left").where(F.col("chunk") >= F.coalesce("_done", F.lit(0))).drop("_done")
    return u.where(by_chunk).join(c, ["key", "unit"]).select(whole.columns).unionByName(whole)


def recognised(tasks: DataFrame, registry: Registry, partitions: int | None = None) -> DataFrame:
    """Segments of each task on the recording's clock: key, unit, chunk, start, end, text, error (SRC-21, UDF-2).

    Each partition makes the recognisers it needs once. Blank segments are dropped. A
    chunk that fails gives one row with the error and no text; the others go on.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Recogniser] = {}
        for page in pages:
            rows = []
            for t in page.itertuples(index=False):
                try:
                    if t.family not in made:
                        made[t.family] = registry[t.family]()
                    end = None if pd.isna(t.end) else t.end
                    got = made[t.family](t.path, t.language, t.start, end)
                    rows += [(t.key, t.unit, t.chunk, t.start + a, t.start + z, text.strip(), None) for a, z, text in got if text and text.strip()]
                except Exception as e:  # one chunk's failure is a row, not the end of the job
                    rows.append((t.key, t.unit, t.chunk, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "unit", "chunk", "start", "end", "text", "error"])

    wanted = tasks.select("key", "unit", "chunk", "path", "family", "language", "start", "end")
    return (wanted.repartition(partitions) if partitions else wanted).mapInPandas(run, _OUT)


def benchmark(configs: DataFrame, tracks: DataFrame, registry: Registry, match: str = "", clip_seconds: float = 420.0) -> DataFrame:
    """Every configuration on every track: id, track, load_seconds, seconds, rtf, text, error (UDF-7, UDF-8).

    `configs`: id, backend, language; `tracks`: track, path; both are short lists by
    nature. `match` keeps ids that contain it. Making a recogniser and running it are
    timed apart; segments are joined by line breaks; a cell that fails keeps its error.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = []
            for c in page.itertuples(index=False):
                began = loaded = time.perf_counter()
                try:
                    model = registry[c.backend]()
                    loaded = time.perf_counter()
                    got = model(c.path, c.language, 0.0, None)
                    took = time.perf_counter() - loaded
                    text = got if isinstance(got, str) else "\n".join(t for _, _, t in got)
                    rows.append((c.id, c.track, loaded - began, took, took / clip_seconds, text, None))
                except Exception as e:
                    rows.append((c.id, c.track, loaded - began, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "track", "load_seconds", "seconds", "rtf", "text", "error"])

    cells = configs.where(F.col("id").contains(match)).crossJoin(tracks)  # two lists of a few rows each
    return cells.mapInPandas(run, "id string, track string, load_seconds double, seconds double, rtf double, text string, error string")


def speech_done(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """key, unit, done, total, fraction: seconds of speech recognised, and the share in all of the unit's chunks, at most 1 (AGG-14).

    `chunks`: key, unit, chunk, start, end; `done`: key, unit, chunks.
    """
    d = chunks.join(done.select("key", "unit", F.col("chunks").alias("_n")), ["key", "unit"], "left")
    length = F.col("end") - F.col("start")
    g = d.groupBy("key", "unit").agg(F.sum(F.when(F.col("chunk") < F.coalesce("_n", F.lit(0)), length).otherwise(0.0)).alias("done"), F.sum(length).alias("total"))
    return g.withColumn("fraction", F.least(F.lit(1.0), F.coalesce(F.try_divide("done", "total"), F.lit(0.0))))


def labelled_union(parts: list[DataFrame]) -> DataFrame:
    """Segments of several tracks as one table, in order of the tracks: ``track_no`` goes before the rows' own order (SET-1)."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (p.withColumn("track_no", F.lit(i)) for i, p in enumerate(parts)))
