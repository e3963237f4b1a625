"""Run history: estimates, latest rows and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNS, FALLBACK = 20, 0.35
SCHEMA = (
    "id long, source_path string, output_path string, model string, language string, audio_duration_seconds double, elapsed_seconds double, "
    "started_at string, finished_at string, status string, error string, turns_json string"
)


def migrated(history: DataFrame) -> DataFrame:
    """History of any age with all of today's columns; those it lacks are null (DDL-1)."""
    have = set(history.columns)
    cols = (c.split(" ") for c in SCHEMA.split(", "))
    return history.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in cols))


def latest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the greatest id of each group, or of all (SRT-2, SRC-9).

    Per group the limit is applied within each partition before the shuffle, so a
    group that holds much of the table comes down to n rows a partition.
    """
    if not keys:
        return df.orderBy(F.desc("id")).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ratios(history: DataFrame, *keys: str, runs: int = RUNS) -> DataFrame:
    """Mean of elapsed / duration over the latest `runs` good runs of each group (AGG-1)."""
    good = history.where((F.col("status") == "success") & (F.col("audio_duration_seconds") > 0) & F.col("elapsed_seconds").isNotNull())
    return latest(good, runs, *keys).groupBy(*keys).agg(F.avg(F.col("elapsed_seconds") / F.col("audio_duration_seconds")).alias("ratio"))


def estimate(requests: DataFrame, history: DataFrame, defaults: DataFrame | None = None, fallback: float = FALLBACK) -> DataFrame:
    """`requests` (model, language, duration, ...) with ``seconds`` (AGG-2, AGG-3, JON-6).

    The ratio is that of the model and language (null is a language), else of the
    model, else of `defaults` (model, ratio), else `fallback`. A column ``tracks``
    multiplies, where there is one.
    """
    exact = ratios(history, "model", "language").select(F.col("model").alias("m1"), F.col("language").alias("l1"), F.col("ratio").alias("r1"))
    any_language = ratios(history, "model").select(F.col("model").alias("m2"), F.col("ratio").alias("r2"))
    q = requests.join(exact, (F.col("model") == F.col("m1")) & F.col("language").eqNullSafe(F.col("l1")), "left").join(any_language, F.col("model") == F.col("m2"), "left")
    levels = [F.col("r1"), F.col("r2")]
    if defaults is not None:
        q = q.join(defaults.select(F.col("model").alias("m3"), F.col("ratio").alias("r3")), F.col("model") == F.col("m3"), "left")
        levels.append(F.col("r3"))
    tracks = F.greatest(F.col("tracks"), F.lit(1)) if "tracks" in requests.columns else F.lit(1)
    return q.select(*requests.columns, (F.coalesce(*levels, F.lit(fallback)) * F.col("duration") * tracks).alias("seconds"))


def latest_turns(history: DataFrame) -> DataFrame:
    """The newest stored turns of each output (SRC-10)."""
    h = history.where(F.col("turns_json").isNotNull() & F.col("output_path").isNotNull())
    return h.groupBy("output_path").agg(F.max_by("turns_json", "id").alias("turns_json"))


TURNS = "array<struct<speaker:string,start:double,end:double,interrupting:boolean,text:string,words:array<struct<start:double,end:double,text:string,lead_space:boolean>>>>"


def parsed_turns(turns_json):
    """Turns of a JSON column, null where it is malformed (PRJ-5)."""
    return F.when(F.expr(f"try_parse_json({turns_json})").isNotNull(), F.from_json(turns_json, TURNS))


def recent(history: DataFrame, n: int = 60, files: DataFrame | None = None) -> DataFrame:
    """Of the latest n runs those that succeeded, and whose output is among `files` (path), if given: the limit comes before the filters (PRJ-4)."""
    good = latest(history, n).where("status = 'success'")
    return good if files is None else good.join(files.select(F.col("path").alias("output_path")).distinct(), "output_path", "left_semi").select(history.columns)


def grid(history: DataFrame) -> DataFrame:
    """Rows for a list: when, model, language ('auto' for null), status (PRJ-6)."""
    return history.select("id", F.coalesce("finished_at", "started_at").alias("at"), "model", F.coalesce("language", F.lit("auto")).alias("language"), "status")


def resumable(jobs: DataFrame, states: tuple[str, ...] = ("running", "paused")) -> DataFrame:
    """Jobs in one of the states with ``turn``, their place, oldest first; no start counts as the oldest (SRC-14, SRT-4)."""
    return jobs.where(F.col("status").isin(*states)).orderBy(F.coalesce("started_at", F.lit("")), "id")


def record(runs: DataFrame, path: str) -> None:
    """Append runs to a history table (SNK-3)."""
    migrated(runs).write.mode("append").parquet(path)
