"""The log of recognised segments and what of it counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "unit string, chunk int, start double, end double, text string, speaker string, energy double, words array<struct<start:double,end:double,text:string,lead_space:boolean>>"


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines with explicit types; blank and torn lines are dropped, a missing chunk is 0 (SRC-11)."""
    ok = lines.where(F.expr(f"try_parse_json({value})").isNotNull() & F.col(value).rlike(r"^\s*\{"))
    rest = [c for c in lines.columns if c != value]
    return ok.withColumn("_l", F.from_json(value, LINE)).select(*rest, "_l.*").withColumn("chunk", F.coalesce("chunk", F.lit(0)))


def committed(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Log rows of finished units, and of the unit in work up to its committed chunks (SRC-11, JON-4).

    `log`: key, unit, chunk, ...; `checkpoints`: key, completed_units, partial_unit,
    partial_done_chunks. Rows written after the last commit, and rows of keys without
    a checkpoint, do not count. The log is not ordered here; its line number is.
    """
    c = checkpoints.select(F.col("key").alias("_key"), F.coalesce("completed_units", F.array().cast("array<string>")).alias("_units"), F.col("partial_unit").alias("_unit"), F.col("partial_done_chunks").alias("_done"))
    done = F.exists("_units", lambda u: u.eqNullSafe(F.col("unit"))) | (F.col("unit").eqNullSafe(F.col("_unit")) & (F.coalesce("chunk", F.lit(0)) < F.col("_done")))
    return log.join(c, (F.col("key") == F.col("_key")) & F.coalesce(done, F.lit(False)), "left_semi")


def unit_rows(log: DataFrame, checkpoints: DataFrame, unit: str) -> DataFrame:
    """Committed rows of one unit (SRC-12)."""
    return committed(log.where(F.col("unit") == unit), checkpoints)


def compact(log: DataFrame, checkpoints: DataFrame, path: str) -> None:
    """Write the committed rows to a new place; readers switch to it afterwards (SNK-6)."""
    committed(log, checkpoints).write.mode("errorifexists").parquet(path)
