"""Recognised chunks as a stream, committed exactly once (STR-1 to STR-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from confab.operators.commitlog import LINE

CHUNK = f"key string, line_no long, {LINE}"


def chunk_stream(spark: SparkSession, folder: str, schema: str = CHUNK) -> DataFrame:
    """Rows of chunk files (JSON lines) as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def commit(stream: DataFrame, log: str, state: str, per_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder of the log, then let the stream commit it (SNK-4, SNK-5).

    A batch that is run again after a crash overwrites its own folder, so rows are
    neither lost nor doubled. Stops when the files at hand are done; started again
    with the same `state`, it goes on after the last committed batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        if per_batch:
            per_batch(batch, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def follow(query: StreamingQuery, stopping: Callable[[], bool] = lambda: False, poll: float = 0.2) -> bool:
    """Wait for a stream; True if it came to its end, False if it was stopped. A stream that died raises its error (STR-2).

    What was committed before a stop stays, and a stream started again goes on behind it.
    """
    while not query.awaitTermination(poll):
        if stopping():
            query.stop()
            return False
    if query.exception() is not None:
        raise RuntimeError(f"the stream ended unexpectedly: {query.exception()}")
    return True


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log's rows, each once per (key, unit, chunk, line)."""
    return spark.read.parquet(log).drop("batch").dropDuplicates(["key", "unit", "chunk", "line_no"])


def progress(log: DataFrame) -> DataFrame:
    """Committed chunks of each unit and the seconds of speech in them (AGG-14)."""
    return log.groupBy("key", "unit").agg(F.countDistinct("chunk").alias("chunks"), F.sum(F.col("end") - F.col("start")).alias("speech"))


def live_turns(stream: DataFrame, pause: str = "1 second", lateness: str = "1 hour") -> DataFrame:
    """Spoken stretches per key and speaker from a stream of rows with an event time ``at``.

    Session windows close `pause` after the last row; rows later than `lateness` are dropped.
    """
    s = stream.withWatermark("at", lateness).groupBy("key", "speaker", F.session_window("at", pause).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("segments"), F.min("start").alias("start"), F.max("end").alias("end"))


def playback_clock(lines: DataFrame) -> DataFrame:
    """token, seconds: the latest position that a player wrote for its current file (STR-8).

    `lines`: token (of the file that was started), line_no, line. Positions stand in
    front of a mark like A-V: or M-A:; lines without one tell nothing.
    """
    at = lines.select("token", "line_no", F.regexp_extract("line", r"(\d+\.\d+)\s+[AM]-[AV]:", 1).alias("at")).where("at <> ''")
    return at.groupBy("token").agg(F.max_by("at", "line_no").cast("double").alias("seconds"))


def tell(stream: DataFrame, told: Callable[[str], None], state: str) -> StreamingQuery:
    """Hand every row of a stream of events to a callable on the driver, as JSON and in order of ``at``; one micro-batch at a time (SNK-15, STR-10)."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("at").select(F.to_json(F.struct(*batch.columns)).alias("j")).toLocalIterator():
            told(r["j"])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Tells a callable how far a stream is: (batches done, rows of the last one) after each commit (UDF-6)."""

    def __init__(self, told: Callable[[int, int], None]):
        self.told = told

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.told(event.progress.batchId + 1, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
