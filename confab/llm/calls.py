"""Rows of calls in time order, each call's tracks in front, as one global order.

Tracks are not joined to the rows (a join on call_id sends a hot call to one
task): they are sorted in with them, so that a scan meets a call's tracks just
before its rows. A partition that starts within a call gets that call's tracks
by a look-up of as many calls as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.labels import Roster
from confab.operators import rangescan

#: The columns of the global order; `row` is idx for a track and the row's own key else.
KEYS = ("call_id", "kind", "start", "row")


def ordered_with_tracks(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """`rows` (call_id, start, row, label, others) and `tracks` (call_id, idx, title) in global order."""
    t = tracks.where(F.col("call_id").isNotNull() & F.col("idx").isNotNull()).select(
        "call_id", F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("start"), F.col("idx").cast("long").alias("row"), F.col("title").alias("label")
    )
    r = rows.withColumn("kind", F.lit(1).cast("byte"))
    both = r.unionByName(t, allowMissingColumns=True)
    return rangescan.sort_globally(both.select(*KEYS, *[c for c in both.columns if c not in KEYS]), *KEYS)


def heads(ordered: DataFrame, tracks: DataFrame) -> dict[int, dict[str, list]]:
    """Per partition, the tracks of the call it starts in."""

    def first(batches: Iterator[pa.RecordBatch]):
        got = None
        for b in batches:  # the rest must be read too: the JVM side writes it
            if got is None and b.num_rows:
                got = b.column(0)[0].as_py()
        return got

    calls = dict(rangescan.summaries(ordered.select("call_id"), first))
    known: dict[str, list] = {}
    if calls:  # at most one call for each partition, looked up in one pass
        wanted = tracks.sparkSession.createDataFrame([(c,) for c in sorted(set(calls.values()))], "call_id string")
        for r in tracks.join(F.broadcast(wanted), "call_id", "left_semi").select("call_id", "idx", "title").distinct().collect():
            known.setdefault(r[0], []).append((r[1], r[2]))
    return {pid: {c: known.get(c, [])} for pid, c in calls.items()}


class Rosters:
    """Keeps the roster of the call a scan stands in."""

    def __init__(self, start: dict[str, list]):
        self.call, self.tracks = next(iter(start.items()), (None, []))
        self.tracks, self.made = list(self.tracks), None

    def at(self, call: str) -> Roster:
        if call != self.call:
            self.call, self.tracks, self.made = call, [], None
        if self.made is None:
            self.made = Roster(self.tracks)
        return self.made

    def add(self, call: str, idx: int, title: str | None) -> None:
        if call != self.call:
            self.call, self.tracks = call, []
        self.tracks.append((idx, title))
        self.made = None
