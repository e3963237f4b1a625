"""Runs of consecutive events of one speaker, collapsed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.calls import Rosters, heads, ordered_with_tracks
from confab.operators import rangescan

_OUT = pa.schema([("call_id", pa.string()), ("track_idx", pa.int32()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("events", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("duration_ms", pa.int64())])
# A run: call, track, first seq, last seq, events, start, furthest end.
Run = tuple


def _runs(batch: pa.RecordBatch, rosters: Rosters, last: tuple | None) -> list[Run]:
    """Runs of one sorted batch. `last`: (call, seq) of the row before, to see repeats.

    Run starts are gathered into a sorted array of positions; each event finds its
    run by binary search in it.
    """
    calls, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    seqs, labels = batch.column(3).to_numpy(), batch.column(4).to_pylist()
    keep, track = [], []
    for i, call in enumerate(calls):
        if kinds[i] == 0:
            rosters.add(call, int(seqs[i]), labels[i])
        elif (call, seqs[i]) != last:  # a repeat has the same start, so it stands next to its like
            last = (call, seqs[i])
            keep.append(i)
            track.append(rosters.at(call).key(labels[i]))
    if not keep:
        return []
    at = np.array(keep)
    call, who = np.array(calls, object)[at], np.array(track, np.int64)
    seq, start, end = seqs[at], batch.column(2).to_numpy()[at], batch.column(5).to_numpy()[at]
    turn = np.ones(len(at), bool)
    turn[1:] = (call[1:] != call[:-1]) | (who[1:] != who[:-1])
    starts = np.flatnonzero(turn)
    run_of = np.searchsorted(starts, np.arange(len(at)), side="right") - 1
    n = np.bincount(run_of)
    reach = np.maximum.reduceat(end, starts)
    ends = np.append(starts[1:], len(at)) - 1
    return list(zip(call[starts].tolist(), who[starts].tolist(), seq[starts].tolist(), seq[ends].tolist(), n.tolist(), start[starts].tolist(), reach.tolist()))


def _join(a: Run, b: Run) -> Run | None:
    """One run of two neighbours of the same call and track."""
    return (*a[:3], b[3], a[4] + b[4], a[5], max(a[6], b[6])) if a[:2] == b[:2] else None


def _stream(batches: Iterator[pa.RecordBatch], rosters: Rosters, run: Run | None) -> Iterator[list[Run]]:
    """Closed runs, batch by batch; the last list holds the run left open (or nothing)."""
    for b in batches:
        found = _runs(b, rosters, run and (run[0], run[3]))
        if found:
            if run and (one := _join(run, found[0])):
                found[0] = one
            elif run:
                found.insert(0, run)
            run = found.pop()
            yield found
    yield [run] if run else []


def collapse_runs(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each maximal run of consecutive events of one speaker in a call as one row.

    `events`: call_id, seq, speaker, start_ms, end_ms. `tracks`: call_id, idx, title.
    Returns call_id, track_idx, first_seq, last_seq, events, start_ms, end_ms (the
    furthest), duration_ms. Runs of a single event are listed too.

    Order is (start_ms, seq) within a call. Labels are near-identical if they stand
    for the same track (`labels.Roster`); labels that stand for no track are
    compared as folded text, and track_idx is then null. Rows that repeat a key
    (call_id, seq) with the same start count once. Rows with a null call_id, seq or
    start_ms are left out; a null end counts as the start; null labels form runs of
    their own. Empty tables give no rows; other columns are not read.

    Plan: one range shuffle on (call_id, start, seq), so a hot call is spread; runs
    that cross partitions are joined by a prefix fold of one record a partition.
    """
    rows = events.where(F.col("call_id").isNotNull() & F.col("seq").isNotNull() & F.col("start_ms").isNotNull()).select(
        "call_id", F.col("start_ms").alias("start"), F.col("seq").cast("long").alias("row"), F.col("speaker").alias("label"), F.coalesce("end_ms", "start_ms").alias("end")
    )
    ordered = ordered_with_tracks(rows, tracks).fillna({"end": 0})
    begin = heads(ordered, tracks)

    def summary(batches: Iterator[pa.RecordBatch]):
        """First and last run as if alone (the same if there is one), of rows that aren't tracks."""
        first = last = None
        n = 0
        for found in _stream(batches, Rosters(begin.get(TaskContext.get().partitionId(), {})), None):
            for run in found:
                first, last, n = first or run, run, n + 1
        return first and (first, last, n)

    records = rangescan.summaries(ordered, summary)
    around, run = {}, None
    for i, (pid, (first, last, n)) in enumerate(records):
        around[pid] = (run, records[i + 1][1][0] if i + 1 < len(records) else None)
        run = (run and n == 1 and _join(run, last)) or last

    def scan(batches: Iterator[pa.RecordBatch], before: Run | None, after: Run | None) -> Iterator[pa.RecordBatch]:
        held, fresh = [], True
        for found in _stream(batches, Rosters(begin.get(TaskContext.get().partitionId(), {})), before):
            held += found
            if fresh and held:
                fresh = False
                if held[0] == before:  # not gone on with here: listed by the partition it ended in
                    held.pop(0)
            if len(held) > 1:
                yield _table(held[:-1])
                held = held[-1:]
        if held and not (after and held[0][:2] == after[:2]):
            yield _table(held)

    return rangescan.rescan(ordered, scan, around, "call_id string, track_idx int, first_seq long, last_seq long, events long, start_ms long, end_ms long, duration_ms long")


def _table(runs: list[Run]) -> pa.RecordBatch:
    rows = [{"call_id": c, "track_idx": t if t >= 0 else None, "first_seq": a, "last_seq": z, "events": n, "start_ms": s, "end_ms": e, "duration_ms": e - s} for c, t, a, z, n, s, e in runs]
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)
