"""Continuous periods and gaps of overlapping intervals, per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators import rangescan


def _batch(batch: pa.RecordBatch, state: tuple | None):
    """One sorted batch: where islands start, the furthest end before each row, the state after it.

    state: (entity, start of the open island, furthest end so far).
    """
    key, start, end = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    n = len(start)
    first = np.ones(n, bool)
    if n > 1:
        first[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    same = state is not None and key[0].as_py() == state[0]
    first[0] = not same
    before = rangescan.furthest_before(end, first, state[2] if same else None)
    opens = first | (start > before)
    last = int(np.flatnonzero(opens)[-1]) if opens.any() else None
    label = int(start[last]) if last is not None else state[1]
    furthest = int(max(before[-1], end[-1])) if not first[-1] else int(end[-1])
    return key, start, end, first, before, opens, (key[n - 1].as_py(), label, furthest)


def _summary(batches: Iterator[pa.RecordBatch]):
    head, state = None, None
    for b in batches:
        if b.num_rows:
            head = head or (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            state = _batch(b, state)[-1]
    return head and (head, state)


def _combine(records: list) -> dict[int, tuple]:
    """Prefix fold of the partitions' summaries: the state before and the row after each."""
    around, state = {}, None
    for i, (pid, (head, tail)) in enumerate(records):
        around[pid] = (state, records[i + 1][1][0] if i + 1 < len(records) else None)
        if state and head[0] == tail[0] == state[0] and state[2] >= tail[1]:
            tail = (tail[0], state[1], max(state[2], tail[2]))  # all of the partition lies within the open island
        elif state and head[0] == tail[0] == state[0]:
            tail = (tail[0], tail[1], max(state[2], tail[2]))
        state = tail
    return around


def _rows(keys: list, kinds: list, starts: list, ends: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["entity", "kind", "start", "end"]
    )


def _scan(max_gap: int | None):
    def scan(batches: Iterator[pa.RecordBatch], state: tuple | None, after: tuple | None) -> Iterator[pa.RecordBatch]:
        kind = pa.string()
        carried = state is not None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field(0).type
            old = state
            key, start, end, first, before, opens, state = _batch(b, old)
            at = np.flatnonzero(opens)
            keys, kinds, starts, ends = [], [], [], []
            if len(at):
                k = key.take(pa.array(at)).to_pylist()
                # the island before at[j] starts at at[j-1] (at[0]: in the state) and ends where the furthest end stood
                prev_key = [old[0] if old else None, *k[:-1]]
                prev_start = [old[1] if old else None, *start[at[:-1]].tolist()]
                reach = before[at].tolist()
                for j, i in enumerate(at.tolist()):
                    if carried and i == 0:
                        pass  # the island carried in ended with its partition, which has listed it
                    elif prev_key[j] is not None:
                        closed = reach[j] if not first[i] else None
                        if closed is None:  # another entity follows: the furthest end of the rows just before
                            closed = int(max(before[i - 1], end[i - 1])) if i and not first[i - 1] else int(end[i - 1]) if i else old[2]
                        keys.append(prev_key[j]), kinds.append("period"), starts.append(prev_start[j]), ends.append(closed)
                    if not first[i] and (max_gap is None or start[i] - before[i] <= max_gap):
                        keys.append(k[j]), kinds.append("gap"), starts.append(reach[j]), ends.append(int(start[i]))
                yield _rows(keys, kinds, starts, ends, kind)
            carried = False
        if state and (after is None or after[0] != state[0] or after[1] > state[2]):
            yield _rows([state[0]], ["period"], [state[1]], [state[2]], kind)

    return scan


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, max_gap: int | None = None) -> DataFrame:
    """Periods covered by the intervals of each entity, and the gaps between them.

    Returns `entity`, ``kind`` ('period' or 'gap'), ``start``, ``end`` (LONG).
    Intervals that touch belong to one period. A gap longer than `max_gap` (in the
    unit of `start`) is not listed; None lists every gap.

    Rows with a null in `entity`, `start` or `end`, and intervals whose end is not
    after their start, cover nothing and are left out. Repeats and ties change
    nothing. An empty table gives no rows. Other columns, whatever their names,
    are not read.

    Plan: one range shuffle of three columns on (entity, start); a hot entity is
    split by start. Periods that span partitions are stitched by the prefix fold
    of `rangescan`, so no task ever holds an entity as a whole.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    rows = rows.where(F.col("entity").isNotNull() & (F.col("end") > F.col("start")))
    kind = rows.schema["entity"].dataType.simpleString()
    ordered = rangescan.sort_globally(rows, "entity", "start", "end")
    around = _combine(rangescan.summaries(ordered, _summary))
    out = rangescan.rescan(ordered, _scan(max_gap), around, f"entity {kind}, kind string, start long, end long")
    return out.withColumnRenamed("entity", entity)
