"""Scans with carried state over a globally sorted table.

A window function puts all rows of one key into one task, which fails for a key
that holds a third of the table. Here rows are range-partitioned on
(key, order), so a hot key spreads over as many partitions as its rows ask for:

1. ``sort_globally``: one range shuffle, sorted within partitions, checkpointed;
2. ``summaries``: every partition yields one small record (the state at its end
   as if nothing preceded it, and the row it starts with);
3. the caller combines these records in partition order on the driver: a prefix
   fold over as many records as there are partitions, whatever the row count;
4. ``rescan``: every partition runs again with the state that precedes it and
   the row that follows it.

Scans stream over Arrow batches and hold one batch and the state at a time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from confab.session import checkpointed

#: Types: a scan takes (batches, state before, row after) and yields record batches;
#: a summary takes batches and returns a picklable record or None for no rows.
Summary = Callable[[Iterator[pa.RecordBatch]], Any]
Scan = Callable[[Iterator[pa.RecordBatch], Any, Any], Iterator[pa.RecordBatch]]


#: Bytes of input, as it is stored, for one partition of a global order.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame) -> int | None:
    """How many partitions `df` needs for PARTITION_BYTES of its inputs each; None if the session's shuffle partitions do (AQE may then join small ones).

    The sizes are those of what the plan reads: Catalyst's estimate of a join is the
    product of its sides, which says nothing here. Sizes that are not known are
    enormous and count as none.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    need = math.ceil(sum(b for b in sizes if b < 1 << 56) / PARTITION_BYTES)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def sort_globally(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in global order of `keys`; equal keys are never split between partitions.

    As many partitions as the session's shuffle partitions, or as the size of `df`
    asks for if those are more.
    """
    n = partitions_for(df)
    by = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    return checkpointed(by.sortWithinPartitions(*keys))


def summaries(sorted_df: DataFrame, summary: Summary) -> list[tuple[int, Any]]:
    """(partition id, summary) of each partition that has rows, in order.

    One record per partition reaches the driver: its number is that of the
    partitions and its size that of one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = summary(batches)
        if got is not None:
            yield pa.RecordBatch.from_pydict(
                {"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "state": pa.array([pickle.dumps(got)], pa.binary())}
            )

    rows = sorted_df.mapInArrow(run, "pid int, state binary").collect()
    return sorted((r["pid"], pickle.loads(bytes(r["state"]))) for r in rows)


def furthest_before(end: np.ndarray, first: np.ndarray, carried: int | None) -> np.ndarray:
    """The greatest of the values before each row since the last row with `first`; `carried` stands before row 0.

    Values of rows with `first`, and of row 0 without `carried`, are undefined. Groups
    are lifted above each other, so that one running maximum serves all of them.
    """
    group = np.cumsum(first)
    low, high = int(end.min()), int(end.max())
    if carried is not None:
        low, high = min(low, carried), max(high, carried)
    lift = high - low + 1
    before = np.empty(len(end), np.int64)
    if lift * (int(group[-1]) + 1) < 2**62:
        raised = end - low + group * lift
        before[0] = carried - low + group[0] * lift if carried is not None else 0
        before[1:] = raised[:-1]
        return np.maximum.accumulate(before) - group * lift + low
    for a, z in zip(np.flatnonzero(np.diff(group, prepend=-1)), [*np.flatnonzero(np.diff(group)) + 1, len(end)]):  # values too far apart for that
        before[a] = carried if a == 0 and carried is not None else end[a]
        before[a + 1 : z] = np.maximum.accumulate(np.append(before[a], end[a : z - 1]) if a == 0 and carried is not None else end[a : z - 1])[-(z - a - 1) or z :]
    return before


def rescan(sorted_df: DataFrame, scan: Scan, around: dict[int, tuple[Any, Any]], schema: str) -> DataFrame:
    """`scan` over each partition with (state before, row after) of `around`.

    `around` has one entry per non-empty partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = around.get(TaskContext.get().partitionId(), (None, None))
        yield from scan(batches, before, after)

    return sorted_df.mapInArrow(run, schema)
