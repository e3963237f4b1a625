"""Percentiles with bounded relative rank error, mergeable across partitions and days.

A sketch holds levels of values; one value of level h stands for 2**h values. A
level that is full is compacted: of its values nearest to the unprotected end,
sorted, every other one moves a level up. The values nearest to the protected
end (here the largest) are never compacted at that level, so the error of a rank
is a fraction of its distance from that end: extreme percentiles stay sharp. The
size of the section that is compacted follows how often its level was compacted.
To protect both tails, two sketches are kept, one of the negated values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a section (even). The bound below is for this k.
K = 64


SECTIONS = 3


def error_bound(q: float, k: int = K) -> float:
    """Three standard deviations of the rank error at quantile `q`, as a share of all ranks.

    The standard deviation is sqrt(0.0512 / 3) / k of the distance from the nearer
    tail (the figure that the published analysis of such sketches ends in).
    """
    return 3 * float(np.sqrt(0.0512 / SECTIONS)) / k * min(q, 1 - q)


class Compactors:
    """Relative-rank compactors that protect the largest values.

    levels: the values of each level; shape: per level the number of compactions, of
    sections and the section size. A level holds up to 2 * sections * size values.
    """

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.n, self.seed = k, 0, seed
        self.coins: dict[int, int] = {}
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.shape: list[list[int]] = [[0, SECTIONS, k]]

    def add(self, values: np.ndarray) -> None:
        """Values that are no NaN."""
        self.n += len(values)
        for i in range(0, len(values), 4096):
            self.levels[0] = np.concatenate([self.levels[0], values[i : i + 4096]])
            self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= 2 * self.shape[h][1] * self.shape[h][2]:
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        done, sections, size = self.shape[h]
        x = np.sort(self.levels[h])
        # the n-th compaction takes one section more than n has trailing ones, so that sections
        # far from the protected end are compacted most often; half of the level is never touched
        take = min(sections, (~done & (done + 1)).bit_length())
        m = len(x) - (sections * size + (sections - take) * size)
        m -= m % 2
        if h + 1 == len(self.levels):
            self.levels.append(np.empty(0))
            self.shape.append([0, SECTIONS, self.k])
        # a coin for each pair of compactions, the same on every run; the second of a pair takes the other places
        coin = self.coins[h] = self.coins[h] ^ 1 if done % 2 else zlib.crc32(struct.pack("<qqqq", self.seed, h, done, self.n)) >> 5 & 1
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], x[:m][coin::2]])
        self.levels[h] = x[m:]
        self.shape[h][0] += 1
        if done + 1 >= 1 << (sections - 1) and size > 8:  # the more it was compacted, the finer its sections
            self.shape[h][1:] = [2 * sections, max(4, 2 * round(size / 2**0.5 / 2))]

    def merge(self, other: Compactors) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.shape.append([0, SECTIONS, self.k])
        for h, x in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], x])
            a, b = self.shape[h], other.shape[h]
            self.shape[h] = [a[0] | b[0], *(a[1:] if a[1] >= b[1] else b[1:])]
            self.shape[h][0] &= ~1  # the next compaction tosses a new coin
        self.n += other.n
        self._settle()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order, and how many values there are up to each."""
        x = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        by = np.argsort(x, kind="stable")
        return x[by], np.cumsum(w[by])

    def value(self, rank: float) -> float:
        """The value at a rank from 1 to n."""
        x, w = self.weighted()
        return float(x[min(len(x) - 1, int(np.searchsorted(w, rank)))])

    def pack(self) -> bytes:
        head = struct.pack("<iqqi", self.k, self.n, self.seed, len(self.levels))
        return head + b"".join(struct.pack("<qiii", *s, len(x)) + x.astype("<f8").tobytes() for s, x in zip(self.shape, self.levels))

    @staticmethod
    def unpack(data: bytes, at: int = 0) -> tuple[Compactors, int]:
        k, n, seed, count = struct.unpack_from("<iqqi", data, at)
        at += 24
        out = Compactors(k, seed)
        out.n, out.levels, out.shape = n, [], []
        for _ in range(count):
            *shape, m = struct.unpack_from("<qiii", data, at)
            at += 20
            shape[0] &= ~1
            out.levels.append(np.frombuffer(data, "<f8", m, at).copy())
            out.shape.append(shape)
            at += 8 * m
        return out, at


class Sketch:
    """Both tails protected: compactors of the values and of their negatives."""

    def __init__(self, k: int = K, seed: int = 0):
        self.high, self.low = Compactors(k, seed), Compactors(k, seed + 1)
        self.least, self.most = np.inf, -np.inf

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.high.add(values)
            self.low.add(-values)
            self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))

    def merge(self, other: Sketch) -> None:
        self.high.merge(other.high)
        self.low.merge(other.low)
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)

    def quantile(self, q: float) -> float:
        """The smallest value with a share of at least q at or below it (within the bound)."""
        n = self.high.n
        if q <= 0 or q >= 1:
            return self.least if q <= 0 else self.most
        rank = max(1, int(np.ceil(q * n - 1e-9)))
        return self.high.value(rank) if q >= 0.5 else -self.low.value(n - rank + 1)

    def pack(self) -> bytes:
        return struct.pack("<dd", self.least, self.most) + self.high.pack() + self.low.pack()

    @staticmethod
    def unpack(data: bytes) -> Sketch:
        out = Sketch()
        out.least, out.most = struct.unpack_from("<dd", data)
        out.high, at = Compactors.unpack(data, 16)
        out.low, _ = Compactors.unpack(data, at)
        return out


def sketch(df: DataFrame, group: list[str], values: list[str], k: int = K) -> DataFrame:
    """One sketch per group and value column: the group columns, ``metric``, ``part``, ``sketch``.

    Each partition sketches its rows where they lie (no shuffle); `part` is the
    partition. Nulls and NaNs are left out; a group column may be null (a group of
    its own). Rows of these tables may be kept, added to others (other days, other
    partitions) and merged by ``merged``.
    """
    cols = df.select(*group, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    schema = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept: dict[tuple, Sketch] = {}
        types = None
        for b in batches:
            types = types or [b.schema.field(i).type for i in range(len(group))]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(group))))) if group else [()] * b.num_rows
            code: dict[tuple, int] = {}
            which = np.fromiter((code.setdefault(x, len(code)) for x in keys), np.int64, len(keys))
            for j, name in enumerate(values):
                v = b.column(len(group) + j).to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(v)
                v, own = v[ok], which[ok]
                order = np.argsort(own, kind="stable")  # the rows of each group side by side
                v, ends = v[order], np.searchsorted(own[order], np.arange(len(code) + 1))
                for key, c in code.items():
                    if ends[c] < ends[c + 1]:
                        kept.setdefault((name, *key), Sketch(k, part)).add(v[ends[c] : ends[c + 1]])
        rows = [(key, s) for key, s in kept.items() if s.high.n]
        if rows:
            arrays = [pa.array([key[1 + i] for key, _ in rows], types[i]) for i in range(len(group))]
            arrays += [pa.array([key[0] for key, _ in rows]), pa.array([part] * len(rows), pa.int32()), pa.array([s.pack() for _, s in rows])]
            yield pa.RecordBatch.from_arrays(arrays, [*group, "metric", "part", "sketch"])

    return cols.mapInArrow(run, f"{schema + ', ' if schema else ''}metric string, part int, sketch binary")


def merged(sketches: DataFrame, group: list[str], fan_in: int = 64) -> DataFrame:
    """Sketches of any number of partitions or days merged to one per group and metric.

    Three rounds of `fan_in` to one: a group's sketches, told apart by partition and
    by all other columns (days, months), are dealt to fan_in * fan_in slots, the slots
    merged, then every fan_in of them, then the rest. A task has about `fan_in`
    sketches of a group at once as long as it has no more than fan_in to the third.
    """
    other = [c for c in sketches.columns if c not in (*group, "metric", "sketch")]

    def once(df: DataFrame, keys: list[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = None
            for data in pdf["sketch"]:
                one = Sketch.unpack(bytes(data))
                total.merge(one) if total else (total := one)
            return pdf[keys].head(1).assign(sketch=[total.pack()])

        return df.groupBy(*keys).applyInPandas(run, f"{schema}, sketch binary")

    dealt = sketches.select(*group, "metric", (F.pmod(F.xxhash64(*other), F.lit(fan_in * fan_in)) if other else F.lit(0)).cast("int").alias("part"), "sketch")
    slots = once(dealt, [*group, "metric", "part"])
    few = once(slots.withColumn("part", F.expr(f"part div {fan_in}")), [*group, "metric", "part"])
    return once(few, [*group, "metric"])


def percentiles(sketches: DataFrame, group: list[str], qs: list[float], k: int = K) -> DataFrame:
    """Group columns, metric, q, n, value and max_rank_error (ranks) of merged sketches.

    value: a value whose rank differs from that of the exact one (the smallest with
    a share of at least q at or below it) by at most max_rank_error, with three
    standard deviations (a probability of about 99.7 % each); max_rank_error is
    `error_bound(q)` * n, rounded up. Groups without values have no rows.
    """
    schema = ", ".join(f"`{g}` {sketches.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                s = Sketch.unpack(bytes(r["sketch"]))
                n = s.high.n
                out += [[*(r[g] for g in group), r["metric"], q, n, s.quantile(q), float(np.ceil(error_bound(q, k) * n))] for q in qs]
            yield pd.DataFrame(out, columns=[*group, "metric", "q", "n", "value", "max_rank_error"])

    return sketches.mapInPandas(run, f"{schema + ', ' if schema else ''}metric string, q double, n long, value double, max_rank_error double")
