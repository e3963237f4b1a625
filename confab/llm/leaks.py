"""Evaluation texts that leaked into a corpus.

Latent semantic retrieval over passages of `width` words:

1. documents become rows of ids of the items' words; what can hold no passage of
   known words is dropped after steps 2 and 3, the rest is written once;
2. document frequencies of the words over all passages of the corpus;
3. a randomised decomposition of the TF-IDF matrix of all passages: each partition
   adds up A'A times a random matrix, whose sum gives the leading right singular
   vectors (in the same single pass, by the Nystroem form of the sketch);
4. every word gets a latent vector in whole numbers; a passage's vector is the sum of
   its words' vectors, so two passages of the same words have exactly the same one,
   and cosine 1. Candidates are the passages of items whose cosine reaches a
   threshold: for equal passages those in the same cell of sign bits, for near ones
   those of every item that shares as many runs of words as the next step takes
   at least, in no cells;
5. candidates are compared word by word: the longest common subsequence must be as
   long as asked for.

Passages are taken at every word of a document. A document that holds `width` words
of an item in a row thus has a passage with cosine 1 to one of the item's, in the
same cell: none is lost for exact leaks. For near ones the rows are those of a
comparison of every passage with every other (same cosine, same subsequence).
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import labels
from confab.session import checkpoint_dir, checkpointed

WIDTH, RANK, BITS, SEED = 12, 16, 16, 7
#: Items go to the executors in blocks of at most so many words; each block is a pass of its own.
BLOCK_WORDS = 2_000_000
#: Ids searched at once, which bounds a task's memory.
SLICE = 100_000
#: Pairs of a place and an item with the same run of words that are looked at at once.
PAIRS = 1_000_000
_WORDS = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


@lru_cache(1 << 18)
def _folded(word: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", labels.fold(word)))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in small letters without accents."""
    if not text:
        return []
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return [w for raw in _WORDS.findall(text) for w in _folded(raw)]


class Items:
    """Passages of the items, by ids of their words."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.width, self.vocabulary = width, {}
        number = self.vocabulary.setdefault
        grams: dict[tuple[int, ...], set[int]] = {}
        for item, text in rows:
            ids = [number(w, len(self.vocabulary)) for w in words(text)]
            for i in range(len(ids) - width + 1):
                grams.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.passages = np.array(list(grams), np.int32).reshape(len(grams), width)
        self.owners = [sorted(x) for x in grams.values()]
        #: Texts, each once, that have passages.
        self.texts = [np.array(t, np.int32) for t in dict.fromkeys(tuple(self.vocabulary[w] for w in words(text)) for _, text in rows) if len(t) >= width]


class Ids(dict):
    """Raw words to ids of the vocabulary; -1: unknown; -2: more than one word."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        parts = _folded(raw)
        if len(self) > 1 << 20:
            self.clear()
        self[raw] = got = self.vocabulary.get(parts[0], -1) if len(parts) == 1 else -2
        return got

    def of(self, text: str) -> np.ndarray:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        raw = _WORDS.findall(text)
        ids = np.fromiter(map(self.__getitem__, raw), np.int32, len(raw))
        if (ids == -2).any():
            ids = np.array([self.vocabulary.get(w, -1) for w in words(text)], np.int32)
        return ids


def _ends(known: np.ndarray, width: int) -> np.ndarray:
    """Starts of the stretches of `width` known words."""
    n = np.concatenate([[0], np.cumsum(known)])
    return np.flatnonzero(n[width:] - n[:-width] == width) if len(known) >= width else np.empty(0, np.int64)


def _known_stretches(ids: np.ndarray, width: int, skip_unknown: bool) -> np.ndarray:
    """The ids without what no passage can hold; -1 where stretches are apart and at the end."""
    if skip_unknown:
        out = ids[ids >= 0]
        return np.append(out, np.int32(-1)) if len(out) >= width else out[:0]
    starts = _ends(ids >= 0, width)
    if not len(starts):
        return ids[:0]
    keep = np.zeros(len(ids) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + width, -1)
    keep = np.cumsum(keep[:-1]) > 0
    gap = keep & ~np.concatenate([[False], keep[:-1]])
    out = np.where(keep, ids, -1)
    return np.append(out[keep | np.concatenate([gap[1:], [False]])], np.int32(-1))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


class Statistics:
    """Document frequencies of the items' words, and T'T times a random matrix, over passages side by side.

    T counts the items' words in the passages of whole texts (other words are in the
    passages, but no columns; a text's last passage may be shorter).
    """

    def __init__(self, size: int, width: int, wide: int, seed: int):
        self.size, self.width, self.passages, self.held, self.many = size, width, 0, [], 0
        self.omega = np.append(_omega(size, wide, seed), np.zeros((1, wide), np.float32), axis=0)
        self.df, self.y = np.zeros(size + 1, np.int64), np.zeros((size + 1, wide))

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        self.passages += -(-len(ids) // self.width)
        for i in range(0, len(ids), 10_000 * self.width):
            part = ids[i : i + 10_000 * self.width]
            self.held += [part, np.full(-len(part) % self.width, -1, np.int32)]
            self.many += len(part)
            if self.many >= 10_000 * self.width:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        flat = np.concatenate(self.held)
        flat[flat < 0] = self.size
        part = flat.reshape(-1, self.width)
        sketch = self.omega[part[:, 0]].copy()
        for j in range(1, self.width):
            sketch += self.omega[part[:, j]]
        order = np.argsort(flat, kind="stable")
        order = order[: np.count_nonzero(flat < self.size)]
        flat, passage = flat[order], order // self.width
        if len(flat):
            other = flat[1:] != flat[:-1]
            first = np.flatnonzero(np.concatenate([[True], other]))
            self.df += np.bincount(flat[np.concatenate([[True], other | (passage[1:] != passage[:-1])])], minlength=self.size + 1)
            self.y[flat[first]] += np.add.reduceat(sketch[passage], first, axis=0)
        self.held, self.many = [], 0


def _omega(size: int, wide: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _summed(rows: DataFrame, size: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency of each word over all passages of the corpus, and T'T times the random matrix."""
    sums = F.array(*(F.sum(F.col("y")[c]) for c in range(wide))).alias("y")
    df, y, n = np.zeros(size), np.zeros((size, wide)), 0
    for r in rows.groupBy("word").agg(F.sum("df").alias("df"), sums).collect():  # the items' vocabulary at most
        if r["word"] < 0:
            n = r["df"]
        else:
            df[r["word"]], y[r["word"]] = r["df"], r["y"]
    return np.log((1 + n) / (1 + df)) + 1, y


def _latent(y: np.ndarray, idf: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """A whole-number latent vector for each word."""
    # A = T D with the weights D: D (T'T Omega) is A'A times the random matrix D^-1 Omega, so one pass does for both
    omega = _omega(*y.shape, seed) / idf[:, None]
    y = idf[:, None] * y
    # A'A ~ Y (Omega'Y)^-1 Y': its leading eigenvectors are the right singular vectors
    shift = np.finfo(float).eps * np.linalg.norm(y) + 1e-9
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    x = idf[:, None] * u[:, :rank]
    return np.rint(x / np.abs(x).max() * (1 << 20)).astype(np.int64)


class Search:
    """The items' passages by cells of sign bits."""

    def __init__(self, items: Items, latent: np.ndarray, bits: int, least_cosine: float):
        self.items, self.latent, self.least = items, latent, least_cosine
        vectors = latent[items.passages].sum(axis=1)
        self.center = np.median(vectors, axis=0).astype(np.int64)
        self.bits = min(bits, latent.shape[1])
        self.narrow = np.ascontiguousarray(latent[:, : self.bits].T.astype(np.int32))
        cells = self._cells(vectors)
        self.order = np.argsort(cells, kind="stable")
        self.start = np.searchsorted(cells[self.order], np.arange((1 << self.bits) + 1))
        self.full = np.diff(self.start) > 0
        v = vectors.astype(float)
        self.unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]

    def _cells(self, vectors: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(vectors), np.int64)
        for c in range(self.bits):
            cell |= (vectors[:, c] > self.center[c]).astype(np.int64) << c
        return cell

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of a passage in ids, item passage) of all pairs of one cell that reach the cosine."""
        width = self.items.width
        starts = _ends(ids >= 0, width)
        if not len(starts):
            return starts, starts
        # whole numbers wrap around alike in every sum, so that differences are exact; unknown words cancel out
        cell = np.zeros(len(starts), np.int64)
        for c in range(self.bits):
            sums = np.cumsum(self.narrow[c][ids], dtype=np.int32)
            sums = np.concatenate([[np.int32(0)], sums])
            cell |= ((sums[starts + width] - sums[starts]) > self.center[c]).astype(np.int64) << c
        hit = np.flatnonzero(self.full[cell])
        a, z = self.start[cell[hit]], self.start[cell[hit] + 1]
        n = z - a
        place = np.repeat(hit, n)
        other = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        keep_place, keep_other = [], []
        for i in range(0, len(place), 20_000):
            p, o = place[i : i + 20_000], other[i : i + 20_000]
            v = self.latent[ids[starts[p][:, None] + np.arange(width)]].sum(axis=1).astype(float)
            cosine = np.einsum("ij,ij->i", v, self.unit[o]) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
            # equal words count whatever is left of their vectors by rounding
            near = (cosine >= self.least) | (ids[starts[p][:, None] + np.arange(width)] == self.items.passages[o]).all(axis=1)
            keep_place.append(p[near]), keep_other.append(o[near])
        return starts[np.concatenate(keep_place or [hit])], np.concatenate(keep_other or [hit])


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the `k` words at each place."""
    n = max(len(ids) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (ids[j : j + n].astype(np.int64) + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _spans(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """a, a + 1, ... of `n` numbers each, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


class Near:
    """The items' passages by runs of words, for passages with at least `need` words in common in the same order.

    Such passages drop d = width - need words each, so what they have in common is at
    most 2 d + 1 runs without a gap in either, and of runs of k words at least
    need - (2 d + 1)(k - 1). A passage and an item with fewer can't match, whatever
    their cosine; all others are compared. Equal hashes only add comparisons.
    """

    def __init__(self, items: Items, latent: np.ndarray, least_cosine: float, need: int):
        self.items, self.latent, self.least, self.need = items, latent, least_cosine, need
        width = items.width
        pieces = 2 * (width - need) + 1
        self.k = max(k for k in range(1, width + 1) if k == 1 or need - pieces * (k - 1) >= k)
        self.least_runs = need - pieces * (self.k - 1)
        number = {tuple(p): i for i, p in enumerate(items.passages.tolist())}
        own = [np.unique([number[tuple(w)] for w in np.lib.stride_tricks.sliding_window_view(t, width).tolist()]) for t in items.texts]
        self.passages = np.concatenate(own)
        self.first = np.cumsum([0, *map(len, own)])
        hashes = [np.unique(_runs(t, self.k)) for t in items.texts]
        text = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.texts = text[order]
        self.runs, self.start = np.unique(every[order], return_index=True)
        self.start = np.append(self.start, len(every))
        v = latent[items.passages].sum(axis=1).astype(float)
        self.unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]

    def _pairs(self, at: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, text) of the passages with enough runs, from (place of a run, text), each once."""
        order = np.lexsort((at, texts))
        at, texts, far = at[order], texts[order], self.least_runs - 1
        a, z = at[: len(at) - far], at[far:]
        reach = self.items.width - self.k
        ok = np.flatnonzero((z - a <= reach) & (texts[: len(at) - far] == texts[far:]))
        start = _spans(z[ok] - reach, a[ok] - z[ok] + reach + 1)
        text = np.repeat(texts[ok], a[ok] - z[ok] + reach + 1)
        key = np.unique(text * (1 << 40) + start + self.items.width)
        return (key & ((1 << 40) - 1)) - self.items.width, key >> 40

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of a passage in ids, item passage) of all pairs that reach the cosine and the common words."""
        width, none = self.items.width, np.empty(0, np.int64)
        whole = np.zeros(len(ids) + 1, bool)
        whole[_ends(ids >= 0, width)] = True
        hashes = _runs(ids, self.k)
        place = np.searchsorted(self.runs, hashes).clip(0, len(self.runs) - 1)
        hit = np.flatnonzero(self.runs[place] == hashes)
        n = self.start[place[hit] + 1] - self.start[place[hit]]
        # places in parts of about PAIRS pairs; each part also sees the runs that its first passages hold
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), PAIRS)), len(hit)))
        found = []
        for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low = hit[u] - (width - self.k) if u else -width
            high = hit[v] - (width - self.k) if v < len(hit) else len(ids)
            part = slice(np.searchsorted(hit, low), v)
            at = np.repeat(hit[part], n[part])
            start, text = self._pairs(at, self.texts[_spans(self.start[place[hit[part]]], n[part])])
            keep = (start >= max(low, 0)) & (start < high)
            start, text = start[keep], text[keep]
            start, text = start[whole[start]], text[whole[start]]
            for i in range(0, len(start), 2_000):
                s, t = start[i : i + 2_000], text[i : i + 2_000]
                m = self.first[t + 1] - self.first[t]
                found.append(self._compare(ids, np.repeat(s, m), self.passages[_spans(self.first[t], m)]))
        if not found:
            return none, none
        # a passage may stand in several texts
        p, o = (np.concatenate(x) for x in zip(*found))
        key = np.unique(p * len(self.items.passages) + o)
        return key // len(self.items.passages), key % len(self.items.passages)

    def _compare(self, ids: np.ndarray, p: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep_p, keep_o = [p[:0]], [o[:0]]
        for i in range(0, len(p), 20_000):
            a, b = p[i : i + 20_000], o[i : i + 20_000]
            w = ids[a[:, None] + np.arange(self.items.width)]
            v = self.latent[w].sum(axis=1).astype(float)
            size = np.linalg.norm(v, axis=1)
            near = np.einsum("ij,ij->i", v, self.unit[b]) >= self.least * size
            near[near] = commons(w[near], self.items.passages[b[near]]) >= self.need
            keep_p.append(a[near]), keep_o.append(b[near])
        return np.concatenate(keep_p), np.concatenate(keep_o)


def commons(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`common` of each two rows."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for j in range(a.shape[1]):
        match = row[:, :-1] + (b == a[:, j : j + 1])
        np.maximum(row[:, 1:], match, out=row[:, 1:])
        np.maximum.accumulate(row, axis=1, out=row)
    return row[:, -1]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a.tolist():
        match = np.concatenate([[0], row[:-1] + (b == x)])
        row = np.maximum.accumulate(np.maximum(row, match))
    return int(row[-1])


def leaked(documents: DataFrame, items: DataFrame, width: int = WIDTH, share: float = 1.0, least_cosine: float = 1 - 1e-9, skip_unknown: bool = False, rank: int = RANK, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, item_id and ``passages`` (of the document that match one of the item's), one row a pair.

    `documents`: doc_id, text. `items`: item_id, ref_text. A document matches an item
    if a passage of `width` consecutive words has at least share * width words in
    common with one of the item's, in the same order, and a latent cosine of at least
    `least_cosine`. With share 1 these are exactly the pairs that have `width` words
    in a row in common. With smaller values near copies are found too: all that a
    comparison of every two passages finds. With `skip_unknown`, words that no item has are passed over, so that leaks with words
    mixed in are found.

    Words are runs of letters and digits, without case and accents. Null and empty
    texts match nothing, nor do items of fewer than `width` words. Null ids are keys
    like others. Repeated rows add up their passages. Other columns are not read.

    Plan: no text is shuffled. Items go to the executors in blocks of at most
    BLOCK_WORDS words; beyond one block each block is a pass. What the driver gathers
    has the size of the items' vocabulary.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, passages long"
    out = None
    for block in _blocks(items):
        own = Items(block, width)
        if not len(own.passages):
            continue

        wide = min(rank + 8, len(own.vocabulary))

        def ids(batches: Iterator[pa.RecordBatch], vocabulary=own.vocabulary, wide=wide) -> Iterator[pa.RecordBatch]:
            number, seen = Ids(vocabulary), Statistics(len(vocabulary), width, wide, seed)
            names, key = ["doc_id", "ids", "word", "df", "y"], pa.null()
            for b in batches:
                rows, lists, ends = [], [], [0]
                for i, t in enumerate(b.column(1).to_pylist()):
                    x = number.of(t) if t else ()
                    seen.add(x)
                    x = _known_stretches(x, width, skip_unknown) if t else ()
                    if len(x):
                        rows.append(i)
                        lists.append(x)
                        ends.append(ends[-1] + len(x))
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                key = b.column(0).type
                none = (pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))), *none], names)
            seen.flush()
            if seen.passages:
                at = np.flatnonzero(seen.df)
                counts = pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen.df[at], seen.passages)), pa.array([*seen.y[at].tolist(), None], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at) + 1, key), pa.nulls(len(at) + 1, pa.list_(pa.int32())), *counts], names)

        place = f"{checkpoint_dir(spark)}/passages-{uuid.uuid4()}"
        documents.select("doc_id", "text").mapInArrow(ids, f"doc_id {kind}, ids array<int>, word int, df long, y array<double>").write.parquet(place)
        written = spark.read.parquet(place)
        rows = written.where("ids is not null").select("doc_id", "ids")
        idf, y = _summed(written.where("word is not null").select("word", "df", "y"), len(own.vocabulary), wide)
        latent = _latent(y, idf, rank, seed)

        def match(batches: Iterator[pa.RecordBatch], own=own, latent=latent) -> Iterator[pa.RecordBatch]:
            need = int(np.ceil(share * width - 1e-9))
            search = Search(own, latent, bits, least_cosine) if need == width else Near(own, latent, least_cosine, need)
            for b in batches:
                every, offsets = _lists(b.column(1))
                found: dict[tuple[int, int], int] = {}
                # some rows at once, as many as SLICE ids: rows end in -1, so no passage spans two
                cuts = np.unique(np.searchsorted(offsets, np.arange(0, len(every) + SLICE, SLICE), side="left").clip(0, len(offsets) - 1))
                for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    flat = every[offsets[u] : offsets[v]]
                    at, other = search.candidates(flat)
                    same = np.ones(len(at), bool) if need < width else (flat[at[:, None] + np.arange(width)] == own.passages[other]).all(axis=1)
                    row = np.searchsorted(offsets, at[same] + offsets[u], side="right") - 1
                    seen: dict[tuple[int, int], set[int]] = {}
                    for i, p, o in zip(row.tolist(), at[same].tolist(), other[same].tolist()):
                        for item in own.owners[o]:
                            seen.setdefault((i, item), set()).add(p)
                    found |= {key: len(places) for key, places in seen.items()}
                if found:
                    key = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, pa.array([m for _, m in found]), pa.array(list(found.values()), pa.int64())], ["doc_id", "item_id", "passages"])

        # the pairs are written, so that the ids, which are half the size of the texts, can go
        one = checkpointed(rows.mapInArrow(match, schema).groupBy("doc_id", "item_id").agg(F.sum("passages").alias("passages")))
        _delete(spark, place)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.sum("passages").alias("passages"))  # texts of one item may be in two blocks


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_WORDS words, one of which is held at a time."""
    block: list[tuple[int, str]] = []
    weight = 0
    for r in items.select("item_id", "ref_text").where("ref_text is not null").distinct().toLocalIterator():
        n = len(words(r["ref_text"]))
        if weight + n > BLOCK_WORDS and block:
            yield block
            block, weight = [], 0
        block.append((r["item_id"], r["ref_text"]))
        weight += n
    yield block


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
