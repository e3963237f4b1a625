"""Oversized texts cut into pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 120
#: Kinds of boundary, coarsest first, and the penalty of a cut at one.
UNITS = ("line", "sentence", "word", "none")
PENALTY = (0.0, 1.0, 4.0, 16.0)

_LINE = re.compile(r"\r\n|[\r\n]")
_SENTENCE = re.compile(r"[.!?…](?=\s)")
_WORD = re.compile(r"\s+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, and the unit of each (index into UNITS), in order."""
    unit: dict[int, int] = {}
    for m in _WORD.finditer(text):
        unit[m.end()] = 2
    for m in _SENTENCE.finditer(text):
        unit[m.end()] = 1
    for m in _LINE.finditer(text):
        unit[m.end()] = 0
    unit.pop(0, None)
    unit.pop(len(text), None)
    at = np.array(sorted(unit), np.int64)
    return at, np.array([unit[i] for i in at.tolist()], np.int64)


def coarsest(text: str, limit: int = LIMIT) -> int:
    """The coarsest unit of which every instance fits the limit (3: not even words do)."""
    longest = 0
    for line in re.split(r"[\r\n]", text):
        longest = max(longest, len(line))
    if longest <= limit:
        return 0
    longest = 0
    for line in re.split(r"[\r\n]", text):
        before = 0
        for m in _SENTENCE.finditer(line):
            longest, before = max(longest, m.end() - before), m.end()
        longest = max(longest, len(line) - before)
    if longest <= limit:
        return 1
    return 2 if max(map(len, text.split()), default=0) <= limit else 3


def cut_positions(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """Where to cut, by dynamic programming, and the coarsest unit that fits.

    Minimises the sum of the cuts' penalties and of the pieces' squared shortfalls
    from an even share, over all cuts whose pieces, each with `overlap` characters
    of the piece before, stay within `limit`; a single unit may take the overlap's
    room. Boundaries coarser than the unit that fits stay allowed; finer ones come in
    only within what exceeds `limit`, and hard cuts only if even words do.
    """
    n, unit = len(text), coarsest(text, limit)
    if n <= limit:
        return [], unit
    room = limit - overlap  # of a piece without its full overlap
    pos, kind = boundaries(text)
    cuts_at = dict(zip(pos[kind <= unit].tolist(), kind[kind <= unit].tolist()))
    for finest in range(unit, 4):  # finer boundaries only within units over the limit
        bounds = [0, *sorted(cuts_at), n]
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z - a <= limit:
                continue
            end = a + len(text[a:z].rstrip())
            if a < end < z and end - a <= limit and z - end <= limit:  # only the white space after it is too much
                cuts_at[end] = min(finest, 2)
            elif finest < 3:
                inner = (pos > a) & (pos < z) & (kind == finest + 1)
                cuts_at |= dict(zip(pos[inner].tolist(), kind[inner].tolist()))
            else:  # any position; those on a grid are enough to stay within the limit
                cuts_at |= dict.fromkeys(range(a + room // 2, z, room // 2), 3)
    at = np.array(sorted(cuts_at), np.int64)
    cost = np.array(PENALTY)[[cuts_at[i] for i in at.tolist()]]
    ends = np.concatenate([[0], at, [n]])
    cost = np.concatenate([[0.0], cost, [0.0]])
    even = n / -(-(n - overlap) // room)
    best = np.full(len(ends), np.inf)
    back = np.zeros(len(ends), np.int64)
    best[0] = 0.0
    for j in range(1, len(ends)):
        i = np.searchsorted(ends, ends[j] - room)
        if ends[j] <= limit:
            i = 0
        i = min(i, j - 1)  # a unit that leaves too little room for the overlap stands alone
        size = ends[j] - ends[i:j]
        total = best[i:j] + (1 - size / even) ** 2 * 2
        k = int(np.argmin(total))
        best[j], back[j] = total[k] + cost[j], i + k
    cuts, j = [], len(ends) - 1
    while (j := int(back[j])) > 0:
        cuts.append(int(ends[j]))
    return cuts[::-1], unit


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], int]:
    """(start, end, overlap with the piece before) of each piece, and the coarsest unit that fits.

    The overlap begins at a word where that is possible. Joined without their
    overlaps, the pieces are the text.
    """
    cuts, unit = cut_positions(text, limit, overlap)
    out, begin = [], 0
    for end in [*cuts, len(text)]:
        back = max(0, begin - min(overlap, limit - (end - begin)))
        if 0 < back < begin and not text[back - 1].isspace():
            m = _WORD.search(text, back, begin)
            back = m.end() if m and m.end() < begin else back
        out.append((back if begin else 0, end, begin - back if begin else 0))
        begin = end
    return out, unit


def split_texts(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Texts of more than `limit` characters (code points) as overlapping pieces.

    Returns the key columns, piece_no (from 0), n_pieces, start, end, overlap,
    piece and ``cut``: the coarsest of line, sentence, word, of which every instance
    in the text has at most `limit` characters, or none.

    Every piece has at most `limit` characters; all but the first begin with up to
    `overlap` characters of the piece before. Texts within the limit, null and empty
    texts give no rows. Rows of one key count once (the first by text). Null keys
    are keys like others. Other columns are not read.

    Plan: the length filter runs in the scan's stage, before anything moves; only
    oversized texts are shuffled, once, to drop repeats of a key.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half of the limit")
    long = df.where(F.char_length(text) > limit).groupBy(*keys).agg(F.min(text).alias("text"))
    schema = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols = [], {c: [] for c in ("piece_no", "n_pieces", "start", "end", "overlap", "piece", "cut")}
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                parts, unit = pieces(t, limit, overlap)
                for no, (start, end, over) in enumerate(parts):
                    row.append(i)
                    for c, v in zip(cols, (no, len(parts), start, end, over, t[start:end], UNITS[unit])):
                        cols[c].append(v)
            types = {"piece": pa.string(), "cut": pa.string()}
            arrays = [b.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
            arrays += [pa.array(v, types.get(c, pa.int32())) for c, v in cols.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, *cols])

    return long.select(*keys, "text").mapInArrow(run, f"{schema}, piece_no int, n_pieces int, start int, end int, overlap int, piece string, cut string")
