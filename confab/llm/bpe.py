"""Byte-level byte-pair encoding as a streaming transducer with bounded lookahead.

A text is split by the vocabulary's pattern; within a part, merges apply in rank
order. For a list of merges there is a number of bytes, the sufficient lookahead,
beyond which what follows cannot change a token any more. A part is thus
encoded window by window: tokens that end at least that far before the window's
end are stable and are emitted, and the rest is encoded again with what follows.
Texts are taken in windows too, and so are parts that fill one, so that memory
besides text and ids is that of one window, whatever the length of either.

Why the lookahead is enough: a change after a position can only undo a merge (u, v)
through a merge of higher priority that takes the last piece of v, or what v's own
last piece was made of, together with bytes further right; and so on with ever
higher priorities. ``lookahead`` follows these chains through the list and returns
the longest stretch of bytes that one can span.
"""

from __future__ import annotations

import array
import base64
import heapq
import json
import os
import re
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters at a chunk's end that may still change how the pattern splits.
_UNSTABLE = 4
CHUNK = 1 << 16
SHORT = 256


def default_path() -> str:
    """The vocabulary's file in the installed package of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a rank file or a tokenizer's json."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # printable bytes stand for themselves, the others are moved up from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}


def merge(part: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The tokens of a part: the neighbours whose union ranks first are joined, until none rank."""
    word = [part[i : i + 1] for i in range(len(part))]
    if len(word) < 2:
        return word
    top = below if below is not None else 1 << 60
    score = [ranks.get(word[i] + word[i + 1], top) for i in range(len(word) - 1)]
    while score:
        best = min(score)
        if best >= top:
            break
        i = score.index(best)
        word[i : i + 2] = [word[i] + word[i + 1]]
        del score[i]
        if i < len(score):
            score[i] = ranks.get(word[i] + word[i + 1], top)
        if i:
            score[i - 1] = ranks.get(word[i - 1] + word[i], top)
    return word


def merge_long(part: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """As `merge`, with a heap of the neighbours' ranks: n log n instead of n squared steps."""
    n = len(part)
    word: list[bytes | None] = [part[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if word[i] is None or j >= n or ranks.get(word[i] + word[j]) != rank:
            continue  # one of the two is another word by now
        word[i], word[j] = word[i] + word[j], None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(word[i] + word[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (k := left[i]) >= 0 and (r := ranks.get(word[k] + word[i])) is not None:
            heapq.heappush(heap, (r, k))
    return [w for w in word if w is not None]


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list behind the ranks, in order of priority."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            two = merge(token, ranks, rank)
            if len(two) == 2:
                out.append((two[0], two[1]))
    return out


@lru_cache(4)
def lookahead(path: str) -> int:
    """The sufficient lookahead, in bytes, of a vocabulary's merge list."""
    reach: dict[bytes, int] = {}  # of a left side: the longest chain that starts by taking it away
    halves: dict[bytes, bytes] = {}
    longest = 0
    for u, v in merges(read_ranks(path)):
        piece: bytes | None = v
        far = 0
        while piece is not None:
            far = max(far, reach.get(piece, 0))
            piece = halves.get(piece)
        mine = len(v) + far
        longest = max(longest, mine)
        if mine > reach.get(u, 0):
            reach[u] = mine
        halves[u + v] = v
    return longest


class Encoder:
    """Ids of texts; parts seen are remembered (a bounded number of them)."""

    def __init__(self, path: str, ahead: int, remember: int = 1 << 19):
        import regex

        self.ranks, self.ahead = read_ranks(path), ahead
        self.split = regex.compile(PATTERN)
        self.kinds = [regex.compile(k) for k in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
        self.unsure = re.compile(r"[\s\x1c-\x1f] (?:[\s\x1c-\x1f]|\Z)")
        encoder = self

        class Known(dict):
            """Text to ids; `before` stands in front of the text."""

            def __init__(self, before: str):
                self.before = before

            def __missing__(self, text: str):
                if len(self) >= remember:
                    self.clear()
                parts = encoder.split.findall(self.before + text)
                ids = tuple(chain.from_iterable(map(encoder.parts.__getitem__, parts)))
                if len(text) <= SHORT:
                    self[text] = ids
                return ids

        class Parts(dict):
            def __missing__(self, part: str):
                if len(self) >= remember:
                    self.clear()
                ids = tuple(encoder.part(part.encode("utf-8", "surrogatepass")))
                if len(part) <= SHORT:
                    self[part] = ids
                return ids

        self.parts, self.known, self.spaced = Parts(), Known(""), Known(" ")

    def part(self, data: bytes) -> Iterator[int]:
        """Ids of one part."""
        return self._stream(iter((data,)))

    def _stream(self, pieces: Iterator[bytes]) -> Iterator[int]:
        """Ids of one part that comes in pieces, emitted as they become stable; one window is held."""
        window = max(SHORT, 4 * self.ahead)
        held, more = b"", True
        while more or held:
            while more and len(held) <= window:
                got = next(pieces, None)
                if got is None:
                    more = False
                else:
                    held += got
            at = 0
            while at < len(held):
                whole = not more and at + window >= len(held)
                if not whole and len(held) - at <= window:
                    break
                piece = held[at : at + window]
                stop = at + len(piece) - (0 if whole else self.ahead)
                for token in (merge if len(piece) < 100 else merge_long)(piece, self.ranks):
                    if not whole and at + len(token) > stop:
                        break
                    yield self.ranks[token]
                    at += len(token)
            held = held[at:]

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of a text, without special tokens; none for null and empty texts.

        The text is taken in windows of CHUNK characters that end at a blank which is a stable cut of the pattern:
        one with no white space on either side of it. What begins with it is split alike whatever stands before.
        A window without one goes on part by part up to its end.
        """
        at, n = 0, len(text or "")
        while at < n:
            end = n
            if n - at > CHUNK:
                end = at + CHUNK
                while (end := text.rfind(" ", at + 1, end)) > 0 and (text[end - 1].isspace() or text[end + 1].isspace()):
                    pass
                if end < 0:
                    at = yield from self._parts(text, at, min(at + CHUNK, n))
                    continue
            window = text[at:end] if at or end < n else text
            if self.unsure.search(window):
                yield from self._parts(text, at, end, end)
            else:
                first, *rest = window.split(" ")
                yield from chain(self.known[first] if first else (), chain.from_iterable(map(self.spaced.__getitem__, rest)))
            at = end

    def _parts(self, text: str, at: int, least: int, end: int | None = None) -> Generator[int, None, int]:
        """Ids of the parts from `at` on up to the first that reaches `least`; returns where it ends.

        `end` is a stable cut, if given. A part is looked for in CHUNK characters; one that fills them is a run of
        one kind of character and is handed on piece by piece.
        """
        end = len(text) if end is None else end
        while at < least:
            stop = min(at + CHUNK, end)
            chunk, begun = text[at:stop], at
            for m in self.split.finditer(chunk):
                if stop < end and m.end() > len(chunk) - _UNSTABLE:
                    break
                yield from self.parts[m.group()]
                at = begun + m.end()
                if at >= least:
                    return at
            if at == begun:  # no part ends within the chunk
                yield from self._stream(self._run(text, at, end))
                at = self.reached
        return at

    def _run(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The bytes of a long run of one kind of character, piece by piece; `reached` is where it ends."""
        self.reached = at
        head = at + (text[at] == " " and not self.kinds[0].match(text, at + 1))
        kind = next(k for k in self.kinds if k.match(text, head))
        closed = False
        while not closed:
            m = kind.match(text, head, min(head + CHUNK, end))
            head = m.end() if m else head
            closed = not m or m.end() - m.start() < CHUNK or head == end
            if kind is self.kinds[0] and head < end:
                head -= 1  # of white space before something else the last sign belongs to what follows
            if head > at:
                self.reached = head
                yield text[at:head].encode("utf-8", "surrogatepass")
            at = head


class Decoder:
    """Ids to text: a state machine over the bytes of UTF-8 that holds at most one unfinished character."""

    def __init__(self, path: str):
        self.token = {i: b for b, i in read_ranks(path).items()}
        self.reset()

    def reset(self) -> None:
        self.code, self.need, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """The characters that `data` completes; bytes that are no UTF-8 give U+FFFD."""
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need = self.code << 6 | b & 0x3F, self.need - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.code, self.need = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.code, self.need = b & 0x0F, 2
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.code, self.need = b & 0x07, 3
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        self.reset()
        text = "".join(self.feed(self.token[i]) for i in ids)
        return text + "�" * bool(self.need)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The key and ``ids`` (ARRAY<INT>) of each row's text by the vocabulary at `path`.

    Null and empty texts have an empty list. Strings of special tokens within a text
    are ordinary text. Rows that repeat are encoded each; keys may be null. Other
    columns are not read.

    Plan: a map over the scan; no shuffle. The sufficient lookahead is found once on
    the driver; workers read the vocabulary from `path`.
    """
    path = os.fspath(path or default_path())
    ahead = lookahead(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ahead)
        for b in batches:
            flat, ends = array.array("i"), [0]
            for t in b.column(1).to_pylist():
                flat.extend(encoder.encode(t))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The key and ``text`` of each row's ids (null ids: null)."""
    path = os.fspath(path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for b in batches:
            texts = [None if x is None else decoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
