"""Which track a carelessly written speaker label stands for.

A call's track goes by three labels: its name (title, or ``Speaker n`` where the
title is blank, n being its position by idx), ``Speaker n`` in any case, and the
unit key ``track<idx>``.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

_MIC = re.compile(r"\((?:mic|mikrofon|mikrofón|mikro)\W*\d*\)", re.I)
_LETTERS = str.maketrans({"ß": "ss", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS)).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(label: str) -> list[str]:
    """Folded words of a label, without microphone notes, brackets and signs; digits apart from letters."""
    return re.findall(r"[^\W\d_]+|\d+", fold(_MIC.sub(" ", label)))


def _near(a: str, b: str) -> bool:
    """One letter dropped, added, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Roster:
    """The tracks of one call: [(idx, title)], repeats allowed, any order."""

    def __init__(self, tracks: list[tuple[int, str | None]]):
        own = dict(sorted(tracks, key=lambda t: t[0]))
        self.names = {i: t if t is not None and t.strip() else f"Speaker {n}" for n, (i, t) in enumerate(own.items(), 1)}
        self.words = {i: words(t) for i, t in self.names.items()}
        self.exact: dict[str, int | None] = {}
        for group in (self.names.items(), ((i, f"Speaker {n}") for n, i in enumerate(own, 1)), ((i, f"track{i}") for i in own)):
            level: dict[str, set[int]] = {}
            for i, label in group:
                level.setdefault("".join(words(label)), set()).add(i)
            for k, ids in level.items():  # a name goes before a default name, that before a unit key
                self.exact.setdefault(k, min(ids) if len(ids) == 1 else None)
        self.seen: dict[str, int | None] = {}

    def find(self, label: str | None) -> int | None:
        """idx of the only track the label can stand for, else None (blank and ambiguous labels too)."""
        if label is None:
            return None
        if label not in self.seen:
            self.seen[label] = self._find(words(label))
        return self.seen[label]

    def _find(self, w: list[str]) -> int | None:
        key = "".join(w)
        if not key:
            return None
        if self.exact.get(key) is not None:
            return self.exact[key]
        # a slip of one letter; digits must agree; a letter left out is likelier than another one
        digits, letters = re.sub(r"\D", "", key), re.sub(r"\d", "", key)
        near = {i: len(k) > len(key) for k, i in self.exact.items() if i is not None and re.sub(r"\D", "", k) == digits and _near(letters, re.sub(r"\d", "", k))}
        if len(near) > 1 and sum(near.values()) == 1:
            near = {i: short for i, short in near.items() if short}
        if len(near) == 1:
            return next(iter(near))
        # part of a full name, its other part left out or given by its initial
        part = set()
        for i, name in self.words.items():
            if len(name) < 2 or name[0] == "speaker":
                continue
            first, last = name[0], name[-1]
            if len(w) == 1 and len(w[0]) > 1 and w[0] in (first, last):
                part.add(i)
            elif len(w) == 2 and (
                (len(w[1]) == 1 and _near(w[0], first) and last.startswith(w[1])) or (len(w[0]) == 1 and _near(w[1], last) and first.startswith(w[0])) or (_near(w[0], last) and _near(w[1], first)) or (_near(w[0], first) and _near(w[1], last))
            ):
                part.add(i)
        # a track titled by a given name, labelled with a full name
        for i, name in self.words.items():
            if len(name) == 1 and len(w) == 2 and name[0] == w[0]:
                part.add(i)
        return part.pop() if len(part) == 1 else None

    def key(self, label: str | None) -> int:
        """idx of the track, or a negative number that equal spellings of an unknown label share."""
        i = self.find(label)
        return i if i is not None else -1 - zlib.crc32("".join(words(label or "")).encode())


EMPTY = Roster([])
