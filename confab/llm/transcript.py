"""Blocks of a transcript to clean speaker turns.

A grammar reads each block as time marks, a speaker tag, annotations of sounds (also
nested ones), hesitation sounds and speech; the tree is turned into the clean
utterance and what was found on the way. Labels and tags are resolved to the call's
tracks, and turns are formed, in one scan over the blocks in time order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import millis
from confab.llm.calls import Rosters, heads, ordered_with_tracks
from confab.llm.labels import fold
from confab.llm.peg import Grammar, Node
from confab.operators import rangescan
from confab.session import checkpointed, spread

#: A stretch that can hold nothing but speech: signs that open nothing, and words that are no hesitation.
_PLAIN = r"(?:[^\w\[<(){*♪♫♬♩]++|(?<![\w'’])(?!e+h|[eé]{2}|é|e?h+m|m{2}|e+m|u+[hm]|e+r+m*\b|[äö]+h?m)[^\W\d_]++(?!\w)|(?<=['’])[^\W\d_]++(?!\w))++"
GRAMMAR = Grammar(
    r"""
    Block     <- _Lead* Tag? _Item*
    _Lead     <- _Space / Stamp
    _Item     <- _Plain / Hesitation / Stamp / Sound / Aside / _Word / _Any
    Stamp     <- /(?=[\[<(\d])/ (_Marked _After? / _Cue _After? / _Clock _After?)
    _Marked   <- '[' _Space? _Time _Range? _Space? ']' / '<' _Space? _Time _Range? _Space? '>' / '(' _Space? _Time _Range? _Space? ')'
    _Cue      <- _Long _Arrow _Long
    _Clock    <- !/(?<![^\W_])(?<=\w)/ _Long
    _Range    <- (_Arrow / /\s*[-–]\s*/) _Time
    _Arrow    <- /\s*-+>\s*/
    _Time     <- /\d{1,5}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?/ !/[\d:]/
    _Long     <- /\d{1,4}:\d\d:\d\d(?:[.,]\d{1,3})?/ !/[\d:]/
    _After    <- /[^\S\r\n]+[-–](?=\s|$)/
    Tag       <- /(?=[-–•*]|[^\W_])/ /[-–•][^\S\r\n]+/? (/\*\*/ Name /:?\*\*:?/ / Name /:(?=\s|$)|[^\S\r\n]*>>+/)
    Name      <- /[^\W_][^\r\n:*<>\[\]{}|♪.!?]*?(?=:?\*\*|:(?:\s|$)|(?<![^\S\r\n])[^\S\r\n]*+>>)/
    Sound     <- /(?=[(\[<{*♪♫♬♩])/ (_Double / _Square / _Angle / _Curly / _Starred / _Heard / /[♪♫♬♩]+/)
    _Double   <- /\(\((?s:.)*?\)\)/
    _Square   <- '[' !/\s*(?:speaker|track)\s*\d/ (_Square / /[^\[\]\r\n]/)+ ']'
    _Angle    <- '<' !/\s*\// (_Angle / /[^<>\r\n]/)+ '>'
    _Curly    <- '{' (_Curly / /[^{}\r\n]/)+ '}'
    _Starred  <- /\*(?![*\s])[^*\r\n]+\*(?!\*)/
    _Heard    <- '(' Heard ')'
    Heard     <- /[^()\[\]<>{}\r\n]+(?=\))/
    Aside     <- '(' (!')' _Item)* ')'
    Hesitation <- /(?<![\w'’])(?:e+h*m+|[eé]{2,}h*m*|é+h*m*|e+h+|h+m+|m{2,}|u+h+m*|u+m+|e+r+m*|[äö]+h+m*|[äö]+m+)(?![\w'’])/
    _Word     <- /\w+/
    _Space    <- /\s+/
    _Plain    <- /"""
    + _PLAIN
    + r"""/
    _Any      <- /(?s:.)/
    """,
    brackets={"()": "Aside", "[]": "_Square", "<>": "_Angle", "{}": "_Curly"},
)

#: Stems (without accents) of what is heard but not said, in four languages.
SOUNDS = (
    "ticho smich smiech hudb potlesk kasel kasle kasla sum zvon klepan klopan klap vzdych povzdech dych nesrozumiteln nezrozumiteln prekryv odkasl kych skrip bouch buch tuk telefon "
    "laugh chuckl giggl cough sneez sigh breath inhal exhal applau clap music sing noise silen pause inaudib unintellig indistinct crosstalk overlap door slam typing click beep ring static blank knock phone background sniff throat groan whisper hum cheer footstep rustl "
    "lach seufz hust nies musik rausch applaus gelacht beifall stille unverstand gerausch klopf tur atme rauspe klick tipp telefonklingel schweig durcheinander kichert piep"
).split()
#: Hesitations that are words of a language: (language, sound). "um" and "er" are German words, "um" and "em" Czech or Slovak ones.
WORDS_TOO = {("de", "um"), ("de", "er"), ("de", "eh"), ("de", "ehe"), ("cs", "um")}
#: Frequent words by which the language around a sound is told.
_FREQUENT = {
    "de": "der die das den dem des ein eine einen einer wir ich ist und nicht auf nach mit wegen ohne im am vom zum bei beim jemand niemand von zur unter vor weil aber doch dass uns unsere sie es an aus zwischen letzte letzten gestern heute haben hat sich vielleicht eigentlich halt eben wieder dann uhr projekt team lager redaktion zentrale kunde techniker".split(),
    "en": "the a an we i you of to in on at for with and but so because that this under from after before into without is it our some was yet although near last while near someone nobody project two by out up like perhaps actually basically again then yeah sure okay well".split(),
    "cs": "jsme jsem se na v ve po při za pod s do kvůli ale protože takže aby jenže ačkoli nikdo někdo před během mezi ke bez ze u pro sme som pri kvôli lebo nikto niekto pred medzi ku cez o počas vlani včera tedy prostě vlastně zase potom asi to je ano jo projekt tým zákazník".split(),
}
_LANGUAGE = {w: lang for lang, words in _FREQUENT.items() for w in words}
_FOLDED = {fold(w) for w in _LANGUAGE}

TIME, FILLER, SOUND, LABEL = 1, 2, 4, 8


_NEAR = re.compile(r"[^\W\d_]+")


def _language_near(text: str, start: int, end: int, sound: str) -> str:
    """Language of the eight words on either side of a place, the nearer ones first; '' if they don't tell."""
    size, left = 128, []
    while True:  # as many characters as hold eight words and a begun one
        left = _NEAR.findall(text[max(0, start - size) : start].lower())
        if len(left) > 8 or size >= start:
            break
        size *= 4
    right = [m.group().lower() for m in islice(_NEAR.finditer(text, end), 8)]
    score: dict[str, float] = {}
    for words in (left[:-9:-1], right):
        for i, w in enumerate(words):
            if w != sound and (lang := _LANGUAGE.get(w)):
                score[lang] = score.get(lang, 0) + 1 / (2 + i)
    best = max(score.values(), default=0)
    return next((k for k, v in score.items() if v == best), "")


_SOUND_WORD = re.compile("(?:" + "|".join(SOUNDS) + ")")
_ONLY_HESITATION = re.compile(r"(?:e+h*m+|e+h*|h+m+|m{2,}|u+h*m*|e+r+m*|[ao]+h*m+)\Z")
#: Words that point at something said before, besides those of _LANGUAGE.
_POINTING = set("ten ta to ti ty tento tato toto tyto ktery ktera ktere ktory ktora ktore this that these those which my your his her their he she they dieser diese dieses jener mein dein sein ihr welche ok".split())


def _is_sound(text: str) -> bool:
    """Whether a remark in round brackets or stars tells what was heard.

    Told by form: a remark names a sound at its beginning, or is a bare phrase without
    any article, pronoun, preposition or conjunction ("dog barking"); what points back
    at something or joins phrases was said. Hesitations alone are said, too.
    """
    words = [w for w in _NEAR.findall(fold(text)) if not _ONLY_HESITATION.match(w)]
    if any(_SOUND_WORD.match(w) for w in words[:3]):
        return True
    return bool(words) and not any(w in _POINTING or w in _FOLDED for w in words)


class Utterance:
    """What the tree of a block says: flags, the tag's name and the clean text."""

    def __init__(self, text: str):
        self.text, self.flags, self.tag, self.tag_span = text, 0, None, (0, 0)
        self.cut: list[tuple[int, int]] = []
        tree = GRAMMAR.parse("Block", text)
        for node in tree[3] if tree else []:
            self._node(node)

    def _node(self, node: Node) -> None:
        kind, start, end, children = node
        if kind == "Stamp":
            self.flags |= TIME
            self.cut.append((start, end))
        elif kind == "Tag":
            _, a, z, _ = children[0]
            self.tag, self.tag_span = self.text[a:z].strip(), (start, end)
        elif kind == "Sound":
            heard = next((self.text[a:z] for k, a, z, _ in children if k == "Heard"), None)
            inner = re.sub(r"^[\[<{(*\s]+|[\]>})*\s]+$", "", self.text[start:end])
            if self.text[start] == "(" and heard is not None and not _is_sound(heard):
                inside = GRAMMAR.parse("Block", heard)  # said, not heard: an aside
                for k, a, z, c in inside[3] if inside else []:
                    if k != "Tag":
                        self._node(_moved((k, a, z, c), start + 1))
                return
            if self.text[start] == "*" and not _is_sound(inner) and len(inner.split()) > 2:
                return
            self.flags |= SOUND
            self.cut.append((start, end))
        elif kind == "Hesitation":
            sound = self.text[start:end].lower()
            if sound in ("um", "er", "eh", "em", "é", "ö", "ä") and (_language_near(self.text, start, end, sound), sound) in WORDS_TOO:
                return
            if sound in ("é", "ém", "em"):
                return
            self.flags |= FILLER
            after = re.compile(r"(?:\.{2,}|…|,)?").match(self.text, end).end()
            self.cut.append((start, after))
        else:
            for c in children:
                self._node(c)

    def _left(self, without_tag: bool) -> Iterator[str]:
        """The stretches of the text that stay."""
        at = 0
        for a, z in sorted([*self.cut, self.tag_span] if without_tag and self.tag else self.cut):
            if a >= at:
                yield self.text[at:a]
            at = max(at, z)
        yield self.text[at:]

    def clean(self, without_tag: bool) -> str:
        """The text without what was found; white space collapsed."""
        return _tidy(" ".join(self._left(without_tag)))

    def said(self, without_tag: bool) -> bool:
        """Whether a letter or digit is left."""
        return any(map(_ALNUM.search, self._left(without_tag)))


_ALNUM, _SPACES, _LOOSE = re.compile(r"[^\W_]"), re.compile(r"\s+"), re.compile(r" (?=[,.;!?…])|^[-–,;\s]+(?=\w)|\(\s*\)")
_NOTHING = re.compile(f"{_PLAIN}\\Z", re.IGNORECASE)


def _tidy(text: str) -> str:
    return _LOOSE.sub("", _SPACES.sub(" ", text).strip()).strip()


def _moved(node: Node, by: int) -> Node:
    kind, a, z, children = node
    return kind, a + by, z + by, [_moved(c, by) for c in children]


_SCHEMA = "call_id string, block_no int, idx int, name string, start_ms long, end_ms long, text string, time boolean, filler boolean, sound boolean, label boolean, turn_block int"


def clean_blocks(blocks: DataFrame, tracks: DataFrame, with_text: bool = True) -> DataFrame:
    """Each block of a transcript, cleaned, with its track and its turn.

    `blocks`: call_id, block_no, speaker, start, end, text. `tracks`: call_id, idx,
    title. Returns call_id, block_no, idx and name of the track, start_ms, end_ms,
    text (clean; null if `with_text` is false), and whether the text held a ``time``
    mark, a ``filler``, a ``sound`` annotation, and whether the ``label`` was not
    clean; turn_block is the block that opens its turn, null for blocks without a
    letter or digit left, which belong to none.

    The track is that of the label or, where the label stands for none, that of the
    tag which opens the text; if neither tells, idx and name are null (such blocks
    are a track of their own for turns). Order is (start, block_no). Rows that repeat
    a key with the same start count once. Rows with a null call_id, block_no or start
    are left out; null texts are empty ones. Other columns are not read.

    Plan: blocks are parsed where they lie; one range shuffle on (call_id, start,
    block_no) with the tracks sorted in; turns across partitions are continued by a
    prefix fold of one record a partition.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {"flags": [], "tag": [], "text": [], "untagged": [], "said": []}
            flags, tags, tagged, untagged, said = (c.append for c in cols.values())
            for t in b.column(5).to_pylist():
                if not t or (":" not in t and ">>" not in t and _NOTHING.match(t)):  # speech only, without a tag
                    flags(0), tags(None), tagged(None), untagged(_tidy(t or "") if with_text else None), said(3 if t and _ALNUM.search(t) else 0)
                    continue
                u = Utterance(t)
                flags(u.flags), tags(u.tag), untagged(u.clean(True) if with_text else None), tagged(u.clean(False) if with_text and u.tag else None)
                # said with the tag taken off, said with it left
                bare = u.said(True)
                said(bare + 2 * (bare or bool(u.tag and u.said(False))))
            types = {"flags": pa.int32(), "said": pa.int32()}
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), *(pa.array(v, types.get(k, pa.string())) for k, v in cols.items())], ["call_id", "start", "row", "label", "end", *cols])

    rows = blocks.where(F.col("call_id").isNotNull() & F.col("block_no").isNotNull() & F.col("start").isNotNull()).select(
        "call_id", millis("start").alias("start"), F.col("block_no").cast("long").alias("row"), F.col("speaker").alias("label"), millis(F.coalesce("end", "start")).alias("end"), "text"
    )
    # written once: the range shuffle reads its input twice (it samples it first)
    parsed = checkpointed(spread(rows).mapInArrow(parse, "call_id string, start long, row long, label string, end long, flags int, tag string, text string, untagged string, said int"))
    ordered = ordered_with_tracks(parsed, tracks)
    begin = heads(ordered, tracks)

    def each(batches: Iterator[pa.RecordBatch], state: tuple | None) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Of each batch its blocks' rows: (place in it, call, idx, name, whether bare, label clean, opening block, track key).

        The state is (call, track key, opening block) of the last block that counts.
        """
        rosters, last = Rosters(begin.get(TaskContext.get().partitionId(), {})), None
        for b in batches:
            out = []
            cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("call_id", "kind", "row", "label", "tag", "said"))
            for i, (call, kind, row, label, tag, said) in enumerate(zip(*cols)):
                if kind == 0:
                    rosters.add(call, row, label)
                    continue
                if (call, row) == last:
                    continue
                last = (call, row)
                roster = rosters.at(call)
                by_tag = roster.find(tag) if tag else None
                idx = roster.find(label)
                idx = by_tag if idx is None else idx
                name = roster.names[idx] if idx is not None else None
                key = idx if idx is not None else roster.key(label)
                bare = by_tag is not None
                opens = None
                if said & (1 if bare else 2):
                    opens = state[2] if state and state[0] == call and state[1] == key else row
                    state = (call, key, opens)
                out.append((i, call, idx, name, bare, bare or label != name, opens, key))
            yield b, out

    def summary(batches: Iterator[pa.RecordBatch]):
        """First call; last call and, of its blocks that count, whether they have one track, and the last state."""
        first = call = state = None
        keys: set[int] = set()
        for _, out in each(batches, None):
            for _, of, _, _, _, _, opens, key in out:
                first = first or of
                if of != call:
                    call, keys, state = of, set(), None
                if opens is not None:
                    keys.add(key)
                    state = (call, key, opens)
        return first and (first, call, len(keys) == 1, state)

    around, state = {}, None
    for pid, (first, call, uniform, own) in rangescan.summaries(ordered.select("call_id", "kind", "row", "label", "tag", "said"), summary):
        around[pid] = (state, None)
        if state and first == call == state[0] and (own is None or (uniform and own[1] == state[1])):
            continue  # the turn carried in is still open
        state = own

    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _SCHEMA.split(", "))])

    def scan(batches: Iterator[pa.RecordBatch], before: tuple | None, _: object) -> Iterator[pa.RecordBatch]:
        for b, out in each(batches, before):
            at, _, idx, name, bare, label, opens, _ = zip(*out) if out else [()] * 8
            b = b.take(pa.array(at, pa.int64()))
            col = lambda c: b.column(b.schema.get_field_index(c))
            text, flags = pc.coalesce(pc.if_else(pa.array(bare, pa.bool_()), None, col("text")), col("untagged")), col("flags")
            on = [pc.greater(pc.bit_wise_and(flags, f), 0) for f in (TIME, FILLER, SOUND)]
            cols = [col("call_id"), col("row"), pa.array(idx, pa.int32()), pa.array(name, pa.string()), col("start"), col("end"), text, *on, pa.array(label, pa.bool_()), pa.array(opens, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return rangescan.rescan(ordered, scan, around, _SCHEMA)


def turns(cleaned: DataFrame) -> DataFrame:
    """Clean turns of ``clean_blocks``: call_id, turn_block, idx, speaker, start_ms, end_ms, text.

    speaker is the track's name. A turn's blocks are joined by blanks in order of start.
    """
    said = cleaned.where("turn_block is not null")
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "block_no", "text")))
    out = said.groupBy("call_id", "turn_block").agg(F.first("idx").alias("idx"), F.first("name").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), parts.alias("p"))
    return out.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), " ")).drop("p")
