"""Segments to turns: merging, interruptions, rendering, packing and batching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import formats
from confab.functions.text import is_blank, utrim
from confab.operators import rangescan
from confab.operators.ordered import HOUR, with_order

PAUSE_MS = 800


def join_words(words: Column) -> Column:
    """Text of a list of words; a blank goes before each but the first that asks for one (TXT-4)."""
    parts = F.transform(words, lambda w, i: F.when((i > 0) & F.coalesce(w["lead_space"], F.lit(True)), F.concat(F.lit(" "), w["text"])).otherwise(w["text"]))
    return utrim(F.array_join(parts, ""))


def segment_text(words: Column, text: Column) -> Column:
    """The words' text, or the segment's own where it has no words."""
    return F.when(F.size(F.coalesce(words, F.array().cast("array<struct<start:double,end:double,text:string,lead_space:boolean>>"))) > 0, join_words(words)).otherwise(utrim(text))


def spoken_segments(segments: DataFrame) -> DataFrame:
    """Segments with text, in milliseconds; repeats stay, ``turn_rows`` counts them once (PRJ-12)."""
    s = segments.where(~is_blank("text") & F.col("call_id").isNotNull() & F.col("seq").isNotNull() & F.col("start").isNotNull())
    return s.select("call_id", "seq", "speaker", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.coalesce("end", "start") * 1000).cast("long").alias("end_ms"), segment_text(F.col("words"), F.col("text")).alias("text"), "energy")


def distinct_segments(segments: DataFrame) -> DataFrame:
    """``spoken_segments`` with one row per (call_id, seq); energy is the greatest of the repeats (AGG-5)."""
    s = spoken_segments(segments)
    same = [c for c in s.columns if c not in ("call_id", "seq", "energy")]
    return s.groupBy("call_id", "seq").agg(*(F.first(c).alias(c) for c in same), F.max("energy").alias("energy"))


class _Turns:
    """The scan behind ``merge_turns``: which rows open a block, batch by batch.

    State: call, many (speakers), speaker, seq and furthest end of the last row,
    number and end of the open block; None for what is not known.
    """

    FIELDS = ("call", "many", "speaker", "reach", "seq", "no", "end")

    def __init__(self, pause_ms: int, state: dict | None):
        self.pause, self.state = pause_ms, dict(state) if state else dict.fromkeys(self.FIELDS)

    def step(self, b: pa.RecordBatch) -> dict | None:
        """Of a batch's rows (without heads): their places, what is new, and each block's first row, number and ends."""
        st = self.state
        call, kind, seq, end, start = b.column("call_id"), *(b.column(c).to_numpy() for c in ("kind", "seq", "end_ms", "start_ms"))
        new = np.ones(len(seq), bool)
        new[1:] = pc.not_equal(call[1:], call[:-1]).to_numpy(zero_copy_only=False)
        new[0] = call[0].as_py() != st["call"]
        if new[0]:
            st.update(dict.fromkeys(self.FIELDS), call=call[0].as_py())
        group = np.cumsum(new) - new[0]
        many = np.zeros(int(group[-1]) + 1, bool)
        many[0] = bool(st["many"])
        head = kind == 0
        many[group[head]] = end[head] == 1
        at = np.flatnonzero(~head)
        last = call[len(seq) - 1].as_py()
        if not len(at):
            if last != st["call"]:
                st.update(dict.fromkeys(self.FIELDS), call=last)
            st["many"] = bool(many[-1])
            return None
        start, end, seq, group = start[at], end[at], seq[at], group[at]
        speaker = pc.fill_null(b.column("speaker"), "\0").take(pa.array(at))
        first = np.empty(len(at), bool)
        first[1:] = group[1:] != group[:-1]
        goes_on = st["seq"] is not None and group[0] == 0
        first[0] = not goes_on
        before = rangescan.furthest_before(end, first, st["reach"] if goes_on else None)
        again, turned = np.zeros(len(at), bool), np.zeros(len(at), bool)
        again[1:], turned[1:] = seq[1:] == seq[:-1], pc.not_equal(speaker[1:], speaker[:-1]).to_numpy(zero_copy_only=False)
        if goes_on:
            again[0], turned[0] = seq[0] == st["seq"], speaker[0].as_py() != st["speaker"]
        again &= ~first
        opens = first | np.where(many[group], turned, start - before > self.pause)
        count = np.cumsum(opens)
        firsts = np.flatnonzero(first)
        base = np.full(len(at), -(st["no"] or 0))
        if len(firsts):
            base[firsts[0] :] = np.repeat(count[firsts] - 1, np.diff(np.append(firsts, len(at))))
        heads = np.flatnonzero(opens | (np.arange(len(at)) == 0))
        ends = np.maximum.reduceat(end, heads)
        if not opens[0]:
            ends[0] = max(ends[0], st["end"] if st["end"] is not None else ends[0])
        before_end = np.append(st["end"] if goes_on and st["end"] is not None else ends[0], ends[:-1])
        interrupts = opens[heads] & ~first[heads] & (start[heads] < before_end)
        no = count - base
        own = end[firsts[-1] :].max() if len(firsts) else max(end.max(), st["reach"])
        self.state = {"call": call[int(at[-1])].as_py(), "many": bool(many[group[-1]]), "speaker": speaker[len(at) - 1].as_py(), "reach": int(own), "seq": int(seq[-1]), "no": int(no[-1]), "end": int(ends[-1])}
        if last != self.state["call"]:  # the batch ends with the head of another call
            self.state = dict.fromkeys(self.FIELDS) | {"call": last, "many": bool(many[-1])}
        return {"at": at, "first": first, "again": again, "opens": opens, "heads": heads, "no": no[heads], "ends": ends, "interrupts": interrupts, "speaker": speaker, "start": start, "seq": seq}


def _ends(pause_ms: int, before: dict[int, dict] | None):
    """Summary of a partition: whether one call that began before fills it, whether a block opens in it, its last state."""

    def summary(batches: Iterator[pa.RecordBatch]):
        t = _Turns(pause_ms, before.get(TaskContext.get().partitionId()) if before else None)
        call, alone, opened = None, True, False
        for b in batches:
            if b.num_rows:
                if call is None:
                    call, alone = b.column("call_id")[0].as_py(), b.column("kind")[0].as_py() != 0
                got = t.step(b)
                opened |= got is not None and bool(got["opens"].any())
        return call and (call, alone and t.state["call"] == call, opened, t.state)

    return summary


def _carried(found: list) -> dict[int, dict]:
    """Prefix fold: the call, speakers and furthest end before each partition."""
    out, state = {}, None
    for pid, (call, alone, _, own) in found:
        if state:
            out[pid] = state
        if state and alone and call == state["call"]:
            reach = [r for r in (own["reach"], state["reach"]) if r is not None]
            own = (own if own["seq"] is not None else state) | {"many": state["many"], "reach": max(reach, default=None)}
        state = own
    return out


_PART = "call_id {}, block_no long, speaker string, start_ms long, end_ms long, energy double, segments long, seq long, text string, interrupting boolean"


def turn_rows(segments: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Segments of each call merged into chronological blocks, with interruptions (GRP-1, GRP-2, AGG-4, AGG-5).

    `segments`: call_id, seq, speaker, start_ms, end_ms, text, energy. With two or
    more speakers in a call a block ends where the speaker changes; with one, where
    the silence before a segment exceeds `pause_ms`. Returns call_id, block_no (from
    1), speaker, start_ms, end_ms (the furthest), energy (the greatest known),
    segments, text, and whether the block starts before the one before it has ended
    (``interrupting``). Null speakers are one speaker. Ties in start go by seq. Rows
    that repeat a (call_id, seq) at the same start count once, their energy is the
    greatest. Rows without call_id, seq or start are left out; a null end is the
    start. No rows for no segments; other columns are not read.

    Plan: one small aggregate (whether a call has several speakers) whose rows are
    sorted in before their call's, one range shuffle on (call_id, start_ms, seq), and
    one shuffle of blocks, whose parts from different batches are put together. A hot
    call is spread over its times.
    """
    s = segments.where("call_id is not null and seq is not null and start_ms is not null")
    said = F.coalesce("speaker", F.lit("\0"))
    several = s.groupBy("call_id").agg((F.max(said) != F.min(said)).cast("long").alias("end_ms"))
    rows = s.select("call_id", F.lit(1).cast("byte").alias("kind"), "start_ms", F.col("seq").cast("long").alias("seq"), F.coalesce("end_ms", "start_ms").alias("end_ms"), "speaker", "text", F.col("energy").cast("double").alias("energy"))
    heads = several.select("call_id", F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("seq"), "end_ms")
    ordered = rangescan.sort_globally(rows.unionByName(heads, allowMissingColumns=True), "call_id", "kind", "start_ms", "seq")
    narrow = ordered.select("call_id", "kind", "start_ms", "seq", "end_ms", "speaker")
    # ends and speakers first, then, knowing what precedes each partition, numbers and ends of blocks
    before = _carried(rangescan.summaries(narrow, _ends(pause_ms, None)))
    counted = rangescan.summaries(narrow, _ends(pause_ms, {pid: st | {"no": 0, "end": None} for pid, st in before.items()}))
    state = None
    for i, (pid, (call, alone, opened, own)) in enumerate(counted):
        had = before.get(pid)
        if had and state and had["call"] == state["call"]:
            before[pid] = had | {"no": state["no"], "end": state["end"]}
        if alone and state and state["call"] == call and own["seq"] is not None:
            own = own | {"no": own["no"] + (state["no"] or 0), "end": own["end"] if opened else max(own["end"], state["end"])}
        state = own

    def scan(batches: Iterator[pa.RecordBatch], state: dict | None, _: object) -> Iterator[pa.RecordBatch]:
        t = _Turns(pause_ms, state)
        for b in batches:
            got = t.step(b) if b.num_rows else None
            if got is None:
                continue
            at, heads, keep = pa.array(got["at"]), got["heads"], ~got["again"]
            texts = b.column("text").take(at).to_pylist()
            energy = np.fmax.reduceat(b.column("energy").take(at).to_numpy(zero_copy_only=False).astype(float), heads)
            edges = [*heads.tolist(), len(texts)]
            said = [" ".join(x for x, k in zip(texts[a:z], keep[a:z]) if k and x is not None) for a, z in zip(edges, edges[1:])]
            first = pa.array(heads)
            named = b.column("speaker").take(at).take(first)
            yield pa.RecordBatch.from_arrays(
                [b.column("call_id").take(at).take(first), pa.array(got["no"], pa.int64()), named, pa.array(got["start"][heads]), pa.array(got["ends"]), pa.array(energy, from_pandas=True), pa.array(np.add.reduceat(keep.astype(np.int64), heads)), pa.array(got["seq"][heads]), pa.array(said, pa.string()), pa.array(got["interrupts"])],
                ["call_id", "block_no", "speaker", "start_ms", "end_ms", "energy", "segments", "seq", "text", "interrupting"],
            )

    parts = rangescan.rescan(ordered, scan, {pid: (st, None) for pid, st in before.items()}, _PART.format(segments.schema["call_id"].dataType.simpleString()))
    whole = parts.groupBy("call_id", "block_no").agg(
        F.min_by("speaker", F.struct("start_ms", "seq")).alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("energy").alias("energy"), F.sum("segments").alias("segments"),
        F.array_sort(F.collect_list(F.struct("start_ms", "seq", "text", "segments"))).alias("p"), F.max("interrupting").alias("interrupting"),
    )
    text = F.array_join(F.transform(F.filter("p", lambda p: p["segments"] > 0), lambda p: p["text"]), " ")
    return whole.select("call_id", "block_no", "speaker", "start_ms", "end_ms", "energy", "segments", text.alias("text"), "interrupting")


def merge_turns(segments: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """``turn_rows`` without the flag."""
    return turn_rows(segments, pause_ms).drop("interrupting")


def flag_interruptions(blocks: DataFrame, width: int = HOUR) -> DataFrame:
    """``interrupting``: the block starts before the one before it has ended (GRP-2).

    To be applied again after blocks were removed.
    """
    b = with_order(blocks, "call_id", ["start_ms", "block_no"], width, lag={"prev_end": "end_ms"})
    return b.withColumn("interrupting", F.coalesce(F.col("start_ms") < F.col("prev_end"), F.lit(False))).drop("prev_end")


def markdown(blocks: DataFrame) -> DataFrame:
    """call_id and ``text``: the transcript as Markdown (TXT-13).

    Plain paragraphs for one speaker; else a line with speaker, time and a mark for
    interruptions above each block. One row per call holds the whole transcript.
    """
    mark = F.when(F.col("interrupting"), " (interrupting)").otherwise("")
    head = F.concat(F.lit("**"), F.coalesce("speaker", F.lit("")), F.lit("** ["), formats.timestamp(F.col("start_ms") / 1000), F.lit("]"), mark, F.lit("\n"), F.col("text"))
    b = blocks.withColumn("said", head)
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "block_no", "text", "said")))
    t = b.groupBy("call_id").agg(F.countDistinct(F.coalesce("speaker", F.lit(""))).alias("n"), parts.alias("p"))
    body = F.when(F.col("n") > 1, F.array_join(F.transform("p", lambda x: x["said"]), "\n\n")).otherwise(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    return t.select("call_id", F.concat(body, F.lit("\n")).alias("text"))


def lanes(blocks: DataFrame) -> DataFrame:
    """Blocks with ``lane``: a and b in turn, by the order in which speakers first appear (PRJ-2)."""
    first = blocks.groupBy("call_id", "speaker").agg(F.min(F.struct("start_ms", "block_no")).alias("first"))
    rank = first.withColumn("r", F.row_number().over(Window.partitionBy("call_id").orderBy("first")))
    lane = rank.select("call_id", "speaker", F.when(F.col("r") % 2 == 1, "a").otherwise("b").alias("lane"))
    b, r = blocks.alias("b"), lane.alias("r")
    return b.join(r, (F.col("b.call_id") == F.col("r.call_id")) & F.col("b.speaker").eqNullSafe(F.col("r.speaker"))).select("b.*", "r.lane")


def turn_json(blocks: DataFrame) -> DataFrame:
    """Blocks as JSON objects, without energy (PRJ-1)."""
    return blocks.select("call_id", "block_no", F.to_json(F.struct("speaker", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "interrupting", "text")).alias("turn"))


def batches(blocks: DataFrame, size: int = 5) -> DataFrame:
    """Blocks in groups of `size` for one request each: call_id, batch, texts in order (GRP-7)."""
    b = blocks.withColumn("batch", F.floor((F.col("block_no") - 1) / size).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("block_no", utrim("text").alias("text"))))
    return b.groupBy("call_id", "batch").agg(F.transform(parts, lambda p: p["text"]).alias("texts"))


def context(blocks: DataFrame, reach: int = 2) -> DataFrame:
    """Each block with the texts of up to `reach` blocks before and after (GRP-10).

    Neighbours are met by block number: every block is sent to the 2 * reach + 1
    numbers around it, so no call comes together in one task.
    """
    b = blocks.select("call_id", "block_no", "text")
    spread = b.select("call_id", F.explode(F.sequence(F.col("block_no") - reach, F.col("block_no") + reach)).alias("at"), F.col("block_no").alias("from"), "text")
    own = spread.groupBy("call_id", "at").agg(F.array_sort(F.collect_list(F.struct("from", "text"))).alias("near"))
    own = own.where(F.exists("near", lambda x: x["from"] == F.col("at")))
    pick = lambda keep: F.transform(F.filter("near", keep), lambda x: x["text"])
    return own.select("call_id", F.col("at").alias("block_no"), pick(lambda x: x["from"] < F.col("at")).alias("before"), pick(lambda x: x["from"] > F.col("at")).alias("after"))


def pack_regions(periods: DataFrame, max_len: int, merge_gap: int, width: int = HOUR) -> DataFrame:
    """Periods of speech packed into chunks, in order (GRP-3).

    `periods`: call_id, start_ms, end_ms without overlaps. A period joins the chunk
    before it if the gap is at most `merge_gap` and the chunk then spans at most
    `max_len`. The rule depends on all cuts since the last gap above `merge_gap`, so
    the fold runs within the stretches between such gaps.
    """
    p = with_order(periods, "call_id", ["start_ms"], width, lag={"prev_end": "end_ms"})
    p = p.withColumn("opens", F.coalesce((F.col("start_ms") - F.col("prev_end") > merge_gap).cast("long"), F.lit(1)))
    p = with_order(p, "call_id", ["start_ms"], width, total={"island": "opens"})
    rows = p.groupBy("call_id", "island").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("r"))
    packed = rows.select("call_id", F.explode(_packed(max_len)(F.transform("r", lambda x: x["start_ms"]), F.transform("r", lambda x: x["end_ms"]))).alias("c"))
    return packed.select("call_id", F.col("c")[0].alias("start_ms"), F.col("c")[1].alias("end_ms"))


def _packed(max_len: int):
    """UDF: chunks as [start, end] of neighbouring periods, each as long as `max_len` allows."""

    def fold(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = []
        for a, z in zip(starts.tolist(), ends.tolist()):
            if out and z - out[-1][0] <= max_len:
                out[-1][1] = z
            else:
                out.append([a, z])
        return out

    return F.pandas_udf(lambda a, z: pd.Series([fold(x, y) for x, y in zip(a, z)]), "array<array<bigint>>")


def pack_lines(df: DataFrame, key: str, text: str = "text", limit: int = 6000) -> DataFrame:
    """Whole lines packed into chunks of about `limit` characters: key, chunk_no, chunk (GRP-8).

    A line is never split, so a chunk may be longer than the limit. Null and empty texts give none.
    """
    return df.where(F.char_length(text) > 0).select(key, F.posexplode(_packed_lines(limit)(text)).alias("chunk_no", "chunk"))


def _packed_lines(limit: int):
    def one(text: str) -> list[str]:
        lines = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
        out, begun, size = [], 0, 0
        for i, line in enumerate(lines):
            if size and size + len(line) + 1 > limit:
                out.append("\n".join(lines[begun:i]))
                begun, size = i, len(line)
            elif size:
                size += len(line) + 1
            else:
                begun, size = i, len(line)  # empty lines in front of a chunk are dropped
        return [*out, "\n".join(lines[begun:])] if size else out

    return F.pandas_udf(lambda texts: texts.map(one), "array<string>")
