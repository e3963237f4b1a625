"""Recogniser tokens and words: grouping, bucketing, spacing and re-timing."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import plain, utrim
from confab.operators.ordered import with_order

WORD = "struct<start:double,end:double,text:string,lead_space:boolean>"
SEGMENT_GAP_MS = 600
#: Rows of a chunk where the order is a running number.
ROWS = 100_000
#: Segments of a chunk where the order is (segment, position in it).
SEGMENTS = 100


def spaced_words(tokens: DataFrame, order: tuple[str, ...] = ("seq",), width: int = ROWS) -> DataFrame:
    """Words of a token stream with lead_space from the spacing tokens between them (GRP-5).

    `tokens`: key, seq, type, text, start_ms, end_ms. Only tokens of type 'word' with
    both times are words; a non-empty 'spacing' since the word before gives the blank;
    tokens of other types neither give nor clear one. `order`: the columns that tokens
    are ordered by, `width`: the stretch of the first that is a chunk.
    """
    t = tokens.withColumn("is_word", ((F.col("type") == "word") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).cast("long")).fillna({"is_word": 0})
    t = with_order(t, "key", [*order], width, total={"upto": "is_word"})
    own = F.col("is_word") == 1
    g = t.groupBy("key", (F.col("upto") - F.col("is_word")).alias("word_no")).agg(
        F.max((F.col("type") == "spacing") & (F.coalesce(F.char_length("text"), F.lit(0)) > 0)).alias("lead_space"),
        F.max(F.when(own, F.struct(*order, "start_ms", "end_ms", "text"))).alias("w"),
    )
    return g.where("w is not null").select("key", *(f"w.{c}" for c in order), "w.start_ms", "w.end_ms", "w.text", F.coalesce("lead_space", F.lit(False)).alias("lead_space"))


def coalesce_words(words: DataFrame, gap_ms: int = SEGMENT_GAP_MS, order: tuple[str, ...] = ("seq",), width: int = ROWS) -> DataFrame:
    """Words to segments: a new one after a pause over `gap_ms` or a sentence's end (GRP-4).

    `words`: key, seq, start_ms, end_ms, text, lead_space; `order` and `width` as above. Returns key, segment_no, start_ms, end_ms, words, text.
    """
    w = with_order(words, "key", [*order], width, lag={"prev_end": "end_ms", "prev_text": "text"})
    opens = F.col("prev_text").isNull() | (F.col("start_ms") - F.col("prev_end") > gap_ms) | F.col("prev_text").rlike(r"(?U)[.!?]\s*$")
    w = with_order(w.withColumn("opens", opens.cast("long")), "key", [*order], width, total={"segment_no": "opens"})
    parts = F.array_sort(F.collect_list(F.struct(*order, "text", "lead_space", "end_ms")))
    text = F.array_join(F.transform("p", lambda x, i: F.when((i > 0) & x["lead_space"], F.concat(F.lit(" "), x["text"])).otherwise(x["text"])), "")
    g = w.groupBy("key", "segment_no").agg(F.min(F.struct(*order, "start_ms"))["start_ms"].alias("start_ms"), parts.alias("p"))
    return g.select("key", "segment_no", "start_ms", F.element_at("p", -1)["end_ms"].alias("end_ms"), F.size("p").alias("words"), utrim(text).alias("text"))


def token_words(tokens: DataFrame, order: tuple[str, ...] = ("seq",), width: int = ROWS) -> DataFrame:
    """Sub-word tokens to words: a token that begins with a blank begins a word (GRP-6).

    `tokens`: key, seq, text, start_ms, end_ms; `order` and `width` as above.
    """
    t = tokens.withColumn("opens", F.startswith("text", F.lit(" ")).cast("long"))
    t = with_order(t, "key", [*order], width, total={"word_no": "opens"})
    parts = F.array_sort(F.collect_list(F.struct(*order, "text", "start_ms", "end_ms")))
    g = t.groupBy("key", "word_no").agg(parts.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    text = utrim(F.array_join(F.transform("p", lambda x: x["text"]), ""))
    return g.select("key", *(first[c].alias(c) for c in order), first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), text.alias("text"), F.startswith(first["text"], F.lit(" ")).alias("lead_space"))


def bucket_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Words dealt out to segments by count, not by time (JON-7).

    `segments`: key, seq, text; `words`: key, word_no (from 0 in order), text. Each
    segment takes as many words as its text has, in order; words left over are
    dropped. An equi-join on (key, word number): segments are exploded to the numbers
    they take.
    """
    s = segments.withColumn("n", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda x: x != "")).cast("long"))
    s = with_order(s, "key", ["seq"], ROWS, total={"upto": "n"}).where("n > 0")
    own = s.select("key", "seq", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("word_no"))
    parts = F.array_sort(F.collect_list(F.struct("word_no", F.col("text"))))
    return own.join(words.select("key", "word_no", "text"), ["key", "word_no"]).groupBy("key", "seq").agg(F.transform(parts, lambda p: p["text"]).alias("words"))


def offset_words(words: Column, seconds: Column) -> Column:
    """Words of a chunk on the recording's clock; untimed words are dropped, texts stripped (TXT-21)."""
    kept = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    return F.transform(kept, lambda w: F.struct((w["start"] + seconds).alias("start"), (w["end"] + seconds).alias("end"), utrim(w["text"]).alias("text"), F.startswith(w["text"], F.lit(" ")).alias("lead_space")))


def word_times(words: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start of the first timed word and end of the last, or the segment's own times (TXT-20)."""
    timed = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    return F.coalesce(F.try_element_at(timed, F.lit(1))["start"], start), F.coalesce(F.try_element_at(timed, F.lit(-1))["end"], end)


def retime(words: list[dict], text: str) -> list[dict]:
    """The words of an edited text with times from the words it was made of (TXT-17).

    Equal words keep their times; a stretch that was replaced shares those of the
    words it replaces in proportion; an added word stands midway between its timed
    neighbours.
    """
    new = text.split()
    times: list[tuple[float, float] | None] = [None] * len(new)
    if words:
        same = SequenceMatcher(None, [plain(w["text"]) for w in words], [plain(t) for t in new], autojunk=False)
        for kind, a, z, b, y in same.get_opcodes():
            if kind in ("equal", "replace"):
                for k in range(b, y):
                    w = words[min(z - 1, a + (k - b) * (z - a) // (y - b))]
                    times[k] = (w["start"], w["end"])
        later: list[tuple[float, float] | None] = [None] * (len(new) + 1)
        for k in range(len(new) - 1, -1, -1):
            later[k] = times[k] or later[k + 1]
        for k in range(len(new)):
            if times[k] is None:
                left, right = times[k - 1] if k else None, later[k]
                at = (left[1] + right[0]) / 2 if left and right else left[1] if left else right[0] if right else 0.0
                times[k] = (at, at)
    return [{"start": (t or (0.0, 0.0))[0], "end": (t or (0.0, 0.0))[1], "text": w, "lead_space": k > 0} for k, (w, t) in enumerate(zip(new, times))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("lead_space", T.BooleanType())])))
def realign(words: pd.Series, text: pd.Series) -> pd.Series:
    """`retime` over columns; null words count as none, null texts give no words."""
    return pd.Series([retime([] if w is None else list(w), t or "") for w, t in zip(words, text)])
