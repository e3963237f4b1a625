"""Echoes: the same words heard on two speakers' tracks (JON-1)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import match_key, utrim
from confab.operators.ordered import with_order
from confab.session import checkpointed

MAX_GAP_MS, SIMILARITY, MIN_CHARS = 1500, 0.60, 12


def in_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of `a` and a step for each of `b`."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for c in b:
        if m := free & at.get(c, 0):
            free = (free + m | free - m) & full
    return len(a) - free.bit_count()


def similar(threshold: float):
    """UDF: whether the Ratcliff-Obershelp ratio of two strings, in this order, reaches the threshold (TXT-2).

    Empty strings are like nothing. What the ratio counts is a common subsequence, so
    the longest one bounds it from above; that spares most pairs the comparison itself.
    """

    def one(x: str | None, y: str | None) -> bool:
        if not x or not y or 2 * min(len(x), len(y)) < threshold * (len(x) + len(y)) or 2 * in_common(x, y) < threshold * (len(x) + len(y)):
            return False
        return SequenceMatcher(None, x, y).ratio() >= threshold

    return F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool), T.BooleanType())


def candidates(blocks: DataFrame, max_gap: int = MAX_GAP_MS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (a, b) of blocks of different speakers whose times overlap or lie within `max_gap`.

    A band self-join: both sides are keyed by call and time bucket; a block is in
    every bucket it reaches into, and a pair is kept in the bucket where the later
    one starts. Pairs are few, as blocks of one call hardly overlap.
    """
    bucket = 60_000
    b = blocks.where(F.char_length(utrim("text")) >= min_chars).select("call_id", "block_no", "speaker", "start_ms", "end_ms", "energy", "text", *(["key"] if "key" in blocks.columns else []))
    left = b.select(*(F.col(c).alias(f"a_{c}") for c in b.columns), F.explode(F.sequence(F.floor(F.col("start_ms") / bucket), F.floor((F.greatest("start_ms", "end_ms") + max_gap) / bucket))).alias("slot"))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns), F.floor(F.col("start_ms") / bucket).alias("slot2"))
    later = F.struct("a_start_ms", "a_end_ms", "a_block_no") < F.struct(F.col("b_start_ms").alias("a_start_ms"), F.col("b_end_ms").alias("a_end_ms"), F.col("b_block_no").alias("a_block_no"))
    near = F.greatest("a_start_ms", "b_start_ms") - F.least("a_end_ms", "b_end_ms") <= max_gap
    on = (F.col("a_call_id") == F.col("b_call_id")) & (F.col("slot") == F.col("slot2")) & later & ~F.col("a_speaker").eqNullSafe(F.col("b_speaker")) & (F.col("b_start_ms") - F.col("a_end_ms") <= max_gap) & near
    return left.join(right, on).drop("slot", "slot2", "b_call_id").withColumnRenamed("a_call_id", "call_id")


def loser_is_a() -> Column:
    """Whether a is the weaker copy: quieter, else shorter, else later (TXT-3)."""
    la, lb = F.char_length(utrim("a_text")), F.char_length(utrim("b_text"))
    return F.when(F.col("a_energy") != F.col("b_energy"), F.col("a_energy") < F.col("b_energy")).when(la != lb, la < lb).otherwise(F.col("a_start_ms") >= F.col("b_start_ms"))


def echo_pairs(blocks: DataFrame, threshold: float = SIMILARITY, **limits: int) -> DataFrame:
    """Candidates that say nearly the same: call_id, a_no, b_no, order columns, a_loses.

    Cheap conditions come first; the text comparison runs on what they leave.
    """
    c = candidates(blocks.withColumn("key", match_key("text")), **limits)  # a key is made once a block, not once a pair
    a, b = F.char_length("a_key"), F.char_length("b_key")
    c = c.where(2 * F.least(a, b) >= threshold * (a + b)).withColumn("same", similar(threshold)("a_key", "b_key"))
    return c.where("same").select("call_id", F.struct("a_start_ms", "a_end_ms", "a_block_no").alias("a"), F.struct("b_start_ms", "b_end_ms", "b_block_no").alias("b"), loser_is_a().alias("a_loses"))


def drop_echoes(blocks: DataFrame, threshold: float = SIMILARITY, **limits: int) -> DataFrame:
    """Blocks without the weaker copies (JON-1).

    Pairs are settled in order: a copy that was already dropped drops nothing. Pairs
    only interact through shared blocks close in time, so they are settled within
    runs of pairs that overlap in time, not within whole calls.
    """
    # written once: what follows reads the few pairs several times
    pairs = checkpointed(echo_pairs(blocks, threshold, **limits)).withColumn("start_ms", F.col("a.a_start_ms")).withColumn("until", F.greatest(F.col("a.a_end_ms"), F.col("b.b_end_ms"), F.col("b.b_start_ms")))
    pairs = pairs.withColumn("a_no", F.col("a.a_block_no")).withColumn("b_no", F.col("b.b_block_no"))
    p = with_order(pairs, "call_id", ["start_ms", "a_no", "b_no"], reach={"reach": "until"})
    p = p.withColumn("opens", F.coalesce((F.col("start_ms") > F.col("reach")).cast("long"), F.lit(1)))
    p = with_order(p, "call_id", ["start_ms", "a_no", "b_no"], total={"island": "opens"})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["a"].map(lambda x: tuple(x.values())), pdf["b"].map(lambda x: tuple(x.values())), pdf["a_loses"]))
        gone: set = set()
        for a, b, a_loses in rows:
            if a not in gone and b not in gone:
                gone.add(a if a_loses else b)
        return pd.DataFrame({"call_id": pdf["call_id"].iloc[0], "block_no": [x[2] for x in gone]}, columns=["call_id", "block_no"])

    kind = blocks.schema["block_no"].dataType.simpleString()
    gone = p.groupBy("call_id", "island").applyInPandas(settle, f"call_id string, block_no {kind}")
    return blocks.join(gone.distinct(), ["call_id", "block_no"], "left_anti")
