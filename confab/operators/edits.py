"""Edited texts against their originals: guards, drift and quality."""

from __future__ import annotations

import zlib
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import plain, utrim

LENGTH_LIMIT, CONTAINED, FEW_WORDS = 1.4, 0.6, 6
#: Phrases that recognisers invent over silence.
PHRASES = ("titulky", "amara.org", "děkuji za pozornost", "thank you for watching", "přepis", "www.", ".cz/titulky", "produkce", "český rozhlas")


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Small letters without accents (TXT-5)."""
    return text.map(lambda t: None if t is None else plain(t))


def tokens(folded: Column, least: int = 1) -> Column:
    """Letters and digits of each word between white space; shorter ones left out (TXT-6)."""
    words = F.transform(F.split(folded, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(words, lambda w: F.char_length(w) >= least)


def contained(raw: Column, edited: Column) -> Column:
    """Share of the edited tokens that the raw ones hold; 1 if there are none (TXT-10).

    The words that are new are found by hash, once: they are the fold's state, since
    what stands in a lambda is computed again for every element.
    """
    n, new = F.size(edited), F.array_except(edited, F.coalesce(raw, F.array().cast("array<string>")))
    known = F.aggregate(
        edited, F.struct(F.lit(0).alias("n"), new.alias("new")), lambda s, w: F.struct((s["n"] + F.when(F.array_contains(s["new"], w), 0).otherwise(1)).alias("n"), s["new"].alias("new")), lambda s: s["n"]
    )
    return F.when(n == 0, 1.0).otherwise(known / F.greatest(n, F.lit(1)))


def strip_fences(text: Column) -> Column:
    """Without a code fence around it (TXT-9)."""
    t = utrim(text)
    opened = F.regexp_replace(t, r"^```[^\n]*\n?", "")
    return F.when(F.startswith(t, F.lit("```")), utrim(F.regexp_replace(opened, r"(^|\n)[ \t]*```[ \t]*$", ""))).otherwise(t)


def accept(df: DataFrame, raw: str = "raw", edited: str = "edited", out: str = "accepted") -> DataFrame:
    """The edited text if it passes the guards, else the raw one (TXT-7, TXT-8).

    Guards: not empty, not more than LENGTH_LIMIT times as long, and of its words (if
    they are at least FEW_WORDS) a share of CONTAINED is in the raw text.
    """
    e = df.withColumn("_e", strip_fences(F.coalesce(edited, F.lit("")))).withColumn("_er", tokens(fold("_e"))).withColumn("_rr", tokens(fold(F.coalesce(raw, F.lit("")))))
    ok = (F.char_length("_e") > 0) & (F.char_length("_e") <= LENGTH_LIMIT * F.char_length(raw)) & ((F.size("_er") < FEW_WORDS) | (contained(F.col("_rr"), F.col("_er")) >= CONTAINED))
    return e.withColumn(out, F.when(ok, F.col("_e")).otherwise(F.col(raw))).drop("_e", "_er", "_rr")


def numbers(text: Column) -> Column:
    """Numbers written in digits, without blanks, commas and dots inside (TXT-11)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d\s.,]*\d|\d)"), 1), lambda n: F.regexp_replace(n, r"[\s.,]", ""))


def drift(df: DataFrame, raw: str = "raw", edited: str = "edited") -> DataFrame:
    """Per row: length ratio, retention, novel words and novel numbers (TXT-10, SET-5).

    Novel words have at least three letters and come once; novel numbers keep repeats.
    """
    d = df.withColumn("_r", fold(raw)).withColumn("_e", fold(edited))
    retention = contained(tokens(F.col("_r")), tokens(F.col("_e")))
    novel = F.array_except(tokens(F.col("_e"), 3), tokens(F.col("_r"), 3))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.coalesce(numbers(F.col(raw)), none).alias("old"))
    fabricated = F.aggregate(
        numbers(F.col(edited)), start, lambda s, n: F.struct(F.when(F.array_contains(s["old"], n), s["out"]).otherwise(F.concat(s["out"], F.array(n))).alias("out"), s["old"].alias("old")), lambda s: s["out"]
    )
    return d.select(
        *df.columns,
        (F.char_length(edited) / F.greatest(F.char_length(raw), F.lit(1))).alias("length_ratio"),
        retention.alias("retention"),
        novel.alias("novel_words"),
        fabricated.alias("novel_numbers"),
    ).drop("_r", "_e")


def drift_report(df: DataFrame, *keys: str) -> DataFrame:
    """Totals of ``drift`` per group (AGG-12)."""
    d = drift(df)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("raw")).alias("raw_chars"), F.sum(F.char_length("edited")).alias("edited_chars"), F.sum(F.size("novel_words")).alias("novel"), F.max(F.size("novel_words")).alias("most_novel"), F.sum(F.size("novel_numbers")).alias("numbers"))


def repetition(text: Column) -> tuple[Column, Column]:
    """Number of words, and the share of five-word groups that repeat another (TXT-12)."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    # five shifted copies side by side: each is made once, not once a group
    shifted = F.arrays_zip(*(F.slice(words, i, F.greatest(n - 4, F.lit(0))).alias(f"w{i}") for i in range(1, 6)))
    grams = F.transform(shifted, lambda g: F.concat_ws(" ", g["w1"], g["w2"], g["w3"], g["w4"], g["w5"]))
    return n, F.when(n >= 5, 1.0 - F.size(F.array_distinct(grams)) / F.greatest(n - 4, F.lit(1))).otherwise(0.0)


def phrase_hits(text: Column, phrases: tuple[str, ...] = PHRASES) -> Column:
    """Which of the phrases a text holds (TXT-12)."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p))


@F.pandas_udf(T.DoubleType())
def compression(text: pd.Series) -> pd.Series:
    """Characters per byte of the compressed text (TXT-12)."""
    return text.map(lambda t: None if t is None else len(t) / max(1, len(zlib.compress(t.encode()))))


def quality_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with chars, words, repeat_5gram (4 places), compression (3 places) and hits (TXT-12)."""
    t = F.coalesce(text, F.lit(""))
    n, share = repetition(t)
    return df.withColumns({"chars": F.char_length(t), "words": n, "repeat_5gram": F.bround(share, 4), "compression": F.bround(compression(t), 3), "hits": phrase_hits(t)})


def _plain(word: str) -> str:
    """Letters and digits of a word in small letters without accents."""
    return "".join(filter(str.isalnum, plain(word)))


def gated(raw: str, edited: str) -> str:
    """The edited text without stretches that bring in a word of three letters or more (TXT-15).

    Such stretches are as before; words taken out stay out. A text of more than
    LENGTH_LIMIT times the length, or of which nothing is left, is as before as a whole.
    """
    if len(edited) > LENGTH_LIMIT * max(1, len(raw)):
        return raw
    old, new = raw.split(), edited.split()
    known = {w for w in map(_plain, old) if len(w) >= 3}
    strange = [len(p := _plain(w)) >= 3 and p not in known for w in new]
    pieces = (
        old[i:j] if kind in ("replace", "insert") and any(strange[k:m]) else new[k:m] for kind, i, j, k, m in SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    )
    return " ".join(w for piece in pieces for w in piece) or raw


@F.pandas_udf(T.StringType())
def gate_edits(raw: pd.Series, edited: pd.Series) -> pd.Series:
    """`gated` over columns; a null edit leaves the raw text."""
    return pd.Series([r if e is None or r is None else gated(r, e) for r, e in zip(raw, edited)])


def edits_of(old: list[str], new: list[str]) -> dict[tuple[int, bool], tuple[str, ...]]:
    """What an edit puts at each place (TXT-16): (i, True) in the gap before word i, (i, False) instead of word i.

    Places that are not listed stay as they are; a replacement stands at its first word, the others are empty.
    """
    out: dict[tuple[int, bool], tuple[str, ...]] = {}
    for kind, i, j, k, m in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if kind == "insert":
            out[i, True] = tuple(new[k:m])
        elif kind != "equal":
            out.update({(p, False): () for p in range(i, j)})
            out[i, False] = tuple(new[k:m])
    return out


def agreed(raw: str, candidates: list[str], need: int = 2) -> str:
    """The raw text with those edits that at least `need` candidates make alike (TXT-16)."""
    old = raw.split()
    votes = [edits_of(old, c.split()) for c in candidates]

    def at(i: int, gap: bool, otherwise: tuple[str, ...]) -> tuple[str, ...]:
        (value, n), *_ = Counter(v.get((i, gap), otherwise if not gap else ()) for v in votes).most_common(1)
        return value if n >= need else otherwise

    words = [w for i, own in enumerate(old) for w in (*at(i, True, ()), *at(i, False, (own,)))]
    return " ".join([*words, *at(len(old), True, ())]) or raw


def ensemble(need: int = 2):
    """UDF (raw, candidates ARRAY<STRING>): `agreed`; null candidates are left out, without any the raw text stays."""

    def one(raw: str | None, candidates) -> str | None:
        given = [c for c in (candidates if candidates is not None else []) if c is not None]
        return agreed(raw, given, need) if raw and given else raw

    return F.pandas_udf(lambda r, c: pd.Series([one(x, y) for x, y in zip(r, c)]), T.StringType())


def judge_payload(pairs: DataFrame, *keys: str, order: str = "block_no", labels: tuple[str, str] = ("RAW", "EDITED")) -> DataFrame:
    """Per group one text with its raw and edited texts side by side, numbered from 1 (TXT-18)."""
    parts = F.array_sort(F.collect_list(F.struct(order, "raw", "edited")))
    line = F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(f"] {labels[0]}: "), x["raw"], F.lit("\n["), (i + 1).cast("string"), F.lit(f"] {labels[1]}: "), x["edited"]))
    return pairs.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.array_join(line, "\n\n").alias("payload"))


def looks_failed(df: DataFrame, *keys: str, raw: str = "raw", edited: str = "edited", least: int = 120) -> DataFrame:
    """Per group, whether a long text came back as it was, which is what a failed request leaves (SNK-13)."""
    return df.groupBy(*keys).agg(F.bool_or((F.char_length(raw) > least) & (F.col(raw) == F.col(edited))).alias("failed"))


def vote(df: DataFrame, keys: list[str], value: str, order: str, need: int = 2) -> DataFrame:
    """The value with most votes in each group, if at least `need`; the first seen among equals (AGG-10, TXT-16)."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = n.where(F.col("votes") >= need).groupBy(*keys).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("_first"))).alias("b"))
    return best.select(*keys, f"b.{value}", "b.votes")
