"""Queries pN_... of the operators of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.text import is_blank, millis
from confab.llm import bpe, leaks, pii, quantiles, runs, split, transcript


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def counting_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with text whose end is after their start, in milliseconds."""
    s = table(spark, folder, "segments").where(~is_blank("text") & (F.col("end") > F.col("start")))
    return s.select("call_id", "seq", "speaker", millis("start").alias("start_ms"), millis("end").alias("end_ms"))


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_runs(counting_segments(spark, folder), table(spark, folder, "tracks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_runs(spark, folder).where("events > 1").select("call_id", "first_seq", "last_seq")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_texts(table(spark, folder, "blocks"), ["call_id", "block_no"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece_no = 0").select("call_id", "block_no", "cut")


def p3_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces put together without their overlaps: the text again; the longest piece and overlap in bounds."""
    part = F.substr("piece", F.col("overlap") + 1)
    g = p3_pieces(spark, folder).groupBy("call_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", part.alias("t")))).alias("p"), F.max(F.char_length("piece")).alias("longest"), F.max("overlap").alias("most"))
    return g.select("call_id", "block_no", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), (F.col("longest") <= 1600).alias("fits"), (F.col("most") <= 120).alias("laps"))


QS = [0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]


def _run_times(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "transcriptions").select("id", "model", "elapsed_seconds", "audio_duration_seconds", "started_at")
    return t.dropDuplicates(["id"])


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of run times and audio lengths per model."""
    s = quantiles.sketch(_run_times(spark, folder), ["model"], ["elapsed_seconds", "audio_duration_seconds"])
    return quantiles.percentiles(quantiles.merged(s, ["model"]), ["model"], QS)


def p4_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile against the ranks of all values: n, and whether it keeps its bound."""
    t = _run_times(spark, folder)
    p = p4_percentiles(spark, folder)
    v = t.select("model", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("elapsed_seconds", "audio_duration_seconds")))).alias("x")).select("model", "x.*").where("v is not null and not isnan(v)")
    # distinct values with their counts first: a model with a third of all runs comes down to as many rows as it has values
    counts = v.groupBy("model", "metric", "v").agg(F.count(F.lit(1)).alias("c"))
    j = p.join(counts.withColumnsRenamed({"model": "m", "metric": "k"}), F.col("model").eqNullSafe(F.col("m")) & (F.col("metric") == F.col("k")))
    g = j.groupBy("model", "metric", "q", "n", "value", "max_rank_error").agg(F.sum(F.when(F.col("v") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"), F.sum("c").alias("all"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9))
    off = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto"))
    return g.select("model", "metric", "q", "n", ((off <= F.col("max_rank_error")) & (F.col("all") == F.col("n"))).alias("kept"))


def p4_merged_months(spark: SparkSession, folder: str) -> DataFrame:
    """The same from sketches kept per month, merged afterwards."""
    runs_ = _run_times(spark, folder).withColumn("month", F.substring("started_at", 1, 7))
    kept = quantiles.sketch(runs_, ["model", "month"], ["elapsed_seconds", "audio_duration_seconds"])
    return quantiles.percentiles(quantiles.merged(kept, ["model"]), ["model"], QS)


def _cleaned(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    return transcript.clean_blocks(table(spark, folder, "blocks"), table(spark, folder, "tracks"), with_text)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    c = _cleaned(spark, folder, False).where("idx is not null")
    kinds = F.array(*(F.when(on, F.lit(k)) for k, on in (("time", F.col("time")), ("filler", F.col("filler")), ("sound", F.col("sound")), ("label", F.col("label")), ("turn", F.col("turn_block") == F.col("block_no")))))
    return c.select("call_id", "block_no", F.explode(F.array_compact(kinds)).alias("kind"), "idx")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Clean turns in time order, each with its track's name."""
    return transcript.turns(_cleaned(spark, folder, True))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Ids turned back to text: the documents' texts again (null: empty)."""
    return bpe.decode(p6_ids(spark, folder))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the items that leaked into it, and how many of its passages."""
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with words mixed in or a few changed: 24 words, nine tenths of them in common."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leaks.leaked(docs, items, width=24, share=0.9, least_cosine=0.98, skip_unknown=True)


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with placeholders, and what they stand for."""
    return pii.find_personal(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p8_clean(spark, folder).select("doc_id", F.explode(F.array_distinct("found")).alias("f"))
    return found.select("doc_id", "f.kind", "f.found")


QUERIES = {f.__name__: f for f in (p2_found, p2_runs, p3_found, p3_pieces, p3_joined, p4_percentiles, p4_merged_months, p4_ranks, p5_found, p5_turns, p6_ids, p6_decoded, p7_found, p7_leaks, p7_near, p8_found, p8_clean)}
