"""Benchmarks, ratings and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from confab.operators.ordered import with_order


def metrics(runs: DataFrame, duration: str = "duration", elapsed: str = "elapsed") -> DataFrame:
    """`runs` with rtf (4 places) and speedup (2 places); null where a number is missing or 0 (AGG-11)."""
    d, e = F.nullif(F.col(duration), F.lit(0.0)), F.nullif(F.col(elapsed), F.lit(0.0))
    return runs.withColumn("rtf", F.bround(e / d, 4)).withColumn("speedup", F.bround(d / e, 2))


def fastest_first(runs: DataFrame, seconds: str = "elapsed") -> DataFrame:
    """Place of each run by time, missing last, and whether it is the fastest without an error (SRT-3). Equal times go by id."""
    late = F.coalesce(F.col(seconds), F.lit(1e15))
    r = with_order(runs.withColumns({"_all": F.lit(1), "_late": late, "_one": F.lit(1)}), "_all", ["_late", "id"], 3600, total={"place": "_one"})
    best = runs.where(F.col("error").isNull()).select(F.min_by("id", F.struct(late, "id")).alias("_best"))
    return r.join(F.broadcast(best)).select(*runs.columns, F.col("place").cast("int").alias("place"), F.coalesce(F.col("id") == F.col("_best"), F.lit(False)).alias("fastest"))  # one row


def judged(scores: DataFrame, keys: list[str], counts: list[str], means: list[str], examples: list[str] = [], order: str = "run") -> DataFrame:
    """Judges' runs per variant (AGG-9, AGG-15): medians of counts with their spread, means of scores, to two places, and examples.

    Columns that are not numeric have no value here: a text "3" is no number. Halves
    go to the even digit. `examples` are arrays; the first three of each of the first
    two runs (by `order`) are kept.
    """
    numeric = {f.name for f in scores.schema if isinstance(f.dataType, NumericType)}
    value = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("runs")]
    for c in counts:
        aggs += [F.bround(F.median(value(c)), 2).alias(f"{c}_median"), F.min(value(c)).alias(f"{c}_min"), F.max(value(c)).alias(f"{c}_max")]
    aggs += [F.bround(F.avg(value(c)), 2).alias(f"{c}_mean") for c in means]
    for c in examples:
        two = F.slice(F.array_sort(F.collect_list(F.struct(order, F.slice(F.coalesce(c, F.array()), 1, 3).alias("x")))), 1, 2)
        aggs.append(F.flatten(F.transform(two, lambda r: r["x"])).alias(f"{c}_examples"))
    return scores.groupBy(*keys).agg(*aggs)


def gate_of(fabricated: Column, hallucinations: Column) -> Column:
    """Whether a variant made something up: a number, or at the median a claim (AGG-15)."""
    return (F.size(F.coalesce(fabricated, F.array())) > 0) | (F.coalesce(hallucinations, F.lit(0.0)) > 0)


def keep_first(configs: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows that agree in `keys` the first by `order` (PRJ-17); null keys are equal."""
    rest = [c for c in configs.columns if c not in keys]
    g = configs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return g.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in configs.columns))


def excerpt(blocks: DataFrame, key: str = "call_id", before: int = 22, after: int = 1) -> DataFrame:
    """The stretch around the longest block of each group, the first of equals (PRJ-16). `blocks`: key, block_no (running), text."""
    top = blocks.groupBy(key).agg(F.max_by("block_no", F.struct(F.char_length("text"), -F.col("block_no"))).alias("_top"))
    return blocks.join(top, key).where(F.col("block_no").between(F.col("_top") - before, F.col("_top") + after)).drop("_top")


#: The line above each candidate of a bundle.
CANDIDATE, RULE = "\n\n===== CANDIDATE ", " =====\n"


def judge_bundle(runs: DataFrame) -> DataFrame:
    """Per track its candidates under letters: track, body, key (SNK-17). `runs`: track, config, text, note.

    Letters go on from Z as they are numbered: AA, AB and so on.
    """
    parts = F.array_sort(F.collect_list(F.struct("config", "text", "note")))
    letter = lambda i: F.concat(F.when(i >= 26, F.char(F.lit(64) + F.floor(i / 26))).otherwise(""), F.char(F.lit(65) + i % 26))
    body = F.transform("p", lambda x, i: F.concat(F.lit(CANDIDATE), letter(i), F.lit(RULE), F.trim(x["text"])))
    key = F.transform("p", lambda x, i: F.concat(letter(i), F.lit(" = "), x["config"], F.lit("  ("), x["note"], F.lit(")")))
    return runs.groupBy("track").agg(parts.alias("p")).select("track", F.array_join(body, "").alias("body"), F.array_join(key, "\n").alias("key"))


def quality(*axes: str) -> Column:
    """Mean of the axes that are known; 0 if none is."""
    known = F.array_compact(F.array(*axes))
    return F.when(F.size(known) == 0, 0.0).otherwise(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1)))


def ranked(variants: DataFrame, group: list[str], gate: Column, faithful: str, score: Column) -> DataFrame:
    """Place of each variant in its group: ungated before gated, then by faithfulness and quality (WIN-9)."""
    v = variants.withColumn("gated", F.coalesce(gate, F.lit(False))).withColumn("quality", score)
    w = Window.partitionBy(*group).orderBy("gated", F.desc(F.coalesce(faithful, F.lit(0.0))), F.desc("quality"), "seq")
    return v.withColumn("place", F.row_number().over(w))


def upsert_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Benchmark rows by id (SNK-10).

    A new run without an error replaces the old one but for its rating and notes; one
    with an error only sets the error of an old row.
    """
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    took = F.col("n.id").isNotNull() & (F.col("n.error").isNull() | F.col("o.id").isNull())
    keep = {"rating", "notes"}
    cols = []
    for c in old.columns:
        if c == "id":
            cols.append(F.coalesce("o.id", "n.id").alias("id"))
        elif c == "error":
            cols.append(F.when(F.col("n.id").isNotNull(), F.col("n.error")).otherwise(F.col("o.error")).alias(c))
        elif c in keep:
            cols.append(F.when(F.col("o.id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(took, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(*cols)


def rate(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    """`runs` with the latest valid rating of each id (SNK-11).

    Ratings are 1 to 5 or null (taken back); others, and those of unknown ids, are
    ignored. Missing notes are empty.
    """
    ok = ratings.where(F.col("rating").isNull() | F.col("rating").between(1, 5))
    last = ok.groupBy("id").agg(F.max_by(F.struct("rating", F.coalesce("notes", F.lit("")).alias("notes")), "seq").alias("r"))
    j = runs.drop("rating", "notes").join(runs.select("id", F.col("rating").alias("_r"), F.col("notes").alias("_n")), "id").join(last, "id", "left")
    has = F.col("r").isNotNull()
    return j.withColumn("rating", F.when(has, F.col("r.rating")).otherwise(F.col("_r"))).withColumn("notes", F.when(has, F.col("r.notes")).otherwise(F.col("_n"))).drop("r", "_r", "_n")


def scorecard(ranking: DataFrame) -> DataFrame:
    """Lines of a Markdown table, in order of place (SNK-12)."""
    line = F.concat_ws(" | ", F.col("place").cast("string"), "name", F.bround("quality", 2).cast("string"), F.when(F.col("gated"), "gated").otherwise("ok"))
    return ranking.select("place", F.concat(F.lit("| "), line, F.lit(" |")).alias("line")).orderBy("place")
