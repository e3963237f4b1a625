"""What to do with each track: plans from warnings, rosters, twins of envelopes, look-ups.

Warnings are the rows of ``signals.shared_voices``; a plan has one row a selected
track: call_id, idx, action (keep, subtract, drop), subtract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.text import is_blank

#: How alike envelopes of one channel pair and of one track pair are.
SAME_CHANNELS, SAME_TRACKS = 0.98, 0.995


def resolve(selected: DataFrame, warnings: DataFrame) -> DataFrame:
    """What to do with each selected track: call_id, idx, action, subtract (SET-4).

    A mix that holds a selected component has it subtracted; of two takes one is
    dropped, rather one that is neither a component nor such a mix; those two are
    never dropped, and neither is the last track. Warnings about tracks that are not
    selected change nothing but which tracks are components.
    """
    kind = selected.schema["idx"].dataType.simpleString()
    sel = selected.select("call_id", "idx").distinct()
    own = sel.groupBy("call_id").agg(F.collect_set("idx").alias("sel"))
    w = warnings.join(own, "call_id").withColumn("both", F.array_contains("sel", F.col("mix_idx")) & F.array_contains("sel", F.col("component_idx")))
    holds = F.col("kind") == "contains"
    parts = w.groupBy("call_id").agg(F.collect_set(F.when(holds, F.col("component_idx"))).alias("components"), F.collect_set(F.when(holds & F.col("both"), F.col("mix_idx"))).alias("mixes"))
    kept = F.concat("components", "mixes")
    takes = w.where(~holds & F.col("both")).join(parts, "call_id")
    gone = takes.select(
        "call_id",
        F.when(~F.array_contains(kept, F.col("mix_idx")), F.col("mix_idx")).when(~F.array_contains(kept, F.col("component_idx")), F.col("component_idx")).otherwise(F.greatest("mix_idx", "component_idx")).alias("idx"),
        kept.alias("kept"),
    ).where(~F.array_contains("kept", F.col("idx")))
    all_gone = gone.groupBy("call_id").agg(F.collect_set("idx").alias("gone"))
    refs = w.where(holds & F.col("both")).groupBy("call_id", F.col("mix_idx").alias("idx")).agg(F.array_sort(F.collect_set("component_idx")).alias("subtract"))
    out = sel.join(own, "call_id").join(all_gone, "call_id", "left").join(refs, ["call_id", "idx"], "left")
    drop = F.coalesce(F.array_contains("gone", F.col("idx")) & (F.size(F.array_except("sel", "gone")) > 0), F.lit(False))
    return out.select("call_id", "idx", F.when(drop, "drop").when(F.col("subtract").isNotNull(), "subtract").otherwise("keep").alias("action"), F.coalesce("subtract", F.array().cast(f"array<{kind}>")).alias("subtract"))


def applied(selected: DataFrame, saved: DataFrame, chosen: DataFrame, detected: DataFrame) -> DataFrame:
    """The plan that counts, of each call (SIG-9): call_id, idx, action, subtract, origin.

    `saved` (plan rows of an earlier run) wins over what the user `chosen`
    (call_id, idx, subtract), and that over the `detected` plan. A user's choice
    drops no track. A plan that would drop every selected track drops none.
    """
    sel = selected.select("call_id", "idx").distinct()
    none = F.array().cast(detected.schema["subtract"].dataType)
    s = saved.select("call_id", "idx", F.col("action").alias("s_action"), F.col("subtract").alias("s_subtract"))
    c = chosen.where(F.size("subtract") > 0).select("call_id", "idx", F.col("subtract").alias("c_subtract"))
    d = detected.select("call_id", "idx", F.col("action").alias("d_action"), F.col("subtract").alias("d_subtract"))
    of = saved.select("call_id").distinct().withColumn("has_saved", F.lit(True))
    by = c.select("call_id").distinct().withColumn("has_chosen", F.lit(True))
    j = sel.join(s, ["call_id", "idx"], "left").join(c, ["call_id", "idx"], "left").join(d, ["call_id", "idx"], "left").join(of, "call_id", "left").join(by, "call_id", "left")
    origin = F.when(F.col("has_saved"), "saved").when(F.col("has_chosen"), "chosen").otherwise("detected")
    subtract = F.coalesce(F.when(origin == "saved", F.col("s_subtract")).when(origin == "chosen", F.col("c_subtract")).otherwise(F.col("d_subtract")), none)
    drop = F.when(origin == "saved", F.col("s_action").isNull() | (F.col("s_action") == "drop")).when(origin == "chosen", F.lit(False)).otherwise(F.coalesce(F.col("d_action") == "drop", F.lit(False)))
    p = j.select("call_id", "idx", subtract.alias("subtract"), drop.alias("gone"), origin.alias("origin"))
    some = p.groupBy("call_id").agg((~F.bool_and("gone")).alias("some"))
    action = F.when(F.col("gone") & F.col("some"), "drop").when(F.size("subtract") > 0, "subtract").otherwise("keep")
    return p.join(some, "call_id").select("call_id", "idx", action.alias("action"), "subtract", "origin")


def roster(tracks: DataFrame, plan: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Who is on a call: call_id, idx, audio, place, name, lane, ghost, removes, start, set_aside (SIG-10).

    `tracks`: call_id, idx, title; `plan` as of ``resolve``; `starts`: call_id, idx,
    start of speech. Kept tracks are named by their title or, in order, Speaker n of
    the kept ones; lanes are a and b in turn; ghost is the name of the first voice
    that is taken out. Tracks set aside have no place, lane or ghost.
    """
    kind = tracks.schema["idx"].dataType.simpleString()
    t = tracks.select("call_id", "idx", "title").distinct().join(plan.select("call_id", "idx", "action", "subtract"), ["call_id", "idx"], "left")
    t = t.select("call_id", F.struct("idx", F.nullif(F.when(~is_blank("title"), F.col("title")), F.lit("")).alias("title"), F.coalesce(F.col("action") == "drop", F.lit(False)).alias("gone"), F.coalesce("subtract", F.array().cast(f"array<{kind}>")).alias("removes")).alias("t"))
    g = t.groupBy("call_id").agg(F.array_sort(F.collect_list("t")).alias("all"))  # a handful of tracks a call
    kept = F.filter("all", lambda x: ~x["gone"])
    g = g.withColumn("kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("all")))
    named = F.transform("kept", lambda x, i: F.struct(x["idx"].alias("idx"), F.coalesce(x["title"], F.concat(F.lit("Speaker "), (i + 1).cast("string"))).alias("name"), i.alias("place")))
    g = g.withColumn("named", named).select("call_id", "named", F.posexplode("all").alias("audio", "x"))
    mine = F.try_element_at(F.filter("named", lambda n: n["idx"] == F.col("x.idx")), F.lit(1))
    ghost = F.try_element_at(F.filter("named", lambda n: n["idx"] == F.try_element_at(F.col("x.removes"), F.lit(1))), F.lit(1))["name"]
    out = g.select(
        "call_id", F.col("x.idx").alias("idx"), "audio", mine["place"].alias("place"),
        F.coalesce(mine["name"], F.col("x.title"), F.lit("Another recording")).alias("name"),
        F.when(mine.isNotNull(), F.when(mine["place"] % 2 == 0, "a").otherwise("b")).alias("lane"),
        F.when(mine.isNotNull(), ghost).alias("ghost"), F.col("x.removes").alias("removes"), mine.isNull().alias("set_aside"),
    )
    if starts is None:
        return out.withColumn("start", F.lit(0.0))
    return out.join(starts.select("call_id", "idx", "start"), ["call_id", "idx"], "left").withColumn("start", F.coalesce("start", F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two lists; 0 if it is not defined or their lengths differ (AGG-6)."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    n = F.size(a)
    dot = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    xy, xx, yy = dot(a, b) - add(a) * add(b) / F.greatest(n, F.lit(1)), dot(a, a) - add(a) * add(a) / F.greatest(n, F.lit(1)), dot(b, b) - add(b) * add(b) / F.greatest(n, F.lit(1))
    return F.when((n != F.size(b)) | (n == 0) | (xx <= 1e-15 * dot(a, a)) | (yy <= 1e-15 * dot(b, b)), 0.0).otherwise(F.coalesce(F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0)) * F.greatest(yy, F.lit(0.0)))), F.lit(0.0)))


def same_channels(envelopes: DataFrame) -> DataFrame:
    """call_id, idx, same: whether a track's first two channels are one; null for one channel (SIG-11).

    `envelopes`: call_id, idx, channel, levels.
    """
    at = lambda k: F.max(F.when(F.col("channel") == k, F.col("levels")))
    g = envelopes.groupBy("call_id", "idx").agg(at(0).alias("x"), at(1).alias("y"))
    return g.select("call_id", "idx", F.when(F.col("y").isNotNull(), correlation(F.col("x"), F.col("y")) >= SAME_CHANNELS).alias("same"))


def twins(envelopes: DataFrame) -> DataFrame:
    """call_id, idx, duplicate_of: the first earlier track with the same envelope of the first channel (SIG-11)."""
    e = envelopes.where("channel = 0").select("call_id", "idx", "levels")
    earlier = e.select("call_id", F.col("idx").alias("of"), F.col("levels").alias("before"))
    p = e.join(earlier, "call_id").where((F.col("of") < F.col("idx")) & (correlation(F.col("levels"), F.col("before")) >= SAME_TRACKS))
    return p.groupBy("call_id", "idx").agg(F.min("of").alias("duplicate_of"))


def drawn_envelope(envelopes: DataFrame, tracks: DataFrame) -> DataFrame:
    """The one series that stands for a track: call_id, idx, levels (WIN-8).

    `tracks`: call_id, idx, channels, pinned (channel chosen by the user, or null),
    same (``same_channels``). One channel or equal ones: the first; a pinned one:
    that; else the mean over the channels at hand, as long as the shortest. Null if
    there is none.
    """
    t = tracks.select("call_id", "idx", F.when((F.col("channels") <= 1) | F.coalesce("same", F.lit(False)), F.lit(0)).otherwise(F.col("pinned")).alias("only"))
    j = t.join(envelopes, ["call_id", "idx"], "left").where(F.col("only").isNull() | F.col("channel").isNull() | (F.col("channel") == F.col("only")))
    g = j.groupBy("call_id", "idx").agg(F.collect_list("levels").alias("all"))
    n = F.array_min(F.transform("all", lambda e: F.size(e)))
    mean = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate("all", F.lit(0.0), lambda s, e: s + F.element_at(e, i)) / F.size("all"))
    out = g.select("call_id", "idx", F.when(F.size("all") == 0, None).when(n == 0, F.array().cast("array<double>")).otherwise(mean).alias("levels"))
    return t.select("call_id", "idx").distinct().join(out, ["call_id", "idx"], "left")


def role_of(roles: Column, idx: Column) -> Column:
    """The role of a track among an array of roles; null if it has none (ARR-4)."""
    return F.try_element_at(F.filter(roles, lambda r: r["idx"] == idx), F.lit(1))


def speakers(roles: Column) -> Column:
    """Roles that give a transcript: all but duplicates (ARR-4)."""
    return F.filter(roles, lambda r: r["kind"] != "duplicate")


def changes_nothing(roles: Column) -> Column:
    """Whether every track is kept as it is (ARR-4)."""
    return F.forall(roles, lambda r: r["kind"] == "keep")
