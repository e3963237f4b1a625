"""Bleed of one microphone into another: lagged correlation per window, verdicts, probes (SIG-12 to SIG-14, AGG-13)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators import signals

#: Fixed values of the detector.
AUDIBLE, MAX_LAG_MS, TOLERANCE_MS = 0.15, 30, 2
RHO_CLEAN, RHO_STRONG, CONSISTENT, MUTUAL = 0.12, 0.22, 0.6, 0.30
PAIR = ("call_id", "a_idx", "b_idx")


def _tolerance(rate: int) -> int:
    return max(2, rate * TOLERANCE_MS // 1000)


def lagged(rate: int):
    """UDF (a, b): lag of the strongest correlation within MAX_LAG_MS and its strength; a positive lag: a follows b (SIG-12)."""
    most = rate * MAX_LAG_MS // 1000

    def one(x, y) -> tuple[int, float]:
        x, y = np.asarray(x, float), np.asarray(y, float)
        x, y = x - x.mean(), y - y.mean()
        size = 1 << (len(x) + len(y) - 1).bit_length()
        c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
        c = np.concatenate([c[-most:], c[: most + 1]]) if most else c[:1]
        c = np.abs(c) / ((np.sqrt(x @ x) + 1e-12) * (np.sqrt(y @ y) + 1e-12))
        k = int(np.argmax(c))
        return k - most, float(c[k])

    return F.pandas_udf(lambda a, b: pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["lag", "rho"]), "lag int, rho double")


def window_lags(chunks: DataFrame, rate: int) -> DataFrame:
    """call_id, a_idx, b_idx, window, active, lag, rho of each full window of 250 ms of each pair of tracks (SIG-12).

    Samples meet by call and chunk and are sent to the two windows that hold them;
    no task holds a track.
    """
    size = signals.hop(rate)
    both = chunks.select("call_id", "chunk", F.col("idx").alias("a_idx"), F.col("samples").alias("x")).join(chunks.select("call_id", "chunk", F.col("idx").alias("b_idx"), F.col("samples").alias("y")), ["call_id", "chunk"]).where("a_idx < b_idx")
    n = F.least(F.size("x"), F.size("y"))
    both = both.select(*PAIR, "chunk", F.slice("x", 1, n).alias("x"), F.slice("y", 1, n).alias("y"))
    sums = signals.pair_sums(chunks).groupBy(*PAIR).agg(*(F.sum(c).alias(c) for c in ("n", "aa", "bb")))
    level = sums.select(*PAIR, (signals.rms_of(F.col("aa"), F.col("n")) + 1e-12).alias("ra"), (signals.rms_of(F.col("bb"), F.col("n")) + 1e-12).alias("rb"))
    sent = both.withColumn("window", F.explode(F.filter(F.array("chunk", F.col("chunk") - 1), lambda w: w >= 0)))
    w = sent.groupBy(*PAIR, "window").agg(F.array_sort(F.collect_list(F.struct("chunk", "x", "y"))).alias("c"))
    w = w.select(*PAIR, "window", F.flatten(F.transform("c", lambda c: c["x"])).alias("x"), F.flatten(F.transform("c", lambda c: c["y"])).alias("y")).where(F.size("x") == 2 * size)
    w = w.withColumn("v", lagged(rate)("x", "y")).withColumn("s", signals._pair_sums("x", "y")).join(level, list(PAIR))
    loud = (signals.rms_of(F.col("s.aa"), F.col("s.n")) > AUDIBLE * F.col("ra")) & (signals.rms_of(F.col("s.bb"), F.col("s.n")) > AUDIBLE * F.col("rb"))
    return w.select(*PAIR, "window", loud.alias("active"), "v.lag", "v.rho")


def analyse(lags: DataFrame, rate: int) -> DataFrame:
    """Per pair, from ``window_lags``: rho, lag, direction, consistency, symmetry, n_active (SIG-12).

    The dominant lag is the highest of the lags' histogram, weighted by strength and
    smoothed over neighbours; rho is the median of the windows that agree with it.
    Pairs with fewer than two windows where both speak have rho 0 and no direction.
    """
    most, tol = rate * MAX_LAG_MS // 1000, _tolerance(rate)
    on = lags.where("active")
    near = F.array(*(F.struct((F.col("lag") + d).alias("at"), (F.col("rho") * w).alias("mass")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))))
    hist = on.select(*PAIR, F.explode(near).alias("h")).where(F.abs("h.at") <= most).groupBy(*PAIR, F.col("h.at").alias("at")).agg(F.round(F.sum("h.mass"), 12).alias("mass"))
    side = lambda keep: F.sum(F.when(keep, F.col("mass")).otherwise(0.0))
    top = hist.groupBy(*PAIR).agg(F.max_by("at", F.struct("mass", -F.col("at"))).alias("lag"), side(F.col("at") > tol).alias("after"), side(F.col("at") < -tol).alias("before"))
    j = on.withColumnRenamed("lag", "own").join(top, list(PAIR))
    agrees = F.abs(F.col("own") - F.col("lag")) <= tol
    m = j.groupBy(*PAIR).agg(
        F.first("lag").alias("lag"), F.coalesce(F.median(F.when(agrees, F.col("rho"))), F.median("rho")).alias("rho"),
        F.when(F.count_if(agrees) == 0, 1.0).otherwise(F.avg(agrees.cast("double"))).alias("consistency"),
        (F.least(F.first("after"), F.first("before")) / (F.greatest(F.first("after"), F.first("before")) + 1e-12)).alias("symmetry"), F.count(F.lit(1)).alias("n_active"),
    )
    every = lags.select(*PAIR).distinct().join(m, list(PAIR), "left")
    few = F.coalesce("n_active", F.lit(0)) < 2
    direction = F.when(few, "none").when(F.abs("lag") <= tol, "ambiguous-zero-lag").when(F.col("lag") > 0, "B->A").otherwise("A->B")
    value = lambda c, empty: F.when(few, F.lit(empty)).otherwise(F.col(c)).alias(c)
    return every.select(*PAIR, value("rho", 0.0), value("lag", 0), direction.alias("direction"), value("consistency", 0.0), value("symmetry", 0.0), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


def decide(metrics: DataFrame) -> DataFrame:
    """``analyse``'s rows with verdict and tier: auto-clean, ask or refuse (SIG-13)."""
    clean = (F.col("rho") < RHO_CLEAN) | (F.col("n_active") < 2)
    mutual = (F.col("symmetry") > MUTUAL) & (F.col("rho") >= RHO_STRONG)
    sure = (F.col("rho") >= RHO_STRONG) & (F.col("consistency") >= CONSISTENT) & F.col("direction").isin("B->A", "A->B")
    zero = F.col("direction") == "ambiguous-zero-lag"
    verdict = F.when(clean, "no-bleed").when(mutual, "mutual").when(sure, F.concat(F.lit("bleed "), "direction")).when(zero, "ambiguous").otherwise(F.concat(F.lit("bleed? "), "direction"))
    tier = F.when(clean, "auto-clean").when(mutual, "refuse").when(sure, "auto-clean").when(zero, "refuse").otherwise("ask")
    return metrics.withColumn("verdict", verdict).withColumn("tier", tier)


def gating_mask(lags: DataFrame, metrics: DataFrame, rate: int, least: float = RHO_CLEAN) -> DataFrame:
    """call_id, a_idx, b_idx, window, gated: windows that hold a delayed copy of the other track (SIG-13)."""
    m = metrics.select(*PAIR, F.col("lag").alias("main"))
    on = F.col("active") & (F.abs(F.col("lag") - F.col("main")) <= _tolerance(rate)) & (F.col("rho") >= least)
    return lags.join(m, list(PAIR)).select(*PAIR, "window", on.alias("gated"))


def sweep(decided: DataFrame, *keys: str) -> DataFrame:
    """Statistics of many pairs per group: mean, median, 95th percentile and maximum of rho, pairs of each tier, the commonest tier (AGG-13).

    Of equally common tiers the first in the order auto-clean, ask, refuse is taken.
    """
    tiers = ("auto-clean", "ask", "refuse")
    n = {t: F.count_if(F.col("tier") == t) for t in tiers}
    modal = F.array_max(F.array(*(F.struct(n[t].alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(tiers))))["t"]
    sure = F.count_if(F.col("verdict").startswith("bleed ") & (F.col("tier") == "auto-clean"))
    return decided.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"), F.percentile("rho", F.lit(0.5)).alias("p50"), F.percentile("rho", F.lit(0.95)).alias("p95"), F.max("rho").alias("max"),
        *(n[t].alias(t.replace("-", "_")) for t in tiers), modal.alias("tier"), sure.alias("sure"),
    )


def level_db(rms: Column) -> Column:
    """Level in dB of full scale (SIG-14)."""
    return 20 * F.log10(rms + 1e-12)


def filtered_out(size: int = 4096):
    """UDF (mix, other): the mix less what a filter of `size` taps finds of the other track in it (SIG-14).

    The filter is the ratio of cross and own spectrum, averaged over half-overlapping
    Hann windows of `size` samples; shorter tracks stay as they are.
    """
    hann = np.hanning(size + 1)[:-1]

    def one(m, c) -> np.ndarray:
        n = min(len(m), len(c))
        m, c = np.asarray(m, float)[:n], np.asarray(c, float)[:n]
        if n < size:
            return m
        view = lambda x: np.fft.fft((w := np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2]) * hann - w.mean(axis=1, keepdims=True) * hann, axis=1)
        fm, fc = view(m), view(c)
        own, cross = (np.abs(fc) ** 2).mean(axis=0), (np.conj(fc) * fm).mean(axis=0)
        taps = np.fft.fftshift(np.fft.ifft(cross / (own + 1e-9 * own.max())).real)
        total = 1 << (n + size - 1).bit_length()
        heard = np.fft.irfft(np.fft.rfft(c, total) * np.fft.rfft(taps, total), total)
        return m - heard[size // 2 : size // 2 + n]

    return F.pandas_udf(lambda m, c: pd.Series([one(x, y) for x, y in zip(m, c)]), "array<double>")


def strongest(lags: DataFrame) -> DataFrame:
    """Of each pair the window with the strongest correlation (SIG-14)."""
    w = Window.partitionBy(*PAIR).orderBy(F.desc("rho"), "window")
    return lags.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
