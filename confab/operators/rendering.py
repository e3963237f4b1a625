"""Audio of one speaker: isolated, cleaned, gated, levelled and written (SNK-8, SNK-16).

What is written is one file a track, so these take whole tracks (``signals.joined``).
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.operators import signals

_ARRAY = T.ArrayType(T.DoubleType())
#: Fixed values of the gates, in milliseconds and shares of levels.
GATE_MS, HANG_MS, RAMP_MS, OWN_RAMP_MS, GATE_SHARE, GATE_FLOOR = 150, 250, 30, 20, 0.5, 0.1


def _energy(x: np.ndarray, size: int) -> np.ndarray:
    """Mean squares of the full windows of two stretches of `size` samples, one stretch apart."""
    whole = len(x) // size
    per = (x[: whole * size].reshape(whole, size) ** 2).sum(axis=1)
    return (per[1:] + per[:-1]) / (2 * size)


def _ramped(open_: np.ndarray, ramp: int) -> np.ndarray:
    """A mask of 0 and 1 averaged over `ramp` samples around each; nothing lies beyond the ends."""
    total = np.concatenate([[0.0], np.cumsum(open_)])
    end = np.arange(len(open_)) + (ramp - 1) // 2 + 1
    return (total[np.minimum(end, len(open_))] - total[np.maximum(end - ramp, 0)]) / ramp


def _held(on: np.ndarray, hang: int) -> np.ndarray:
    """On where it is, or was within the last `hang` places."""
    last = np.maximum.accumulate(np.where(on, np.arange(len(on)), -1 - hang))
    return np.arange(len(on)) - last <= hang


def gate(rate: int):
    """UDF (residual, mix): the residual where it holds a share of the mix's level, held on for a while (WIN-4, SIG-5)."""
    size, hang, ramp = rate * GATE_MS // 1000, -(-HANG_MS // GATE_MS), max(1, rate * RAMP_MS // 1000)

    def one(r, m) -> np.ndarray:
        n = min(len(r), len(m))
        r, m = np.asarray(r, float)[:n], np.asarray(m, float)[:n]
        if n < 2 * size:
            return r
        own, all_ = np.sqrt(_energy(r, size)), np.sqrt(_energy(m, size))
        keep = _held((own > GATE_SHARE * (all_ + 1e-12)) & (own > GATE_FLOOR * (np.sqrt(np.mean(m * m)) + 1e-12)), hang)
        place = np.arange(n) // size
        return r * np.clip(_ramped(np.where(place < len(keep), keep[np.minimum(place, len(keep) - 1)], False).astype(float), ramp), 0, 1)

    return F.pandas_udf(lambda r, m: pd.Series([one(x, y) for x, y in zip(r, m)]), _ARRAY)


def noise_gate(rate: int):
    """UDF (samples): silence where the track is not active against its own level (WIN-5, SIG-5)."""
    size, ramp = signals.hop(rate), max(1, rate * OWN_RAMP_MS // 1000)

    def one(x) -> np.ndarray:
        x = np.asarray(x, float)
        if len(x) < 2 * size:
            return x
        on = np.sqrt(_energy(x, size)) > signals.ACTIVE * (np.sqrt(np.mean(x * x)) + 1e-12)
        place = np.arange(len(x)) // size  # a window covers its own stretch and the next
        covered = np.append(on, False) | np.append(False, on)
        return x * np.clip(_ramped(np.where(place < len(covered), covered[np.minimum(place, len(covered) - 1)], False).astype(float), ramp), 0, 1)

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s]), _ARRAY)


def denoised(samples: Column, model: Callable[[np.ndarray], np.ndarray] | None = None) -> Column:
    """The samples through an external cleaner, as long as before; without one as they are (SIG-6)."""
    if model is None:
        return samples

    def one(x) -> np.ndarray:
        x = np.asarray(x, float)
        y = np.asarray(model(x), float)[: len(x)]
        return np.concatenate([y, np.zeros(len(x) - len(y))])

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s]), _ARRAY)(samples)


def wav(rate: int):
    """UDF (samples): 16-bit mono WAV bytes; clipped to 1, cut towards 0 (SNK-8)."""

    def one(x) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s]), T.BinaryType())


def rendered(chunks: DataFrame, plan: DataFrame, rate: int, model: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """call_id, idx, samples of each track of `plan` (call_id, idx, refs) as a recogniser gets it (SNK-16).

    With references: less these, cleaned by `model`, gated against the mix. Without:
    cleaned only. Both are levelled to a peak of 0.9.
    """
    rest = signals.joined(signals.isolate(chunks, plan))
    mix = signals.joined(chunks).select("call_id", "idx", F.col("samples").alias("mix"))
    some = plan.select("call_id", "idx", (F.size("refs") > 0).alias("some"))
    j = rest.join(mix, ["call_id", "idx"]).join(some, ["call_id", "idx"]).withColumn("out", denoised(F.col("samples"), model))
    j = j.withColumn("out", F.when(F.col("some"), gate(rate)("out", "mix")).otherwise(F.col("out")))
    return j.select("call_id", "idx", signals.normalised(F.col("out")).alias("samples"))
